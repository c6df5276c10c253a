"""Polarity by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedback_spark.functions.dates import parse_period
from feedback_spark.functions.labels import level_score
from feedback_spark.functions.numbers import round_half_even
from feedback_spark.functions.text import if_kept


def monthly_trend(entries: DataFrame, timestamp_column: str, polarity: str = "polarity") -> DataFrame:
    """(period, avg_polarity) in period order; rows without a month are left out.

    Level scores are halves, so they are summed as whole numbers.
    """
    period = parse_period(F.col(timestamp_column))
    return (
        entries.select(
            F.explode(if_kept(period, lambda p: p.isNotNull())).alias("period"),
            (level_score(F.col(polarity)) * 2).cast("long").alias("halves"),
        )
        .groupBy("period")
        .agg(round_half_even(F.sum("halves") / 2 / F.count(F.lit(1)), 3).alias("avg_polarity"))
        .orderBy("period")
    )


def trend_direction(trend: DataFrame) -> DataFrame:
    """First and last month and whether polarity improves, declines or stays."""
    ends = trend.agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.min_by("avg_polarity", "period").alias("first_avg"),
        F.max_by("avg_polarity", "period").alias("last_avg"),
    ).filter("first_period IS NOT NULL")
    direction = (
        F.when(F.col("last_avg") > F.col("first_avg"), "improving")
        .when(F.col("last_avg") < F.col("first_avg"), "declining")
        .otherwise("stable")
    )
    return ends.withColumn("direction", direction)


def trend_low_point(trend: DataFrame) -> DataFrame:
    """The earliest month of the least mean; ``marked`` only below zero."""
    low = trend.agg(F.min(F.struct("avg_polarity", "period")).alias("low")).filter("low IS NOT NULL")
    return low.select("low.period", "low.avg_polarity", (F.col("low.avg_polarity") < 0).alias("marked"))
