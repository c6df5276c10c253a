"""Summaries of a job from stored partial counts.

Entries are counted once by sarcasm flag, level, intent and month. These counts are a few hundred rows whatever the
number of entries, they add up over jobs, days or files, and every setting of a summary is a sum over some
of them. So a summary under another setting reads neither texts nor entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.functions import labels
from feedback_spark.functions.dates import parse_period
from feedback_spark.functions.numbers import round_half_even, whole_percent

KEYS = ("sarcasm_flag", "polarity", "intent", "period")


def partial_counts(entries: DataFrame, *by: str, timestamp_column: str | None = None) -> DataFrame:
    """(by…, sarcasm_flag, polarity, intent, period, n); ``period`` is null for entries without a month."""
    period = parse_period(F.col(timestamp_column)) if timestamp_column else F.lit(None).cast("string")
    flag = F.coalesce("sarcasm_flag", F.lit(False)) if "sarcasm_flag" in entries.columns else F.lit(False)
    intent = F.col("intent") if "intent" in entries.columns else F.lit(None).cast("string")
    keys = entries.select(*by, flag.alias("sarcasm_flag"), "polarity", intent.alias("intent"), period.alias("period"))
    return keys.groupBy(*by, *KEYS).agg(F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The partial counts of several sources as one."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*by, *KEYS).agg(F.sum("n").alias("n"))


def counted(partials: DataFrame, include_sarcasm: bool) -> DataFrame:
    return partials if include_sarcasm else partials.filter(~F.col("sarcasm_flag"))


def _listed(partials: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(column, n) of every name in order, 0 for those that do not occur."""
    sums: list[Column] = [F.coalesce(F.sum(F.when(F.col(column) == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(names)]
    return partials.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(x).alias(column), F.col(f"n{i}").alias("n")) for i, x in enumerate(names)])))


def polarity_distribution(partials: DataFrame) -> DataFrame:
    return _listed(partials, "polarity", labels.LEVELS)


def intent_distribution(partials: DataFrame) -> DataFrame:
    return _listed(partials, "intent", labels.INTENTS)


def monthly_trend(partials: DataFrame) -> DataFrame:
    """(period, avg_polarity) as over the entries themselves."""
    halves = (labels.level_score(F.col("polarity")) * 2).cast("long") * F.col("n")
    return partials.filter("period IS NOT NULL").groupBy("period").agg(
        round_half_even(F.sum(halves) / 2 / F.sum("n"), 3).alias("avg_polarity")
    )


def sarcasm_summary(partials: DataFrame) -> DataFrame:
    """(sarcasm_count, entries, sarcasm_pct)."""
    sums = partials.agg(
        F.coalesce(F.sum(F.when(F.col("sarcasm_flag"), F.col("n"))), F.lit(0)).alias("sarcasm_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")
    )
    return sums.withColumn("sarcasm_pct", whole_percent(F.col("sarcasm_count"), F.col("entries")))


def summary(partials: DataFrame, include_sarcasm: bool) -> DataFrame:
    """(part, name, value) of all aggregates of a setting in long form; flagged entries are counted under either setting."""
    held = counted(partials, include_sarcasm)
    parts = [
        polarity_distribution(held).select(F.lit("polarity").alias("part"), F.col("polarity").alias("name"), F.col("n").cast("double").alias("value")),
        intent_distribution(held).select(F.lit("intent").alias("part"), F.col("intent").alias("name"), F.col("n").cast("double").alias("value")),
        monthly_trend(held).select(F.lit("trend").alias("part"), F.col("period").alias("name"), F.col("avg_polarity").alias("value")),
        sarcasm_summary(partials).select(F.lit("sarcasm").alias("part"), F.lit("count").alias("name"), F.col("sarcasm_count").cast("double").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
