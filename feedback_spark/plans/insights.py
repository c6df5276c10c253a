"""Facts a dashboard states about each theme, one row per fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.functions import labels, shares
from feedback_spark.functions.numbers import whole_percent
from feedback_spark.operators import entries as rows_of, keywords as kw, trend as months
from feedback_spark.plans.assemble import Assembled

# Shares in percent from which a data set counts as positive or negative.
POSITIVE_FROM = 50
NEGATIVE_FROM = 40


def insight_tone(entries: DataFrame, column: str = "polarity") -> DataFrame:
    """(positive_pct, neutral_pct, negative_pct, tone) of the five levels."""
    group = labels.polarity_group(F.col(column))
    known = F.col(column).isin(labels.LEVELS)
    counts = entries.agg(
        *[F.count_if(known & (group == g)).alias(g) for g in ("positive", "neutral", "negative")],
        F.count_if(known).alias("total"),
    )
    pct = counts.select(*[
        whole_percent(F.col(g), F.col("total")).alias(f"{g}_pct") for g in ("positive", "neutral", "negative")
    ])
    tone = (
        F.when(F.col("positive_pct") >= POSITIVE_FROM, "predominantly positive")
        .when(F.col("negative_pct") >= NEGATIVE_FROM, "skewing negative")
        .otherwise("mixed")
    )
    return pct.withColumn("tone", tone)


def leading_emotion(distribution: DataFrame) -> DataFrame:
    """(emotion, pct) of the largest share, equal shares by name."""
    best = distribution.agg(F.min(F.struct((-F.col("share")).alias("rank"), "emotion")).alias("b"))
    return best.filter("b IS NOT NULL").select(
        shares.emotion_name(F.col("b.emotion")).alias("emotion"),
        F.floor(-F.col("b.rank") * 100 + 0.5).cast("long").alias("pct"),
    )


def result_presence(**parts: DataFrame | None) -> DataFrame:
    """(part, n): rows of each part that is there."""
    counts = [
        p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, p in parts.items()
        if p is not None
    ]
    return reduce(DataFrame.unionByName, counts)


def _facts(theme: str, row: DataFrame, **facts: str | Column) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("fact"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"))
        for name, c in facts.items()
    ]
    return row.select(F.lit(theme).alias("theme"), F.inline(F.array(*cells)))


def insight_facts(made: Assembled) -> DataFrame:
    """(theme, fact, value) over whole tables; themes without data give no row."""
    parts = [
        _facts("finegrained", insight_tone(made.entries), tone="tone", positive_pct="positive_pct",
               neutral_pct="neutral_pct", negative_pct="negative_pct"),
        _facts("aspect", rows_of.aspect_distinct(made.entries), aspects="aspects"),
        made.intent_distribution.select(
            F.lit("intent").alias("theme"), F.col("intent").alias("fact"), F.col("n").cast("string").alias("value")
        ),
        _facts("sarcasm", made.sarcasm, count="sarcasm_count", pct="sarcasm_pct"),
        _facts("confidence", rows_of.confidence_stats(made.entries), average_pct="avg_confidence_pct", low="low_count"),
    ]
    if made.emotion_distribution is not None:
        parts.append(_facts("emotion", leading_emotion(made.emotion_distribution), emotion="emotion", pct="pct"))
    if made.keywords is not None:
        parts.append(kw.leading_keywords(made.keywords).select(
            F.lit("keywords").alias("theme"), F.col("side").alias("fact"), F.col("word").alias("value")
        ))
    if made.trend is not None:
        parts.append(_facts("trend", months.trend_direction(made.trend), direction="direction",
                            first="first_period", last="last_period"))
    if made.topics is not None:
        parts.append(_facts("topics", result_presence(topics=made.topics), found="n"))
    return reduce(DataFrame.unionByName, parts)
