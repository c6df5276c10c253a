"""Emotion shares of a corpus and of single documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedback_spark.functions import shares
from feedback_spark.functions.numbers import number_or, round_half_even

# Lexicon classes that are no emotion, emotions left out, and the new name.
NOT_EMOTIONS = ["positive", "negative"]
DROPPED = ["trust", "anticipation", "positive", "negative"]
RENAMED = {"joy": "happiness"}


def emotion_lexicon(lexicon: DataFrame) -> DataFrame:
    return lexicon.filter(~F.col("sentiment").isin(NOT_EMOTIONS))


def emotion_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words with each of their emotions; a word of several emotions gives several rows."""
    return tokens.join(emotion_lexicon(lexicon), "word").withColumnRenamed("sentiment", "emotion")


def emotion_shares(word_counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(emotion, n, pct) from (word, n) counts, largest share first.

    It starts from counted words, so the lexicon meets each distinct word once.
    The window is over one row per emotion, after the aggregate.
    """
    counted = emotion_hits(word_counts, lexicon).groupBy("emotion").agg(F.sum("n").alias("n"))
    pct = round_half_even(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 1)
    return counted.withColumn("pct", pct).orderBy(F.desc("pct"), "emotion")


def emotion_by_document(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, emotion, n, share), shares of one document adding up to 1 before rounding."""
    counted = emotion_hits(tokens, lexicon).groupBy(key, "emotion").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counted.withColumn("share", round_half_even(share, 4))


def _kept_name(emotion: Column) -> Column:
    name = F.lower(emotion)
    for old, new in RENAMED.items():
        name = F.when(F.lower(emotion) == old, new).otherwise(name)
    return name


def emotion_distribution(pct_table: DataFrame, renormalise: bool = False) -> DataFrame:
    """(emotion, share) with names people use, left-out emotions gone.

    Shares stay relative to all emotions, so they need not add up to 1;
    ``renormalise`` makes them do so. Of two rows that get one name the smaller
    share stays, the later one of a list from the largest down.
    """
    pct = number_or(F.col("pct"), 0.0)
    kept = pct_table.select(_kept_name(F.col("emotion")).alias("emotion"), pct.alias("pct")).filter(
        ~F.col("emotion").isin(DROPPED)
    ).groupBy("emotion").agg(F.min("pct").alias("pct"))
    whole = F.sum("pct").over(Window.partitionBy()) if renormalise else F.lit(100.0)
    return kept.select("emotion", round_half_even(F.col("pct") / whole, 4).alias("share"))


def emotions_map(distribution: DataFrame, *by: str) -> DataFrame:
    """One ``map<emotion,share>`` for the corpus, or one for each value of ``by``."""
    listed = F.sort_array(F.collect_list(F.struct("emotion", "share")))
    return distribution.groupBy(*by).agg(F.map_from_entries(listed).alias("emotions"))


def document_emotions(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, emotions): the kept emotions of each document as one map; documents without an emotion word give no row."""
    found = emotion_by_document(tokens, lexicon, key)
    named = found.select(key, _kept_name(F.col("emotion")).alias("emotion"), "share").filter(~F.col("emotion").isin(DROPPED))
    return emotions_map(named.groupBy(key, "emotion").agg(F.min("share").alias("share")), key)


def emotion_percent(distribution: DataFrame) -> DataFrame:
    """The six shown emotions in their fixed order, whole percent, absent ones 0."""
    names = list(shares.EMOTION_NAMES)
    sums = distribution.agg(*[
        F.coalesce(F.max(F.when(F.col("emotion") == n, F.col("share"))), F.lit(0.0)).alias(n) for n in names
    ])
    cells = [
        F.struct(
            F.lit(i + 1).alias("place"),
            F.lit(label).alias("emotion"),
            F.floor(F.col(n) * 100 + 0.5).cast("long").alias("pct"),
        )
        for i, (n, label) in enumerate(shares.EMOTION_NAMES.items())
    ]
    return sums.select(F.inline(F.array(*cells)))
