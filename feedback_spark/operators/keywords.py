"""Frequent words and pairs, keywords by side, word cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedback_spark.functions.labels import polarity_group
from feedback_spark.functions.numbers import number_or, round_half_even
from feedback_spark.operators import frequent
from feedback_spark.operators.tokens import long_enough

# Lengths of the reported lists and the keyword score.
TOP_WORDS = 30
TOP_BIGRAMS = 20
KEYWORD_WORDS = 20
KEYWORDS_PER_SIDE = 10
SCORE_LIMIT = 0.95
SCORE_SCALE = 50.0


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n) over all rows; frequent words collapse before the shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def content_words(counts: DataFrame, stops: DataFrame) -> DataFrame:
    """Counted words without stop words and words under three letters.

    Counting first leaves one probe per distinct word.
    """
    return counts.filter(long_enough(F.col("word"))).join(stops, "word", "left_anti")


def top_words(counts: DataFrame, stops: DataFrame, limit: int = TOP_WORDS) -> DataFrame:
    return content_words(counts, stops).orderBy(F.desc("n"), "word").limit(limit)


def content_pairs(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """Pairs of two content words. Pairs are nearly all different, so stop words go before any count."""
    kept = pairs.filter(long_enough(F.col("w1")) & long_enough(F.col("w2")))
    for side in ("w1", "w2"):
        kept = kept.join(stops.withColumnRenamed("word", side), side, "left_anti")
    return kept


def bigram_counts(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """(w1, w2, n) of all pairs of two content words."""
    return content_pairs(pairs, stops).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def top_bigrams(pairs: DataFrame, stops: DataFrame, limit: int = TOP_BIGRAMS) -> DataFrame:
    """(bigram, w1, w2, n) of the most frequent pairs of content words, ties by name.

    Frequent pairs are named by summaries and counted exactly, so that not every pair of the corpus is shuffled.
    """
    both = content_pairs(pairs, stops).select(F.concat_ws(" ", "w1", "w2").alias("value"))
    best = frequent.top_values(both, limit)
    words = F.split("value", " ")
    return best.select(F.col("value").alias("bigram"), words[0].alias("w1"), words[1].alias("w2"), "n")


def ranked_words(top: DataFrame, limit: int = KEYWORD_WORDS) -> DataFrame:
    """One row holding the first ``limit`` words in rank order as an array."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "word")))
    return top.agg(F.slice(listed, 1, limit).alias("ranked"))


def keyword_marks(
    texts: DataFrame, top: DataFrame, text_column: str = "text", limit: int = KEYWORD_WORDS
) -> DataFrame:
    """``texts`` with ``ranked``, the leading words, and ``marks``, a flag per word the text holds.

    A word counts wherever it stands, also inside a longer word. The words
    arrive as a scalar subquery of one bounded array, so texts are not joined
    with words, and what a later join moves is a few flags in place of the text.
    """
    low = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    read = texts.withColumn("low", low).withColumn("ranked", ranked_words(top, limit).scalar())

    def holds(i: int) -> Column:
        return F.coalesce(F.contains("low", F.get("ranked", F.lit(i))["word"]), F.lit(False))

    return read.withColumn("marks", F.array(*[holds(i) for i in range(limit)])).drop("low")


def keyword_hits(marked: DataFrame, *, key: str = "row_index", limit: int = KEYWORD_WORDS) -> DataFrame:
    """(rank, word, n, pos_hits, neg_hits, first_polarity) from (key, polarity, ranked, marks).

    One global aggregate with a conditional count per word and side.
    ``first_polarity`` is the level of the row with the smallest key, which
    settles ties.
    """
    side = polarity_group(F.col("polarity"))

    def hits(of: str, i: int) -> Column:
        return F.count_if((side == of) & F.get("marks", F.lit(i)))

    counted = marked.agg(
        F.any_value("ranked").alias("ranked"),
        F.min_by("polarity", key).alias("first_polarity"),
        F.array(*[hits("positive", i) for i in range(limit)]).alias("pos"),
        F.array(*[hits("negative", i) for i in range(limit)]).alias("neg"),
    )
    return counted.select("*", F.posexplode("ranked").alias("at", "item")).select(
        (F.col("at") + 1).alias("rank"),
        F.col("item.word").alias("word"),
        (-F.col("item.rank")).alias("n"),
        F.get("pos", F.col("at")).alias("pos_hits"),
        F.get("neg", F.col("at")).alias("neg_hits"),
        "first_polarity",
    )


def keyword_scores(hits: DataFrame, per_side: int = KEYWORDS_PER_SIDE) -> DataFrame:
    """(side, place, word, score): each word on the side with more hits, ten a side."""
    tie = F.when(polarity_group(F.col("first_polarity")) == "positive", "positive").otherwise("negative")
    side = (
        F.when(F.col("pos_hits") > F.col("neg_hits"), "positive")
        .when(F.col("neg_hits") > F.col("pos_hits"), "negative")
        .otherwise(tie)
    )
    size = F.least(F.lit(SCORE_LIMIT), number_or(F.col("n"), 1.0) / SCORE_SCALE)
    score = round_half_even(F.when(F.col("side") == "positive", size).otherwise(-size), 2)
    place = F.row_number().over(Window.partitionBy("side").orderBy("rank"))
    return (
        hits.withColumn("side", side)
        .withColumn("place", place)
        .filter(F.col("place") <= per_side)
        .select("side", "place", "word", score.alias("score"))
    )


def word_cloud(top: DataFrame, keywords: DataFrame) -> DataFrame:
    """(word, weight, is_positive, size): weights, and whether a positive keyword.

    Both inputs are bounded lists; ``size`` is relative to the largest weight.
    """
    positive = keywords.filter("side = 'positive'").select("word", F.lit(True).alias("found"))
    largest = F.greatest(F.max("weight").over(Window.partitionBy()), F.lit(1.0))
    return (
        top.select("word", number_or(F.col("n"), 1.0).alias("weight"))
        .join(positive, "word", "left")
        .select(
            "word", "weight", F.col("found").isNotNull().alias("is_positive"),
            (F.col("weight") / largest).alias("size"),
        )
    )


def keyword_relative(keywords: DataFrame) -> DataFrame:
    """Size of each score against the largest of its side."""
    size = F.abs("score")
    largest = F.greatest(F.max(size).over(Window.partitionBy("side")), F.lit(0.01))
    return keywords.select("side", "word", "score", (size / largest).alias("relative"))


def leading_keywords(keywords: DataFrame) -> DataFrame:
    """First word of each side."""
    return keywords.groupBy("side").agg(F.min_by("word", "place").alias("word"))
