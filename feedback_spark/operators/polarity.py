"""Lexicon polarity of documents and its corpus figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.functions import labels, text
from feedback_spark.functions.numbers import round_half_even, whole_percent
from feedback_spark.sources.lexicons import Shifters

# Reach of shifters, their strength, and the blend of both scores.
WORDS_BEFORE = 5
WORDS_AFTER = 2
AMPLIFY = 0.8
VALENCE_SHARE = 0.65
LEXICON_SHARE = 0.35
# Word weights are summed as whole billionths, so no sum depends on row order. A finer weight is an error.
UNITS = 1_000_000_000


def bing_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of each document found in the polarity lexicon."""
    return tokens.join(lexicon, "word")


def lexicon_counts(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    return bing_hits(tokens, lexicon).groupBy(key, "sentiment").agg(F.count(F.lit(1)).alias("n"))


def lexicon_pivot(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both classes as columns, also when one never occurs."""
    wide = counts.groupBy(key).pivot("sentiment", ["positive", "negative"]).sum("n")
    return wide.na.fill(0, ["positive", "negative"])


def bing_score(positive: Column, negative: Column) -> Column:
    return (positive - negative) / (positive + negative + 1)


def whole_units(weight: Column) -> Column:
    """A weight as a whole number of units; an error where it does not fit."""
    scaled = weight * F.lit(float(UNITS))
    fits = F.abs(scaled - F.rint(scaled)) <= 1e-5
    wrong = F.raise_error(F.concat(F.lit("word weight finer than a billionth: "), weight.cast("string"))).cast("long")
    return F.when(fits | weight.isNull(), F.rint(scaled).cast("long")).otherwise(wrong)


def word_table(lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """(word, positive, negative, units), each word once, so a left join adds no rows."""
    zero = F.lit(0).cast("long")
    classes = lexicon.select(
        "word",
        (F.col("sentiment") == "positive").cast("long").alias("positive"),
        (F.col("sentiment") == "negative").cast("long").alias("negative"),
        zero.alias("units"),
    )
    weighted = weights.select(
        "word", zero.alias("positive"), zero.alias("negative"),
        whole_units(F.col("weight")).alias("units"),
    )
    return (
        classes.unionAll(weighted)
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in ("positive", "negative", "units")])
    )


# Marks of shifters, chosen so that a sum of seven marks still tells the three counts.
NEGATOR, AMPLIFIER, SOFTENER = 1, 100, 10_000


def shifter_marks(word_list: Column, shifters: Shifters) -> Column:
    """One mark per word, 0 for no shifter, with blank places at both ends."""

    def mark(w: Column) -> Column:
        return (
            F.when(w.isin(*shifters.negators), NEGATOR)
            .when(w.isin(*shifters.amplifiers), AMPLIFIER)
            .when(w.isin(*shifters.softeners), SOFTENER)
            .otherwise(0)
        )

    def blank(places: int) -> Column:
        return F.array(*[F.lit(0)] * places)

    return F.concat(blank(WORDS_BEFORE), F.transform(word_list, mark), blank(WORDS_AFTER))


def marks_near(marks: Column, at: Column) -> Column:
    """Sum of the marks of the five words before and the two after position ``at``."""
    others = [p for p in range(WORDS_BEFORE + 1 + WORDS_AFTER) if p != WORDS_BEFORE]
    return reduce(Column.__add__, [F.get(marks, at + p) for p in others])


def contribution(units: Column, near: Column) -> Column:
    """Shifted weight in tenths of a unit, exact in whole numbers."""
    flips = near % AMPLIFIER
    scale = F.floor(near / AMPLIFIER) % AMPLIFIER - F.floor(near / SOFTENER)
    sign = F.when(flips % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
    return units * sign * F.greatest(F.lit(0).cast("long"), F.lit(10) + F.lit(round(AMPLIFY * 10)) * scale)


def hybrid_polarity(
    cleaned: DataFrame,
    lexicon: DataFrame,
    weights: DataFrame,
    shifters: Shifters,
    key: str = "doc_id",
) -> DataFrame:
    """Scores and level of every cleaned document, one row per key.

    The words of a document lie side by side in one partition, so the partial
    aggregate sends one narrow row per document through the only shuffle; the
    text itself is never shuffled. The left join keeps documents without a hit
    at score 0, which makes a join back to the documents needless.

    Each word takes the sum of the marks near it along. The list is joined
    without a hint: Spark broadcasts it by its bytes, and then explode, join and
    partial aggregate compile into one loop, or else joins by a shuffle.
    """
    table = word_table(lexicon, weights)
    word_list = text.split_words(F.col("cleaned_text"))
    marked = cleaned.filter(F.col("cleaned_text") != "").withColumn("marks", shifter_marks(word_list, shifters))
    placed = marked.select(key, "marks", F.posexplode(word_list).alias("pos", "word"))
    words = placed.select(key, "word", marks_near(F.col("marks"), F.col("pos")).alias("near"))
    scored = words.join(table, "word", "left")
    weighs = F.coalesce(F.col("units"), F.lit(0)) != 0
    shifted = F.when(weighs, contribution(F.col("units"), F.col("near")))
    sums = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("word_count"),
        F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum(shifted), F.lit(0)).alias("tenths"),
    )
    valence = F.col("tenths") / F.lit(10.0 * UNITS) / F.sqrt("word_count")
    return (
        sums.withColumn("valence_score", valence)
        .withColumn("bing_score", bing_score(F.col("positive"), F.col("negative")))
        .withColumn(
            "polarity_score",
            F.lit(VALENCE_SHARE) * F.col("valence_score") + F.lit(LEXICON_SHARE) * F.col("bing_score"),
        )
        .withColumn("polarity_class", labels.polarity_class(F.col("polarity_score")))
        .drop("tenths")
    )


def corpus_summary(scored: DataFrame) -> DataFrame:
    """Documents, mean words, share of positive and of negative documents; null figures for an empty corpus."""

    def percent(levels: list[str]) -> Column:
        held = F.count_if(F.col("polarity_class").isin(levels))
        return round_half_even(F.try_divide(F.lit(100.0) * held, F.count(F.lit(1))), 1)

    return scored.agg(
        F.count(F.lit(1)).alias("documents"),
        F.rint(F.avg("word_count")).cast("long").alias("avg_word_count"),
        percent(labels.POSITIVE_LEVELS).alias("positive_pct"),
        percent(labels.NEGATIVE_LEVELS).alias("negative_pct"),
    )


def polarity_counts(scored: DataFrame, column: str = "polarity_class") -> DataFrame:
    """Levels that occur, in level order."""
    return (
        scored.groupBy(F.col(column).alias("polarity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("polarity_order", labels.level_order(F.col("polarity")))
        .orderBy("polarity_order", "polarity")
    )


def bucket_counts(df: DataFrame, column: str, buckets: list[str], name: str) -> DataFrame:
    """Count of every bucket, 0 for those that do not occur.

    One aggregate with a conditional count per bucket, unfolded to rows, in
    place of a join with a bucket table.
    """
    counts = [F.count_if(F.col(column) == b).alias(f"n{i}") for i, b in enumerate(buckets)]
    pairs = [
        F.struct(F.lit(i + 1).alias("at"), F.lit(b).alias(name), F.col(f"n{i}").alias("n"))
        for i, b in enumerate(buckets)
    ]
    return df.agg(*counts).select(F.inline(F.array(*pairs)))


def polarity_distribution(df: DataFrame, column: str = "polarity") -> DataFrame:
    return bucket_counts(df, column, labels.LEVELS, "polarity").drop("at")


def polarity_percent(df: DataFrame, column: str = "polarity") -> DataFrame:
    """Whole percent of each level and of the three groups.

    Rows whose level is none of the five count for no bucket and not for the total.
    """
    levels = bucket_counts(df, column, labels.LEVELS, "polarity")
    grouped = levels.select(F.inline(F.array(
        F.struct(F.col("polarity").alias("bucket"), "n"),
        F.struct(F.concat(F.lit("group "), labels.polarity_group(F.col("polarity"))).alias("bucket"), "n"),
    ))).groupBy("bucket").agg(F.sum("n").alias("n"))
    total = levels.agg(F.sum("n").alias("total")).scalar()
    return grouped.select("bucket", "n", whole_percent(F.col("n"), total).alias("pct"))


def polarity_cumulative(df: DataFrame, column: str = "polarity") -> DataFrame:
    """Share of each level and the share of the levels before it, in level order.

    The running sum is an array fold over five counts of one row.
    """
    row = df.agg(F.array(*[F.count_if(F.col(column) == x) for x in labels.LEVELS]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    row = row.withColumn("total", F.greatest(total, F.lit(1).cast("long")))
    at = F.posexplode("c").alias("at", "n")
    before = F.aggregate(F.slice("c", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in labels.LEVELS])
    return row.select("c", "total", at).select(
        F.get(names, F.col("at")).alias("polarity"),
        (F.col("n") / F.col("total")).alias("share"),
        (before / F.col("total")).alias("share_before"),
    )
