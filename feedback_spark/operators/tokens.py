"""Word and word-pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.functions import stems, text


def tokens(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, word), one row per word of ``cleaned_text``."""
    held = cleaned.filter(F.col("cleaned_text") != "")
    return held.select(key, F.posexplode(text.split_words(F.col("cleaned_text"))).alias("pos", "word"))


def by_document(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """``cleaned`` dealt by its key, for counts per document and word that are joined to the document again.

    A text is shorter than the (key, word, count) rows it gives, so moving it once costs less than moving
    these rows for the count and again for the join.
    """
    return cleaned.repartition(F.col(key))


def words_only(cleaned: DataFrame) -> DataFrame:
    """(word), for counts that need no document key."""
    held = cleaned.filter(F.col("cleaned_text") != "")
    return held.select(F.explode(text.split_words(F.col("cleaned_text"))).alias("word"))


def bigrams(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, w1, w2); a document of one word gives none.

    Needs no shuffle: the second word is read from the word list of the row,
    which passes through the compiled explode without being copied.
    """
    word_list = text.split_words(F.col("cleaned_text"))
    held = cleaned.filter(F.col("cleaned_text") != "")
    # A column of its own: named in the select it would be split again for every word.
    placed = held.withColumn("ws", word_list).select(key, "ws", F.posexplode(word_list).alias("pos", "w1"))
    return placed.select(key, "w1", F.get("ws", F.col("pos") + 1).alias("w2")).filter(F.col("w2").isNotNull())


def long_enough(word: Column) -> Column:
    return F.length(word) > 2


def topic_tokens(cleaned: DataFrame, stops: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, word) without numbers, stop words and words under three letters."""
    kept = tokens(cleaned, key).filter(long_enough(F.col("word")) & ~F.col("word").rlike("^[0-9]+$"))
    return kept.join(stops, "word", "left_anti").select(key, "pos", "word")


def topic_terms(cleaned: DataFrame, stops: DataFrame, key: str = "doc_id", stem: bool = False) -> DataFrame:
    """(key, terms): the words of ``topic_tokens`` as one sorted list per document, empty lists left out.

    Words are tested inside the row, so no word is shuffled. The stop words arrive as
    one array; a stop list is a closed class of function words.
    """
    listed = stops.agg(F.collect_set("word").alias("stops")).scalar()
    kept = cleaned.filter(F.col("cleaned_text") != "").withColumn("_stops", F.coalesce(listed, F.array().cast("array<string>")))
    numeric = "^[0-9]+$"
    # Digits sort before ":", so a word from there on is no number and needs no pattern.
    found = F.filter(
        text.split_words(F.col("cleaned_text")),
        lambda w: long_enough(w) & ((w >= ":") | ~w.rlike(numeric)) & ~F.array_contains("_stops", w),
    )
    terms = F.transform(found, stems.stem) if stem else found
    return kept.select(key, F.explode(text.if_kept(F.sort_array(terms), lambda t: F.size(t) > 0)).alias("terms"))


def stemmed(words: DataFrame) -> DataFrame:
    """``words`` with each word replaced by its stem.

    Only the distinct words are stemmed and joined back: Spark broadcasts the
    vocabulary while it is small, and splits the partitions of frequent words
    when it is not. Words that are their own stem need no partner.
    """
    vocabulary = words.select("word").distinct()
    changed = vocabulary.select(
        "word", F.explode(text.if_kept(stems.stem(F.col("word")), lambda s: s != F.col("word"))).alias("stem")
    )
    joined = words.join(changed, "word", "left")
    return joined.select(*[
        F.coalesce("stem", "word").alias("word") if c == "word" else F.col(c) for c in words.columns
    ])


def doc_term_counts(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, n), the document-term matrix in long form."""
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
