"""The corpus analysis: clean, score, count words, emotions and topics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from feedback_spark.operators import cleaning, emotions, keywords, polarity, tokens, topics
from feedback_spark.session import durable
from feedback_spark.sources.lexicons import Lexicons


@dataclass(frozen=True)
class CorpusResult:
    """One frame per part of the result; ``topic_terms`` and ``document_topics`` may be None."""

    cleaned: DataFrame
    scored: DataFrame
    summary: DataFrame
    polarity: DataFrame
    top_words: DataFrame
    top_bigrams: DataFrame
    emotions: DataFrame
    topic_terms: DataFrame | None
    document_topics: DataFrame | None
    document_emotions: DataFrame | None = None
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drop the kept blocks once the result has been used."""
        for df in self.kept:
            df.unpersist()


def corpus_analysis(
    documents: DataFrame,
    lexicons: Lexicons,
    *,
    key: str = "row_index",
    with_topics: bool = True,
    stem: bool = True,
    topic_options: dict | None = None,
) -> CorpusResult:
    """Analyse (key, raw_text, label) documents.

    Cleaning costs more than writing and reading the cleaned texts, and several passes
    read them, so they are stored once in the shared folder. Only narrow frames are kept in
    memory: scores, word counts and topic vectors. Kept blocks lost with an executor are computed again.
    The topic model's samples depend on how its rows lie, so it is fitted on the documents as they came; the terms of its topics do not.
    """
    made = cleaning.clean_documents(documents)
    cleaned = durable(made, "cleaned")
    scored = polarity.hybrid_polarity(
        cleaned, lexicons.polarity, lexicons.weights, lexicons.shifters, key
    ).persist(StorageLevel.MEMORY_AND_DISK)
    counts = keywords.word_counts(tokens.words_only(cleaned)).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = None
    if with_topics:
        stops = lexicons.stops if lexicons.topic_stops is None else lexicons.topic_stops
        terms = tokens.topic_terms(made, stops, key, stem)
        fitted = topics.fit_topics(terms, key=key, **(topic_options or {}))
        if fitted:
            fitted = replace(fitted, lists=tokens.topic_terms(cleaned, stops, key, stem))
    return CorpusResult(
        cleaned=cleaned,
        scored=scored,
        summary=polarity.corpus_summary(scored),
        polarity=polarity.polarity_counts(scored),
        top_words=keywords.top_words(counts, lexicons.stops),
        top_bigrams=keywords.top_bigrams(tokens.bigrams(cleaned, key), lexicons.stops),
        emotions=emotions.emotion_shares(counts, lexicons.emotions),
        topic_terms=topics.topic_terms(topics.topic_beta(fitted)) if fitted else None,
        document_topics=topics.dominant_topics(fitted, key) if fitted else None,
        document_emotions=emotions.document_emotions(tokens.tokens(cleaned, key), lexicons.emotions, key),
        kept=(scored, counts) + ((fitted.documents,) if fitted else ()),
    )


def listed(df: DataFrame, order: list, **fields: str):
    """Rows of a bounded frame as one sorted array of records, for use as a value.

    ``order`` are the sort columns; ``fields`` maps record field to column.
    """
    rank = [F.col(c).alias(f"_{i}") if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(order)]
    record = F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("r")
    rows = F.sort_array(F.collect_list(F.struct(*rank, record)))
    return df.agg(F.transform(rows, lambda x: x["r"]).alias("rows")).scalar()


def corpus_record(result: CorpusResult) -> DataFrame:
    """The whole result as one nested row."""
    spark = result.summary.sparkSession
    parts = [
        result.summary.select(F.struct("*")).scalar().alias("summary"),
        listed(result.polarity, ["polarity_order"], **{"class": "polarity", "count": "n"}).alias("polarity_distribution"),
        listed(result.top_words, [-F.col("n"), "word"], word="word", count="n").alias("top_words"),
        listed(result.top_bigrams, [-F.col("n"), "w1", "w2"], bigram="bigram", count="n").alias("top_bigrams"),
        listed(result.emotions, [-F.col("pct"), "emotion"], emotion="emotion", pct="pct").alias("emotions"),
    ]
    if result.topic_terms is None:
        parts.append(F.array().cast("array<struct<topic:int,terms:array<string>>>").alias("topics"))
    else:
        parts.append(listed(result.topic_terms, ["topic"], topic="topic", terms="terms").alias("topics"))
    return spark.range(1).select(*parts)
