"""Entries and aggregates of one job from predictions and the corpus result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from feedback_spark.functions.labels import INTENTS, LEVELS
from feedback_spark.operators import cleaning, emotions, entries as rows_of, keywords, polarity, topics, trend
from feedback_spark.plans.corpus import CorpusResult, listed

WHEN = "_when"
# Columns of an entry that a detector may supply, and what stands in for them.
OPTIONAL = {
    "intent": ("string", ""),
    "sarcasm_flag": ("boolean", False),
    "sarcasm_confidence": ("double", 0.0),
    "aspects": (rows_of.ASPECTS, None),
}


@dataclass(frozen=True)
class Assembled:
    """Entries and one frame per aggregate; parts that need the corpus may be None."""

    entries: DataFrame
    polarity_distribution: DataFrame
    intent_distribution: DataFrame
    sarcasm: DataFrame
    emotion_distribution: DataFrame | None
    keywords: DataFrame | None
    word_cloud: DataFrame | None
    topics: DataFrame | None
    trend: DataFrame | None
    kept: DataFrame

    def release(self) -> None:
        """Drop the kept blocks once the parts have been used or stored."""
        self.kept.unpersist()


def _joined(
    rows: DataFrame, predictions: DataFrame, corpus: CorpusResult | None, text_column: str, timestamp_column: str | None,
    key: str,
) -> DataFrame:
    """Predictions with what the aggregates need of the rows, in the one join of both.

    The text is reduced to its keyword marks first, so only narrow rows are shuffled.
    """
    when = [F.col(timestamp_column).alias(WHEN)] if timestamp_column else []
    needed = rows.select(key, *when, F.col(text_column).alias("_text"))
    if corpus is not None:
        needed = keywords.keyword_marks(needed, corpus.top_words, "_text")
    joined = rows_of.rows_predictions(needed.drop("_text"), predictions, key)
    for name, (kind, default) in OPTIONAL.items():
        if name not in predictions.columns:
            value = F.array() if default is None else F.lit(default)
            joined = joined.withColumn(name, value.cast(kind))
    return joined


def _entries(joined: DataFrame, corpus: CorpusResult | None, key: str, emotions_per_entry: bool) -> DataFrame:
    entries = joined.select(key, "polarity", "polarity_confidence", *OPTIONAL)
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:double>>"))
    if corpus is None:
        entries = entries.withColumn("emotions", empty)
    elif emotions_per_entry:
        entries = entries.join(corpus.document_emotions, key, "left").withColumn("emotions", F.coalesce("emotions", empty))
    else:
        shared = emotions.emotions_map(emotions.emotion_distribution(corpus.emotions))
        entries = rows_of.entries_with_emotions(entries, shared)
    if corpus is not None and corpus.document_topics is not None:
        entries = entries.join(corpus.document_topics.select(key, "topics"), key, "left")
    else:
        entries = entries.withColumn("topics", F.lit(None).cast(rows_of.TOPICS))
    return entries.withColumn("topics", F.coalesce(F.col("topics").cast(rows_of.TOPICS), F.array().cast(rows_of.TOPICS)))


def _topics(corpus: CorpusResult, chosen: DataFrame, key: str, mode: str) -> DataFrame:
    of = corpus.document_topics if mode == "per_topic" else corpus.topic_terms
    profile = topics.topic_profile(chosen, of, mode, key)
    named = corpus.topic_terms.join(topics.topic_labels(corpus.topic_terms), "topic")
    return named.join(profile, "topic", "left").na.fill(0, topics.SIDES)


def assemble(
    rows: DataFrame,
    predictions: DataFrame,
    corpus: CorpusResult | None,
    *,
    text_column: str,
    timestamp_column: str | None = None,
    key: str = "row_index",
    include_sarcasm: bool = True,
    topic_mode: str = "global",
    emotions_per_entry: bool = False,
) -> Assembled:
    """Combine the branches. Without ``corpus`` entries, distribution and trend remain.

    With ``include_sarcasm=False`` flagged rows count in no aggregate: ``corpus`` must then be that of the other
    rows, as ``job.counted_documents`` gives it. Entries carry the emotions of the whole corpus, or with
    ``emotions_per_entry`` those of their own text, so that a filter by emotion tells them apart.
    """
    cleaning.require_columns(rows, key, text_column, timestamp_column)
    joined = _joined(rows, predictions, corpus, text_column, timestamp_column, key)
    joined = joined.persist(StorageLevel.MEMORY_AND_DISK)
    entries = _entries(joined, corpus, key, emotions_per_entry)
    counted = rows_of.exclude_sarcasm(joined, include_sarcasm)
    found = cloud = None
    if corpus is not None:
        found = keywords.keyword_scores(keywords.keyword_hits(counted, key=key))
        cloud = keywords.word_cloud(corpus.top_words, found)
    return Assembled(
        entries=entries,
        polarity_distribution=polarity.polarity_distribution(counted),
        intent_distribution=rows_of.intent_distribution(counted),
        sarcasm=rows_of.sarcasm_summary(joined),
        emotion_distribution=emotions.emotion_distribution(corpus.emotions) if corpus else None,
        keywords=found,
        word_cloud=cloud,
        topics=_topics(corpus, counted.select(key, "polarity"), key, topic_mode) if corpus and corpus.topic_terms is not None else None,
        trend=trend.monthly_trend(counted, WHEN) if timestamp_column else None,
        kept=joined,
    )


def _place(names: list[str], column: str):
    return F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column))


def summary_record(made: Assembled, job_id: str) -> DataFrame:
    """All aggregates of a job as one nested row, ready to store or to print as JSON."""

    def or_empty(df: DataFrame | None, kind: str, order: list, **fields: str):
        return F.array().cast(kind) if df is None else F.coalesce(listed(df, order, **fields), F.array().cast(kind))

    def as_map(rows, kind: str):
        return F.map_from_entries(rows.cast(f"array<struct<key:string,value:{kind}>>"))

    words = "array<struct<word:string,score:double>>"
    sides = {s: None if made.keywords is None else made.keywords.filter(F.col("side") == s) for s in ("positive", "negative")}
    profile = "positive:bigint,neutral:bigint,negative:bigint"
    topic_kind = f"array<struct<id:int,label:string,keywords:array<string>,{profile}>>"
    return made.entries.sparkSession.range(1).select(
        F.lit(job_id).alias("job_id"),
        as_map(listed(made.polarity_distribution, [_place(LEVELS, "polarity")], key="polarity", value="n"), "bigint")
        .alias("polarity_distribution"),
        as_map(
            or_empty(made.emotion_distribution, "array<struct<key:string,value:double>>",
                     [-F.col("share"), "emotion"], key="emotion", value="share"), "double",
        ).alias("emotion_distribution"),
        as_map(listed(made.intent_distribution, [_place(INTENTS, "intent")], key="intent", value="n"), "bigint")
        .alias("intent_distribution"),
        *[
            or_empty(sides[s], words, ["place"], word="word", score="score").alias(f"keywords_{s}")
            for s in ("positive", "negative")
        ],
        or_empty(made.topics, topic_kind, ["topic"], id="topic", label="label", keywords="terms",
                 positive="positive", neutral="neutral", negative="negative").alias("topics"),
        or_empty(made.trend, "array<struct<period:string,avg_polarity:double>>", ["period"],
                 period="period", avg_polarity="avg_polarity").alias("temporal_trend"),
        made.sarcasm.select("sarcasm_count").scalar().alias("sarcasm_count"),
        or_empty(made.word_cloud, "array<struct<word:string,weight:double>>", [-F.col("weight"), "word"],
                 word="word", weight="weight").alias("word_cloud"),
    )
