"""Annotated rows: building, filtering, paging, joining and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.functions import labels, shares, text
from feedback_spark.functions.numbers import whole_percent
from feedback_spark.operators.polarity import bucket_counts

# Thresholds and page sizes.
EMOTION_THRESHOLD = 0.3
LOW_CONFIDENCE = 0.6
FIRST_ENTRIES = 20
PAGE_LIMIT = 20
PAGE_LIMIT_MAX = 100

ASPECTS = "array<struct<term:string,sentiment:string,score:double>>"
TOPICS = "array<struct<topic_id:int,weight:double>>"


def rows_predictions(rows: DataFrame, predictions: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows with their predictions by key; a row or prediction alone is left out."""
    return rows.join(predictions, key)


def entries_with_emotions(entries: DataFrame, emotions: DataFrame) -> DataFrame:
    """Every entry with the corpus map, read as a scalar subquery of the one-row frame."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:double>>"))
    return entries.withColumn("emotions", F.coalesce(emotions.scalar(), empty))


def entry_document(
    rows: DataFrame, entries: DataFrame, text_column: str, job_id: str, key: str = "row_index"
) -> DataFrame:
    """Entries with the original text and the original row as a map."""
    source = [c for c in rows.columns if c != key]
    joined = entries.join(rows.select(key, F.struct(*source).alias("_row")), key)
    cells = [x for c in source for x in (F.lit(c), F.col("_row")[c].cast("string"))]
    # Built after the join, so that the text crosses the shuffle once.
    return joined.select(
        *entries.columns,
        F.coalesce(F.col("_row")[text_column], F.lit("")).alias("original_text"),
        F.create_map(*cells).alias("original_row"),
        F.lit(job_id).alias("job_id"),
    )


def entries_filter(
    entries: DataFrame,
    *,
    polarity: str | None = None,
    group: str | None = None,
    intent: str | None = None,
    sarcasm: bool | None = None,
    emotion: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Rows that meet every given condition; an absent one does not filter."""
    conditions: list[Column] = []
    if polarity:
        conditions.append(F.col("polarity") == polarity)
    if group:
        conditions.append(labels.polarity_group(F.col("polarity")) == group)
    if intent:
        conditions.append(F.col("intent") == intent)
    if sarcasm is not None:
        conditions.append(F.col("sarcasm_flag") == F.lit(sarcasm))
    if emotion:
        conditions.append(F.try_element_at("emotions", F.lit(emotion)) >= EMOTION_THRESHOLD)
    if min_confidence is not None:
        conditions.append(F.col("polarity_confidence") >= min_confidence)
    for condition in conditions:
        entries = entries.filter(condition)
    return entries


def exclude_sarcasm(entries: DataFrame, include: bool) -> DataFrame:
    """All entries, or only those not flagged when the setting leaves sarcasm out."""
    return entries if include else entries.filter(~F.col("sarcasm_flag"))


def entry_lookup(entries: DataFrame, job_id: str, row_index: int) -> DataFrame:
    """One entry; the job prunes partitions, the key is pushed to the scan."""
    return entries.filter((F.col("job_id") == job_id) & (F.col("row_index") == row_index))


def entries_ordered(entries: DataFrame, key: str = "row_index") -> DataFrame:
    return entries.orderBy(key)


def entries_page(entries: DataFrame, page: int = 1, limit: int = PAGE_LIMIT, key: str = "row_index") -> DataFrame:
    """Page ``page`` by key order. Skipping grows with the page; see ``entries_after``."""
    if page < 1 or not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"page starts at 1 and limit is 1 to {PAGE_LIMIT_MAX}")
    return entries.orderBy(key).offset((page - 1) * limit).limit(limit)


def entries_after(entries: DataFrame, last: int, limit: int = PAGE_LIMIT, key: str = "row_index") -> DataFrame:
    """The page after key ``last``: a pushed filter and a top-k, whatever the depth."""
    return entries.filter(F.col(key) > last).orderBy(key).limit(limit)


def entries_total(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("total"))


def merge_sarcastic(
    entries: DataFrame, shown: int = PAGE_LIMIT_MAX, sarcastic: int | None = None, key: str = "row_index"
) -> DataFrame:
    """The first page together with the sarcastic entries, no key twice.

    The page holds the smallest keys, so the flagged entries it lacks are those
    with a larger key: a filter, where dropping duplicates would shuffle them all.
    """
    first = entries.orderBy(key).limit(shown)
    flagged = entries.filter("sarcasm_flag")
    if sarcastic is not None:
        flagged = flagged.orderBy(key).limit(sarcastic)
    last = first.agg(F.max(key)).scalar()
    return first.unionByName(flagged.filter(F.col(key) > last))


def low_confidence(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("polarity_confidence") < LOW_CONFIDENCE)


def first_entries(entries: DataFrame, key: str = "row_index") -> DataFrame:
    return entries.orderBy(key).limit(FIRST_ENTRIES)


def confidence_table(entries: DataFrame, text_column: str = "original_text", key: str = "row_index") -> DataFrame:
    """One display line per entry."""
    low = F.col("polarity_confidence") < LOW_CONFIDENCE
    dominant = shares.dominant(F.col("emotions"))
    dash = F.lit("—")
    return entries.select(
        key,
        text.truncate(F.col(text_column)).alias("entry"),
        "polarity",
        F.when(dominant == "", dash).otherwise(shares.emotion_name(dominant)).alias("emotion"),
        labels.intent_label(F.col("intent")).alias("intent"),
        F.floor(F.col("polarity_confidence") * 100 + 0.5).cast("long").alias("confidence_pct"),
        F.when(F.col("sarcasm_flag"), "Sarcasm").when(low, "Low").otherwise(dash).alias("flag"),
    )


def confidence_stats(entries: DataFrame) -> DataFrame:
    """Mean confidence in whole percent and number below the limit, over all entries."""
    # Confidences have four digits. Their sum in whole ten-thousandths is exact, and the mean is rounded once.
    parts = F.coalesce(F.sum(F.rint(F.col("polarity_confidence") * 10_000).cast("long")), F.lit(0))
    rows = F.greatest(F.count("polarity_confidence"), F.lit(1))
    return entries.agg(
        F.floor((parts + rows * 50) / (rows * 100)).cast("long").alias("avg_confidence_pct"),
        F.count_if(F.col("polarity_confidence") < LOW_CONFIDENCE).alias("low_count"),
    )


def intent_distribution(entries: DataFrame) -> DataFrame:
    return bucket_counts(entries, "intent", labels.INTENTS, "intent").drop("at")


def sarcasm_summary(entries: DataFrame) -> DataFrame:
    flagged = entries.agg(
        F.count_if(F.col("sarcasm_flag")).alias("sarcasm_count"), F.count(F.lit(1)).alias("entries")
    )
    return flagged.withColumn("sarcasm_pct", whole_percent(F.col("sarcasm_count"), F.col("entries")))


def exploded_aspects(entries: DataFrame, key: str = "row_index") -> DataFrame:
    return entries.select(key, F.inline("aspects"))


def aspect_table(entries: DataFrame) -> DataFrame:
    """Per term: mentions, whole percent by side, scaled mean score; best score first."""
    tone = F.lower("sentiment")
    positive = F.contains(tone, F.lit("positive"))
    negative = ~positive & F.contains(tone, F.lit("negative"))
    sums = entries.select(F.inline("aspects")).groupBy("term").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(positive).alias("pos"),
        F.count_if(negative).alias("neg"),
        F.sum(F.col("score").cast("decimal(18,9)")).alias("total"),
    )
    mentions = F.col("mentions")
    return sums.select(
        "term",
        "mentions",
        whole_percent(F.col("pos"), mentions).alias("positive_pct"),
        whole_percent(mentions - F.col("pos") - F.col("neg"), mentions).alias("neutral_pct"),
        whole_percent(F.col("neg"), mentions).alias("negative_pct"),
        # Half of the mean plus one, in percent: rounded once, from an exact sum.
        F.floor((F.col("total") * 50 / mentions + F.lit(50.5).cast("decimal(4,1)"))).cast("long").alias("score_pct"),
    ).orderBy(F.desc("score_pct"), "term")


def aspect_distinct(entries: DataFrame) -> DataFrame:
    terms = entries.select(F.inline("aspects")).select("term").distinct()
    return terms.agg(F.count(F.lit(1)).alias("aspects"))


def job_dataset(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    return jobs.join(datasets, "dataset_id")


# Names of the added columns, under a prefix of the caller's choice.
ANNOTATIONS = [
    "polarity", "polarity_confidence", "intent", "sarcasm_flag", "sarcasm_confidence",
    "dominant_emotion", "emotion_scores",
]


def annotated_rows(
    rows: DataFrame, entries: DataFrame, prefix: str = "feedback_", key: str = "row_index"
) -> DataFrame:
    """Every source row with its seven annotations, blank for a row without an entry.

    The flag is written as the text True or False, as exports show it.
    """
    notes = entries.withColumn("sarcasm_flag", F.initcap(F.col("sarcasm_flag").cast("string"))).select(
        key,
        *[F.col(c).alias(prefix + c) for c in ANNOTATIONS[:5]],
        shares.dominant(F.col("emotions")).alias(prefix + "dominant_emotion"),
        shares.shares_text(F.col("emotions")).alias(prefix + "emotion_scores"),
    )
    return rows.join(notes, key, "left")
