"""A whole job: rows to documents, scores, corpus result, stored entries and stored summary.

Entries lie in ``<store>/entries``, summaries in ``<store>/summaries``, both partitioned by job. A summary is one nested
row with the setting it was made under, so a reader knows whether sarcastic rows count in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedback_spark.operators import cleaning, entries as rows_of, scoring
from feedback_spark.plans import assemble as plan, corpus, partials
from feedback_spark.sources import store
from feedback_spark.sources.lexicons import Lexicons

# Fields of a stored summary's setting.
SETTING = ("include_sarcasm", "text_column", "timestamp_column", "topic_mode")


@dataclass(frozen=True)
class JobOptions:
    """How the rows of a job are read and what counts in its summary."""

    text_column: str
    timestamp_column: str | None = None
    label_column: str | None = None
    include_sarcasm: bool = True
    topic_mode: str = "global"
    with_topics: bool = True
    emotions_per_entry: bool = False


def counted_documents(documents: DataFrame, predictions: DataFrame, include_sarcasm: bool, key: str = "row_index") -> DataFrame:
    """The documents that words, emotions and topics are counted over: all, or those not flagged as sarcastic.

    The filter stands before every aggregate, so no part of a summary counts a flagged row that the others leave out.
    """
    if include_sarcasm or "sarcasm_flag" not in predictions.columns:
        return documents
    return documents.join(predictions.filter("sarcasm_flag").select(key), key, "left_anti")


def classified(rows: DataFrame, documents: DataFrame, options: JobOptions, key: str = "row_index") -> DataFrame:
    """Predictions of a classifier trained on the job's own labelled rows."""
    model = scoring.train_classifier(documents, "raw_text", "label")
    return scoring.predictions(scoring.score_texts(rows, model, options.text_column, key), key)


def analyse(
    rows: DataFrame, documents: DataFrame, predictions: DataFrame, lexicons: Lexicons, options: JobOptions, key: str = "row_index"
) -> tuple[plan.Assembled, corpus.CorpusResult]:
    """Corpus result and assembled parts under one setting. Release both once they have been stored."""
    counted = counted_documents(documents, predictions, options.include_sarcasm, key)
    result = corpus.corpus_analysis(counted, lexicons, key=key, with_topics=options.with_topics)
    made = plan.assemble(
        rows, predictions, result, text_column=options.text_column, timestamp_column=options.timestamp_column, key=key,
        include_sarcasm=options.include_sarcasm, topic_mode=options.topic_mode, emotions_per_entry=options.emotions_per_entry,
    )
    return made, result


def run_job(
    rows: DataFrame, lexicons: Lexicons, folder: str, job_id: str, options: JobOptions, predictions: DataFrame | None = None, key: str = "row_index"
) -> None:
    """Analyse keyed rows and store entries and summary of the job, in place of any it had.

    Without ``predictions`` a classifier is trained on the labelled rows.
    """
    documents = cleaning.build_documents(
        rows, options.text_column, key=key, labelled=options.label_column is not None, label_column=options.label_column
    )
    if predictions is None:
        predictions = classified(rows, documents, options, key)
    made, result = analyse(rows, documents, predictions, lexicons, options, key)
    entries = rows_of.entry_document(rows, made.entries, options.text_column, job_id, key)
    store.upsert_aggregates(entries, f"{folder}/entries", [job_id])
    _store_summary(made, folder, job_id, options)
    _store_partials(narrow_entries(made, rows, options, key), folder, job_id, options)
    made.release()
    result.release()


def narrow_entries(made: plan.Assembled, rows: DataFrame, options: JobOptions, key: str) -> DataFrame:
    """The narrow columns of all entries that partial counts need."""
    narrow = made.entries.select(key, "polarity", *[c for c in ("intent", "sarcasm_flag") if c in made.entries.columns])
    when = options.timestamp_column
    return narrow.join(rows.select(key, when), key) if when else narrow


def _store_partials(entries: DataFrame, folder: str, job_id: str, options: JobOptions) -> None:
    found = partials.partial_counts(entries, timestamp_column=options.timestamp_column).withColumn("job_id", F.lit(job_id))
    store.upsert_aggregates(found, f"{folder}/partials", [job_id])


def counts_under(spark: SparkSession, folder: str, job_id: str, include_sarcasm: bool) -> DataFrame:
    """(part, name, value) of a stored job under any sarcasm setting, from its partial counts alone."""
    stored = spark.read.parquet(f"{folder}/partials").filter(F.col("job_id") == job_id)
    return partials.summary(stored, include_sarcasm)


def _store_summary(made: plan.Assembled, folder: str, job_id: str, options: JobOptions) -> None:
    setting = F.struct(*[F.lit(getattr(options, f)).cast("boolean" if f == "include_sarcasm" else "string").alias(f) for f in SETTING])
    store.upsert_aggregates(plan.summary_record(made, job_id).withColumn("setting", setting), f"{folder}/summaries", [job_id])


def job_entries(spark: SparkSession, folder: str, job_id: str) -> DataFrame:
    return store.read_entries(spark, f"{folder}/entries", job_id)


def job_summary(spark: SparkSession, folder: str, job_id: str) -> DataFrame:
    """The stored nested summary of one job, with its setting."""
    return store.read_summary(spark, f"{folder}/summaries", job_id)


def resummarise(spark: SparkSession, lexicons: Lexicons, folder: str, job_id: str, options: JobOptions, key: str = "row_index") -> DataFrame:
    """The summary of a stored job under another setting, made anew from its entries and stored in place of the old one."""
    stored = job_entries(spark, folder, job_id)
    when = [F.col("original_row")[options.timestamp_column].alias(options.timestamp_column)] if options.timestamp_column else []
    rows = stored.select(key, F.col("original_text").alias(options.text_column), *when)
    predictions = stored.select(key, "polarity", "polarity_confidence", *plan.OPTIONAL)
    documents = cleaning.build_documents(rows, options.text_column, key=key)
    made, result = analyse(rows, documents, predictions, lexicons, options, key)
    _store_summary(made, folder, job_id, options)
    made.release()
    result.release()
    return job_summary(spark, folder, job_id)
