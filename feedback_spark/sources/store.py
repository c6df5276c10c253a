"""Stored results: entries, aggregates, JSON and annotated CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedback_spark.functions.shares import plain_number
from feedback_spark.session import drop_folder, durable

BOM = "\ufeff"


def write_entries(entries: DataFrame, path: str) -> None:
    """Append the entries of a job; the job is the partition readers prune by."""
    entries.write.mode("append").partitionBy("job_id").parquet(path)


def read_entries(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("job_id") == job_id)


def upsert_aggregates(aggregates: DataFrame, path: str, jobs: list[str] | None = None) -> None:
    """Replace the stored rows of the jobs that ``aggregates`` holds, and of all in ``jobs``.

    A job named in ``jobs`` that has no row left loses the rows it had. The new rows are made and written aside first, so
    that they may come from the store itself, and a write that fails leaves the old rows as they were; Spark swaps the
    folders of the jobs when the last task is done.
    """
    spark = aggregates.sparkSession
    made = durable(aggregates, "upsert")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)
    if jobs:
        left = {r.job_id for r in made.filter(F.col("job_id").isin(jobs)).select("job_id").distinct().collect()}  # at most ``jobs``
        name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for job in set(jobs) - left:
            drop_folder(spark, f"{path.rstrip('/')}/job_id={name(job)}")


def read_summary(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """The stored aggregates of one job."""
    return spark.read.parquet(path).filter(F.col("job_id") == job_id)


def as_json(df: DataFrame, *keep: str) -> DataFrame:
    """(…, json) with each row as one JSON text."""
    body = F.struct(*[c for c in df.columns if c not in keep])
    return df.select(*keep, F.to_json(body).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).select("json").write.mode("overwrite").text(path)


def plain_digits(value: Column) -> Column:
    """A double in plain digits; what has no such form within 18 digits before the point stays as Spark writes it."""
    return F.when(F.abs(value) < 1e18, plain_number(value)).otherwise(value.cast("string"))


def write_annotated_csv(annotated: DataFrame, path: str, key: str = "row_index") -> None:
    """CSV parts in key order, each headed and starting with a byte order mark.

    The mark is the first character of the first column's name, which puts it
    at the start of every part, and no part passes through a single task.
    """
    ordered = annotated.repartitionByRange(key).sortWithinPartitions(key).drop(key)
    # Spark writes small numbers as 5.0E-4; readers of the file expect 0.0005.
    ordered = ordered.select(*[
        plain_digits(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in ordered.schema
    ])
    first, *rest = ordered.columns
    (
        ordered.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in rest])
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
