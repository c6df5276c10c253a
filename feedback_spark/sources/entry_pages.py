"""Entries stored so that any page or entry is found by opening a few files.

Files hold runs of keys in order. A directory beside them has one row per file: its job, first and last key, number of rows
and number of rows before it in its job. A page reads the files its directory rows name; skipping costs nothing, however
deep the page lies. Files carry Bloom filters of the key for readers that do not use the directory.

Defined cases: rows without a job are kept under Spark's default partition and found with ``job_id=None``; rows without a
key come first, as in ``entries.entries_page``; a page past the end and an unknown job are empty; writing a job again replaces it.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedback_spark.operators.entries import PAGE_LIMIT, PAGE_LIMIT_MAX

# Names that begin with an underscore are not data to Spark's readers.
DIRECTORY = "_directory"


def _directory_path(path: str) -> str:
    return f"{path.rstrip('/')}/{DIRECTORY}"


def write_pages(entries: DataFrame, path: str, key: str = "row_index", files: int | None = None) -> None:
    """Store the jobs of ``entries`` (with a column ``job_id``) in place of what the store has of them.

    One shuffle ranges the rows by job and key; ``files`` is the number of ranges, by default that of shuffle partitions.
    The directory reads the key column alone. It is written last: a job whose files were replaced by a write that died
    before that is found again by writing it again, or by ``refresh_directory``.
    """
    spark = entries.sparkSession
    by = [F.col("job_id"), F.col(key)]
    ranged = entries.repartitionByRange(files, *by) if files else entries.repartitionByRange(*by)
    (
        ranged.sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("job_id").parquet(path)
    )
    refresh_directory(spark, path, key)


def refresh_directory(spark: SparkSession, path: str, key: str = "row_index") -> None:
    """Make the directory of all files of the store."""
    stored = spark.read.parquet(path).select("job_id", key, F.col("_metadata.file_path").alias("file"))
    of = Window.partitionBy("job_id").orderBy(F.asc_nulls_first("first"), "file")
    # One row per file from here on.
    listed = stored.groupBy("job_id", "file").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("unkeyed")
    )
    placed = listed.withColumn("first", F.when(F.col("unkeyed") == 0, F.col("first")))
    before = F.sum("rows").over(of.rowsBetween(Window.unboundedPreceding, -1))
    placed.withColumn("before", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(_directory_path(path))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, file, first, last, rows, unkeyed, before); ``first`` is null where a file holds rows without a key."""
    return spark.read.parquet(_directory_path(path))


def _files(spark: SparkSession, path: str, job_id: str | None, condition) -> tuple[DataFrame, int]:
    """(rows of the job's files that meet ``condition``, rows of the job before them)."""
    of_job = F.col("job_id").eqNullSafe(F.lit(job_id))
    named = directory(spark, path).filter(of_job & condition).select("file", "before").collect()
    if not named:
        return spark.read.parquet(path).filter(F.lit(False)), 0
    files = [unquote(r.file) for r in named]
    rows = spark.read.schema(spark.read.parquet(path).schema).option("basePath", path).parquet(*files)
    return rows, min(r.before for r in named)


def stored_page(
    spark: SparkSession, path: str, job_id: str | None, page: int = 1, limit: int = PAGE_LIMIT, key: str = "row_index"
) -> DataFrame:
    """Page ``page`` of a job by key order; opens at most ``limit`` files, as each holds a row at least."""
    if page < 1 or not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"page starts at 1 and limit is 1 to {PAGE_LIMIT_MAX}")
    start = (page - 1) * limit
    rows, before = _files(spark, path, job_id, (F.col("before") < start + limit) & (F.col("before") + F.col("rows") > start))
    return rows.orderBy(F.asc_nulls_first(key)).offset(max(0, start - before)).limit(limit)


def stored_entry(spark: SparkSession, path: str, job_id: str | None, value: int, key: str = "row_index") -> DataFrame:
    """The entries of a job with that key: one file as a rule, two where a run of equal keys crosses a border."""
    inside = (F.col("first").isNull() | (F.col("first") <= value)) & (F.col("last") >= value)
    rows, _ = _files(spark, path, job_id, inside)
    return rows.filter(F.col(key) == value)


def stored_total(spark: SparkSession, path: str, job_id: str | None) -> DataFrame:
    """(total) of a job, from the directory alone."""
    own = directory(spark, path).filter(F.col("job_id").eqNullSafe(F.lit(job_id)))
    return own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
