"""Consecutive row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedback_spark.session import durable


def _numbered(staged: DataFrame, name: str) -> DataFrame:
    """Number stored rows (…, part, pos) by ``part`` then ``pos``.

    Only the count of each part is brought together: as many rows as there
    were partitions. They are joined without a hint, so Spark broadcasts them
    by their bytes or joins by a shuffle.
    """
    sizes = staged.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("base"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "base", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return (
        staged.join(offsets, "part")
        .withColumn(name, F.col("before") + F.col("pos") - F.col("base"))
        .drop("part", "pos", "base", "before")
    )


def row_index(df: DataFrame, *order_by: str, name: str = "row_index") -> DataFrame:
    """(order_by…, row_index): the 0-based place of each key.

    Only the key columns are range-partitioned and stored; a caller that needs
    more joins the numbers back by key. Many rows of one leading value are
    split by the later columns of the order.
    """
    ranged = df.select(*order_by).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    staged = durable(
        ranged.select(*order_by, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")),
        "row_index",
    )
    return _numbered(staged, name)


def file_row_index(df: DataFrame, name: str = "row_index", file: str = "source_file", place: str = "source_place") -> DataFrame:
    """All other columns and the 0-based place in the order of files and of the records in them.

    For rows of ``read_csv`` with ``keep_file``. They are ranged by file and place, so a file of any size spreads,
    and stored once with their place in their partition, so that counting and numbering see the same partitions; the
    store is columnar and the count reads one column of it.
    """
    ordered = df.repartitionByRange(file, place).sortWithinPartitions(file, place).drop(file, place)
    staged = durable(
        ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "file_rows"
    )
    return _numbered(staged, name)
