"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedback_spark.session import durable

# Fixed value: white space of the word rule, space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SLICE_ROWS = 512
SLICE_BYTES = 2_000_000
BATCH_ROWS = 1_024

Batches = Iterator[pa.RecordBatch]


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever the session was started.

    Batches of whole texts are kept small, since JVM and worker each hold some of them at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, columns: list[str], most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Batches:
    """``batch`` in runs of rows that hold at most so many rows and bytes of text in ``columns``, one row at least.

    They bound what a task holds at a time, whatever size of batch Spark sends and however long its texts are.
    """
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in columns:
        values = batch.column(name)
        if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
            sizes += pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + most_rows, max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def with_columns(
    df: DataFrame, inputs: list[str], added: str, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with the columns that ``work`` makes of each Arrow batch, less those in ``drop``.

    All other columns pass through untouched. A column of ``df`` that has the
    name of an added one is replaced.
    """
    extra = T._parse_datatype_string(added)
    kept = [c for c in df.columns if c not in extra.fieldNames() or c in inputs]
    out = [f for f in df.select(*kept).schema if f.name not in extra.fieldNames() and f.name not in drop] + list(extra)
    names = [f.name for f in out]

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, inputs):
                made = work(batch)
                arrays = [made[n] if n in made else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*kept).mapInArrow(run, T.StructType(out))


def text_key(text) -> "F.Column":
    """128 bits that stand for a text; null and empty text are alike."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def unused(df: DataFrame, name: str) -> str:
    """A working column name that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(values, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


__all__ = ["Batches", "WORD_PATTERN", "durable", "importable", "lists", "slices", "table", "text_key", "texts_of", "unused", "with_columns"]
