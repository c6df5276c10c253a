"""CSV feedback files: layout, encoding, trimmed string columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from feedback_spark.functions.text import if_kept, strip
from feedback_spark.sources import csv_records
from feedback_spark.session import durable

# First cells that mark a header, and second cells that mark data.
HEADER_NAMES = ["raw_text", "text", "comment", "content", "review", "label", "id", "date", "timestamp"]
LABEL_VALUES = ["pos", "neg", "neutral", "positive", "negative"]
HEADERLESS_SCHEMA = ["raw_text", "label"]
# Where the reader puts a record whose cells do not match the columns.
SHORT_RECORD = "_short_record"
BOM = "\ufeff"
TEXT_NAMES = "(?i)text|comment|review|body|content"
DATE_NAMES = "(?i)date|time|created|timestamp"


@dataclass(frozen=True)
class Layout:
    header: bool
    columns: list[str]


def _reader(spark: SparkSession, encoding: str, header: bool):
    return (
        spark.read.option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
    )


def looks_headerless(cells: Column) -> Column:
    """Whether a first record, as an array of cells, is already data."""
    first, second = strip(F.get(cells, F.lit(0))), F.lower(strip(F.get(cells, F.lit(1))))
    return F.coalesce(
        (F.size(cells) == 2)
        & (first != "")
        & second.isin(LABEL_VALUES)
        & ~F.lower(first).isin(HEADER_NAMES),
        F.lit(False),
    )


def _as_utf8(cell: Column) -> Column:
    return F.encode(cell, "ISO-8859-1").cast("string")


def _decoded_cell(cell: Column, utf8: Column) -> Column:
    return F.when(utf8, _as_utf8(cell)).otherwise(cell)


def _decoded(cells: Column, utf8: Column) -> Column:
    return F.transform(cells, lambda c: _decoded_cell(c, utf8))


def file_layouts(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """(file, first, utf8, headed, names) of every file: encoding and header decided per file.

    A file is UTF-8 when all its bytes are valid, else latin-1. ``first`` is the place of its first record. ``names`` are
    the trimmed column names, blank for a column without a name and for all but the last of a repeated name. Files come
    and go by expression; their names never pass through the driver.
    """
    return _layouts(csv_records.with_states(csv_records.stored_lines(spark, path, multi_line)), multi_line)[0]


def _layouts(chunks: DataFrame, multi_line: bool) -> tuple[DataFrame, int]:
    """(layouts, most columns of a first record); only the chunks of first records are cut."""
    encodings = chunks.groupBy("file").agg(F.bool_and("utf8").alias("utf8"))
    first = csv_records.cut(csv_records.first_chunks(chunks), multi_line).groupBy("file").agg(
        F.min("place").alias("first"), F.min_by("record", "place").alias("raw")
    )
    found = durable(first.join(encodings, "file"), "first_records")
    width = found.agg(F.max(csv_records.cell_count(F.col("raw")))).first()[0] or 1
    parsed = csv_records.cells_of(F.col("raw"), width, SHORT_RECORD)
    own = F.struct(F.array(*[F.col(f"parsed.c{i}") for i in range(width)]).alias("cells"), F.col(f"parsed.{SHORT_RECORD}").alias("short"))
    found = found.withColumn("parsed", parsed).withColumn("record", own).drop("parsed", "raw")
    cells = _decoded(F.transform("record.cells", lambda c: F.coalesce(c, F.lit(""))), F.col("utf8"))
    held = found.withColumn("cells", F.transform(cells, lambda c, i: F.when(i == 0, F.ltrim(c, F.lit(BOM))).otherwise(c)))
    # Cells that the record does not have are no cells of it.
    own = F.filter("cells", lambda c, i: F.get("record.cells", i).isNotNull() | F.col("record.short").isNull())
    headless = looks_headerless(own)
    names = F.transform("cells", lambda c: strip(c))
    kept = F.transform(names, lambda c, i: F.when(F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), c), "").otherwise(c))
    fixed = F.array(*[F.lit(c) for c in HEADERLESS_SCHEMA])
    return held.select(
        "file", "first", "utf8", (~headless).alias("headed"), F.when(headless, fixed).otherwise(kept).alias("names")
    ), width


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    layout: Layout | None = None,
    encoding: str = "auto",
    keep_file: bool = False,
    limit: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Trimmed string columns of the files, blank rows dropped.

    Encoding and header are decided for each file, so files of one folder may differ in both; columns meet
    by name, and a file without a column has blanks there. Files of any size are read in splits, also with line breaks
    inside quotes. ``multi_line=False`` takes every line for a record; with ``layout`` and ``encoding`` given as well, the files
    are read in one plain scan. ``keep_file`` adds ``source_file`` and ``source_place``, the record's order in it. ``limit`` is a
    plain row limit, off by default.
    """
    if layout is not None and encoding != "auto" and not multi_line:
        rows = _read_alike(spark, path, layout, encoding, keep_file)
        return rows.limit(limit) if limit is not None else rows
    chunks = csv_records.with_states(csv_records.stored_lines(spark, path, multi_line))
    files, width = _layouts(chunks, multi_line)
    files = durable(files, "layouts")
    if layout is not None:
        given = F.array(*[F.lit(c) for c in layout.columns])
        files = files.withColumn("headed", F.lit(layout.header)).withColumn("names", given)
    if encoding != "auto":
        files = files.withColumn("utf8", F.lit(encoding.upper().replace("-", "") == "UTF8"))
    # One row per different header.
    shapes = files.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()
    if not shapes:
        raise ValueError("CSV is empty")
    columns = list(dict.fromkeys(c for shape in shapes for c in shape.names if c))
    if not columns:
        raise ValueError("CSV has no header row")
    # Where each column stands in a file, worked out per file and not per record.
    order = F.array(*[F.array_position("names", F.lit(c)).cast("int") - 1 for c in columns])
    files = files.select(F.col("file").alias("_file"), "first", "utf8", "headed", order.alias("order"))
    records = csv_records.cut(chunks, multi_line).join(files, F.col("file") == F.col("_file"))
    first = F.col("place") == F.col("first")
    # A plain filter on cells is pushed down to the record and cuts it again for every cell it names, so both filters on cells
    # are explodes of what is left (see ``text.if_kept``). Without a header a record of a single cell is left out, unlike one whose
    # second cell is blank.
    size = max(width, len(columns))
    parsed = records.filter(~(F.col("headed") & first)).withColumn("parsed", csv_records.cells_of(F.col("record"), size, SHORT_RECORD))
    second = F.col("parsed.c1") if size > 1 else F.lit(None).cast("string")
    single = ~F.col("headed") & second.isNull() & F.col(f"parsed.{SHORT_RECORD}").isNotNull()
    body = parsed.withColumn("single", single).withColumn("cells", F.array(*[F.col(f"parsed.c{i}") for i in range(size)]))
    body = body.withColumn("cells", F.explode(if_kept(F.col("cells"), lambda c: ~F.col("single"))))

    def cell(i: int) -> Column:
        at = F.get("order", F.lit(i))
        shown = _decoded_cell(F.get("cells", at), F.col("utf8"))
        return strip(F.coalesce(F.when(first & (at == 0), F.ltrim(shown, F.lit(BOM))).otherwise(shown), F.lit("")))

    body = body.withColumn("picked", F.array(*[cell(i) for i in range(len(columns))]))
    body = body.withColumn("picked", F.explode(if_kept(F.col("picked"), lambda p: F.exists(p, lambda x: x != ""))))
    source = [F.col("file").alias("source_file"), F.col("place").alias("source_place")] if keep_file else []
    rows = body.select(*[F.get("picked", F.lit(i)).alias(c) for i, c in enumerate(columns)], *source)
    return rows.limit(limit) if limit is not None else rows


def _read_alike(spark, path, layout: Layout, encoding: str, keep_file: bool) -> DataFrame:
    """Files of one given layout and encoding, by position."""
    # Unnamed columns, and all but the last of a repeated name, get a name to be dropped by.
    kept = [c if c and c not in layout.columns[i + 1:] else "" for i, c in enumerate(layout.columns)]
    fields = [c or f"_unnamed{i}" for i, c in enumerate(kept)]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, SHORT_RECORD]])
    reader = _reader(spark, encoding, layout.header).option("columnNameOfCorruptRecord", SHORT_RECORD)
    raw = reader.schema(schema).csv(path)
    if not layout.header:
        # A record of a single cell is left out, unlike one whose second cell is blank.
        raw = raw.filter(F.col(fields[-1]).isNotNull() | F.col(SHORT_RECORD).isNull())
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    source = [F.col("_metadata.file_path").alias("source_file"), place.alias("source_place")] if keep_file else []
    named = [c for c in kept if c]
    cells = [strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in named]
    return drop_blank_rows(raw.select(*cells, *source), named)


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with at least one non-empty cell."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns])
    return df.filter(F.exists(cells, lambda x: x != ""))


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself, or an error when it holds no row; looks at one row."""
    if df.isEmpty():
        raise ValueError("CSV contains no data rows")
    return df


def row_cap(df: DataFrame, limit: int | None, key: str = "row_index") -> DataFrame:
    """The first ``limit`` rows by key, or all of them."""
    return df if limit is None else df.orderBy(key).limit(limit)


def guess_columns(columns: DataFrame, *by: str) -> DataFrame:
    """(…, text_column, date_column) from rows of (…, name, pos).

    The text column is the first name that looks like text, else the first
    name; the date column the first that looks like a date, else none.

    Spark sorts all rows for an aggregate that holds names. So names that no group can choose are left out before: those that look like
    neither and stand behind the last of all first places, which a narrow aggregate gives.
    """
    last_first = columns.groupBy(*by).agg(F.min("pos").alias("first")).agg(F.max("first").alias("first")).scalar()
    chosen = F.col("name").rlike(TEXT_NAMES) | F.col("name").rlike(DATE_NAMES) | (F.col("pos") <= last_first) | F.col("pos").isNull()

    def first_like(pattern: str) -> Column:
        return F.min_by("name", F.when(F.col("name").rlike(pattern), F.col("pos")))

    return columns.filter(chosen).groupBy(*by).agg(
        F.coalesce(first_like(TEXT_NAMES), F.min_by("name", "pos")).alias("text_column"),
        first_like(DATE_NAMES).alias("date_column"),
    )


def column_names(df: DataFrame) -> DataFrame:
    """(name, pos) of a frame's columns, for ``guess_columns``."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.sparkSession.range(1).select(F.posexplode(names).alias("pos", "name"))


def dataset_profile(df: DataFrame, filename: str) -> DataFrame:
    """One row: file name, rows, columns, time of the look."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(filename).alias("filename"),
        "row_count",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.current_timestamp().alias("uploaded_at"),
    )


def preview_rows(df: DataFrame, key: str = "row_index", rows: int = 5) -> DataFrame:
    return df.orderBy(key).limit(rows)
