"""Records of CSV files read in splits, line breaks inside quotes included.

1. Spark's line scan reads the files in splits, however large one file is. Each task stores its lines, as they are, in chunks of
   about ``CHUNK_BYTES`` with (file, block, chunk). All later steps read this store, so it does not matter how another scan
   would pack the files, and a lost executor costs one task.
2. Whether a line begins inside quotes depends on all lines before it. So each line is looked at under both start states: the end state
   is the same for both, or kept, or swapped. These maps compose; a chunk's map is two flags. With it are stored the lines at which
   records begin under either state.
3. The start state of every chunk is the prefix of the maps before it: a window over one narrow row per chunk.
4. With its start state each chunk is cut by itself, by expressions: Python workers would be sent many chunks in one Arrow batch. The
   open end of a chunk and the lines that continue it in later chunks are joined by the place of the record's first line; only these
   pieces are shuffled.

A cell is quoted when its first character is a quote; two quotes inside it stand for one; what follows the closing quote up to the next
comma belongs to the cell. Records keep the line breaks inside their quotes (``\\n`` or ``\\r\\n``); empty lines between records are no
records; an unclosed quote runs to the end of the file. Bytes are held as latin-1 characters until the encoding is known. An empty
folder or file has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedback_spark.session import by_value, durable

by_value(__name__)

CHUNK_BYTES = 4_000_000

# A cell from a record's start or a comma up to the next comma, its quotes closed.
CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*)?'
CLOSED_FROM_OUTSIDE = f"^{CELL}(?:,{CELL})*$"
CLOSED_FROM_INSIDE = rf'^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{CELL})*$'

STORED = (
    "file string, block long, chunk int, lines array<binary>, utf8 boolean, "
    "inside_from_outside boolean, inside_from_inside boolean, starts_from_outside boolean, starts_from_inside boolean, "
    "begins_from_outside array<int>, begins_from_inside array<int>"
)


def line_maps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether it ends inside quotes: (begun outside, begun inside)."""
    plain = ~pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(~plain)
    if len(quoted):
        some = lines.take(pa.array(quoted))
        for ends, pattern in ((outside, CLOSED_FROM_OUTSIDE), (inside, CLOSED_FROM_INSIDE)):
            ends[quoted] = ~pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return outside, inside


def states_after(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The state behind each line, from the state before the first: that of the last line that fixes it, swapped by those since."""
    swaps = np.cumsum(outside & ~inside) % 2
    fixing = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    known = outside[fixing] ^ ((swaps ^ swaps[fixing]) == 1)
    return np.where(fixing >= 0, known, start ^ (swaps == 1))


def states_before(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    return np.concatenate([[start], states_after(outside, inside, start)[:-1]])


def stored_lines(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """The lines of the files in chunks; see the module's steps 1 and 2."""

    def chunk_row(file: str, block: int, chunk: int, parts: list[pa.Array]) -> pa.RecordBatch:
        lines = pa.concat_arrays(parts)
        outside, inside = line_maps(lines) if multi_line else (np.zeros(len(lines), bool),) * 2
        filled = pc.greater(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
        begins = [~states_before(outside, inside, start) for start in (False, True)]
        flags = [bool(states_after(outside, inside, start)[-1]) for start in (False, True)]
        flags += [bool((filled & begin).any()) for begin in begins]
        places = [np.flatnonzero(begin).astype("i4") for begin in begins]
        try:
            pa.ListArray.from_arrays([0, len(lines)], lines.cast(pa.string()))
            utf8 = True
        except pa.ArrowInvalid:
            utf8 = False
        values = [[file], [block], [chunk], pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), [utf8], *([f] for f in flags)]
        values += [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at)) for at in places]
        types = [pa.string(), pa.int64(), pa.int32(), None, pa.bool_(), *[pa.bool_()] * 4, None, None]
        arrays = [v if t is None else pa.array(v, t) for v, t in zip(values, types)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in STORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, parts, size = None, 0, [], 0
        for batch in batches:
            blocks, files = batch.column("block").to_numpy(), batch.column("file")
            cuts = [0] if batch.num_rows else []
            if batch.num_rows:
                changed = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                cuts += (np.flatnonzero(changed) + 1).tolist()
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
                here = (files[start].as_py(), int(blocks[start]))
                lines = batch.column("value").slice(start, stop - start)
                ends = np.cumsum(pc.binary_length(lines).to_numpy() + 1)
                # Cut where a chunk is full; a split never shares a chunk with another.
                done = 0
                while done < len(lines):
                    if here != at:
                        if parts:
                            yield chunk_row(*at, chunk, parts)
                        at, chunk, parts, size = here, 0, [], 0
                    before = int(ends[done - 1]) if done else 0
                    upto = min(len(lines), max(done + 1, int(np.searchsorted(ends, before + CHUNK_BYTES - size, "right"))))
                    parts.append(lines.slice(done, upto - done))
                    size += int(ends[upto - 1]) - before
                    done = upto
                    if size >= CHUNK_BYTES or done < len(lines):
                        yield chunk_row(*at, chunk, parts)
                        chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield chunk_row(*at, chunk, parts)

    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    return durable(lines.mapInArrow(run, STORED), "csv_lines")


def chunk_states(stored: DataFrame) -> DataFrame:
    """(file, block, chunk, inside, has_start, owner) of every chunk; ``owner`` is the last chunk before it in which a record begins."""
    order = Window.partitionBy("file").orderBy("block", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    a, b = F.col("inside_from_outside"), F.col("inside_from_inside")
    narrow = stored.select("file", "block", "chunk", (a & ~b).cast("int").alias("swap"), F.when(a == b, a).alias("fixed"),
                           "starts_from_outside", "starts_from_inside")
    counted = narrow.withColumn("swaps", F.sum("swap").over(order))
    fixed = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps")), ignorenulls=True).over(before)
    swaps = F.coalesce(F.sum("swap").over(before), F.lit(0))
    known = counted.withColumn("last_fixed", fixed).withColumn("swaps_before", swaps)
    parity = (F.col("swaps_before") - F.coalesce("last_fixed.swaps", F.lit(0))) % 2 == 1
    inside = F.coalesce("last_fixed.fixed", F.lit(False)) != parity
    stated = known.select("file", "block", "chunk", inside.alias("inside"), F.when(inside, F.col("starts_from_inside")).otherwise(F.col("starts_from_outside")).alias("has_start"))
    owner = F.last(F.when(F.col("has_start"), F.struct("block", "chunk")), ignorenulls=True).over(before)
    return stated.withColumn("owner", owner)


def cut(chunks: DataFrame, multi_line: bool = True) -> DataFrame:
    """(file, place, record) of chunks with their ``inside`` and ``owner``: whole records, and pieces joined by their owner."""
    place = F.struct("block", "chunk", "at").alias("place")
    whole = _whole(chunks).select("file", place, "record")
    if not multi_line:
        return _ended(whole)
    # Few chunks are cut a second time, those whose first or last line is part of a longer record, and only there.
    parts = F.sort_array(F.collect_list(F.struct("block", "chunk", "at", "record"))).alias("parts")
    # A record's pieces are as long as the record.
    joined = _open_ends(chunks.filter(F.col("inside") | _ends_inside())).groupBy("file", "owner").agg(parts)
    first = F.col("parts")[0]
    joined = joined.select(
        "file", F.struct(first["block"].alias("block"), first["chunk"].alias("chunk"), first["at"].alias("at")).alias("place"),
        F.array_join(F.col("parts.record"), "\n").alias("record"),
    )
    return _ended(whole.unionByName(joined))


def _ends_inside() -> Column:
    return F.when(F.col("inside"), F.col("inside_from_inside")).otherwise(F.col("inside_from_outside"))


def _begins() -> Column:
    """The places in a chunk of the lines at which records begin."""
    return F.when(F.col("inside"), F.col("begins_from_inside")).otherwise(F.col("begins_from_outside"))


def _text(start: Column, stop: Column) -> Column:
    """The lines of a chunk from ``start`` up to before ``stop``, as one text. Only these lines are decoded."""
    return F.array_join(F.transform(F.slice("lines", start + 1, stop - start), lambda line: F.decode(line, "ISO-8859-1")), "\n")


def _whole(chunks: DataFrame) -> DataFrame:
    """(file, block, chunk, at, record): the records of each chunk that end in it."""
    ended = F.slice(_begins(), F.lit(1), F.greatest(F.size(_begins()) - _ends_inside().cast("int"), F.lit(0)))
    stop = lambda i: F.coalesce(F.get(_begins(), i + 1), F.size("lines"))
    made = F.transform(ended, lambda at, i: F.struct(at.alias("at"), _text(at, stop(i)).alias("record")))
    return chunks.select("file", "block", "chunk", F.explode(made).alias("made")).select("file", "block", "chunk", "made.at", "made.record")


def _open_ends(chunks: DataFrame) -> DataFrame:
    """(file, block, chunk, owner, at, record): what goes on in a chunk belongs to the chunk where it began, what stays open to its own."""
    n = F.size("lines")
    head, last = F.coalesce(F.get(_begins(), F.lit(0)), n), F.get(_begins(), F.size(_begins()) - 1)
    own = F.struct("block", "chunk")
    going_on = F.struct(F.col("owner").alias("owner"), F.lit(-1).alias("at"), F.when(head > 0, _text(F.lit(0), head)).alias("record"))
    is_open = F.struct(own.alias("owner"), last.alias("at"), F.when(_ends_inside() & last.isNotNull(), _text(last, n)).alias("record"))
    made = chunks.select("file", "block", "chunk", F.explode(F.array(going_on, is_open)).alias("made"))
    return made.select("file", "block", "chunk", "made.owner", "made.at", "made.record").filter("record IS NOT NULL")


def _ended(records: DataFrame) -> DataFrame:
    """Without the carriage return of the line end, and without empty lines."""
    bare = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return records.withColumn("record", bare).filter("record != ''")


def with_states(stored: DataFrame) -> DataFrame:
    """``stored`` with each chunk's start state and owner. The states are one narrow row per chunk, stored so that their size is known."""
    states = durable(chunk_states(stored), "csv_states")
    return stored.join(states, ["file", "block", "chunk"])


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks that hold the first record of each file, all of it. Where these begin is stored too, so that no lines are shuffled for it."""
    key = F.struct("block", "chunk")
    first = durable(chunks.filter("has_start").groupBy("file").agg(F.min(key).alias("first_start")), "csv_starts")
    near = chunks.join(first, "file")
    return near.filter((key <= F.col("first_start")) | (F.col("inside") & (F.col("owner") == F.col("first_start")))).drop("first_start")


def cell_count(record: Column) -> Column:
    """How many cells a record has."""
    return F.regexp_count(F.regexp_replace(record, r'"(?:[^"]|"")*+"', ""), F.lit(",")) + 1


def cells_of(record: Column, width: int, short: str) -> Column:
    """The cells of a record, c0 and so on, and the whole record under ``short`` when it has another number of cells."""
    schema = ", ".join([*(f"c{i} string" for i in range(width)), f"{short} string"])
    return F.from_csv(record, schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": short})
