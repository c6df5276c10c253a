"""Token counts from pieces per distinct pre-token.

The model (a SentencePiece BPE file) maps a space to a mark that starts a word, and no piece holds the mark
after another character. So a text with a space put in front falls apart at its spaces, and the pieces of a
text are those of its pre-tokens. No ids are made for whole texts.

1. Each task counts, per chunk of documents, how often each document holds each distinct pre-token, and deals the
   pre-tokens by hash into buckets. One row holds all pre-tokens of a chunk that fall into one bucket, packed. One more row
   per chunk names its documents, so the table is read once and nothing rests on two scans having equal partitions.
2. Rows meet by bucket. The pieces of each distinct pre-token of a bucket are counted once and joined to its
   frequencies. A pre-token that more than ``HOT_DOCUMENTS`` documents of a chunk hold is dealt by pre-token and chunk, so that
   the frequent ones, which are few, spread over all buckets instead of meeting in one.
3. Frequencies times pieces are added up per chunk in each task, and the partial sums meet the documents by chunk.

Defined cases: null and empty texts have no tokens; repeated rows are counted one by one, since a document is
known by its place in its chunk and not by its id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from feedback_spark.llm.frames import Batches, texts_of

# Fixed value: the model's mark for a space.
MARK = "▁"
# A chunk ends at either bound; places in it fit 16 bits.
CHUNK_CHARACTERS = 16_000_000
CHUNK_DOCUMENTS = 8_192
HOT_DOCUMENTS = 256
BUCKETS_PER_PARTITION = 4
# Pre-tokens a task remembers, and chunks it adds up, before it starts anew.
MOST_KEPT = 400_000
MOST_HELD = 1_024
RUNS = re.compile(r" [ ]*[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows, less their first space; a space stands before the text."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    words = text.split(" ")
    return words if all(words) else [run[1:] for run in RUNS.findall(" " + text)]


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(loaded.id_to_piece, range(loaded.get_piece_size())) if MARK in p.lstrip(MARK)]
    if inner:
        raise ValueError(f"pieces reach over words, such as {inner[0]}")
    return loaded


def piece_numbers(path: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The model itself puts the first space back."""
    loaded = model(path)
    counts = [len(ids) for ids in loaded.encode(tokens, num_threads=1)]
    if "" in tokens:  # a lone space, which the model cannot see as empty text
        alone = len(loaded.encode("\n")) - len(loaded.encode("x\n")) + len(loaded.encode("x"))
        counts = [c if t else alone for t, c in zip(tokens, counts)]
    return counts


class Numbers(dict):
    """Numbers of pre-tokens in order of first use."""

    def __missing__(self, token: str) -> int:
        value = self[token] = len(self)
        return value


# Either pre-tokens of a chunk or, in the last two columns, its documents.
MEMBERS = "doc_ids array<long>, sizes array<long>"
MEMBER_FIELDS = [("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
PACKED = f"bucket int, chunk long, names binary, name_sizes binary, documents binary, places binary, times binary, {MEMBERS}"
PACKED_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()),
    *[(n, pa.binary()) for n in ("names", "name_sizes", "documents", "places", "times")], *MEMBER_FIELDS,
])
PARTIAL = f"chunk long, places binary, sums binary, {MEMBERS}"
PARTIAL_SCHEMA = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), *MEMBER_FIELDS])


def chunks(batches: Batches, id_column: str, most_documents: int):
    """(chunk number, ids, texts) of a task's rows, cut by length alone."""
    part, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            for doc, text in zip(piece.column(id_column).to_pylist(), texts_of(piece, "text")):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= CHUNK_CHARACTERS or len(ids) == most_documents:
                    yield (part << 32) + number, ids, texts
                    number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield (part << 32) + number, ids, texts


def frequencies(docs: DataFrame, id_column: str, buckets: int) -> DataFrame:
    """Packed rows per chunk and bucket: UTF-8 names with their sizes, documents per name, places (16 bits) and times (32 bits).

    One further row per chunk has the ids of its documents by place and their sizes in UTF-8 bytes.
    """

    def run(batches: Batches) -> Batches:
        for chunk, ids, texts in chunks(batches, id_column, CHUNK_DOCUMENTS):
            sizes = [len(t.encode()) for t in texts]
            spread = xxhash.xxh64_intdigest(chunk.to_bytes(8, "little")) % buckets
            yield pa.RecordBatch.from_pylist([{"bucket": spread, "chunk": chunk, "doc_ids": ids, "sizes": sizes}], schema=PACKED_SCHEMA)
            number = Numbers()
            cut = []
            for text in texts:
                words = pre_tokens(text)
                cut.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            n = len(texts)
            sizes = [len(c) for c in cut]
            found, times = np.unique(np.concatenate(cut) * n + np.repeat(np.arange(n), sizes), return_counts=True)
            token, places = np.divmod(found, n)
            documents = np.bincount(token, minlength=len(number))
            names = [t.encode() for t in number]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
            hashes[documents > HOT_DOCUMENTS] += np.uint64(xxhash.xxh64_intdigest(chunk.to_bytes(8, "little")))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            starts = np.cumsum(documents) - documents
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
            for a, b in zip(edges, edges[1:]):
                own = order[a:b]
                run_of = documents[own]
                at = np.arange(run_of.sum()) - np.repeat(np.cumsum(run_of) - run_of, run_of) + np.repeat(starts[own], run_of)
                part = [names[i] for i in own.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "bucket": [int(bucket[own[0]])], "chunk": [chunk], "names": [b"".join(part)],
                    "name_sizes": [np.array(list(map(len, part)), "<u4").tobytes()], "documents": [run_of.astype("<u4").tobytes()],
                    "places": [places[at].astype("<u2").tobytes()], "times": [times[at].astype("<u4").tobytes()],
                    "doc_ids": [None], "sizes": [None],
                }, schema=PACKED_SCHEMA)

    return docs.mapInArrow(run, PACKED)


def partial_sums(packed: DataFrame, path: str) -> DataFrame:
    """PARTIAL: times by pieces, added up per chunk and task; each distinct pre-token is counted once. Documents pass."""

    def run(batches: Batches) -> Batches:
        pieces: dict[bytes, int] = {}
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_ids"] is not None:
                    yield pa.RecordBatch.from_pylist([{n: row[n] for n in ("chunk", "doc_ids", "sizes")}], schema=PARTIAL_SCHEMA)
                    continue
                ends = np.cumsum(np.frombuffer(row["name_sizes"], "<u4"), dtype=np.int64).tolist()
                names = [row["names"][a:b] for a, b in zip([0, *ends], ends)]
                if len(pieces) > MOST_KEPT:
                    pieces = {}
                new = [n for n in names if n not in pieces]
                if new:
                    pieces.update(zip(new, piece_numbers(path, [n.decode() for n in new])))
                each = np.repeat(np.fromiter(map(pieces.__getitem__, names), np.int64, len(names)), np.frombuffer(row["documents"], "<u4"))
                added = np.bincount(np.frombuffer(row["places"], "<u2"), np.frombuffer(row["times"], "<u4") * each, CHUNK_DOCUMENTS).astype(np.int64)
                chunk = row["chunk"]
                held[chunk] = held[chunk] + added if chunk in held else added
                if len(held) >= MOST_HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        places = {c: np.flatnonzero(v) for c, v in held.items()}
        return pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int64()),
            pa.array([p.astype("<u2").tobytes() for p in places.values()], pa.binary()),
            pa.array([held[c][p].astype("<i8").tobytes() for c, p in places.items()], pa.binary()),
            *[pa.nulls(len(held), kind) for _, kind in MEMBER_FIELDS],
        ], schema=PARTIAL_SCHEMA)

    return packed.mapInArrow(run, PARTIAL)


def sums(partials: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): the documents and partial sums of a chunk come to one task one after another."""

    def run(batches: Batches) -> Batches:
        current, total, documents = None, None, None
        for batch in batches:
            for chunk, places, values, *members in zip(*(batch.column(n).to_pylist() for n in PARTIAL_SCHEMA.names)):
                if chunk != current:
                    if current is not None:
                        yield rows(*documents, total)
                    current, total = chunk, np.zeros(CHUNK_DOCUMENTS, np.int64)
                if places is None:
                    documents = members
                else:
                    total[np.frombuffer(places, "<u2")] += np.frombuffer(values, "<i8")
        if current is not None:
            yield rows(*documents, total)

    def rows(ids: list[int], sizes: list[int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total[: len(ids)])],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    ordered = partials.repartition("chunk").sortWithinPartitions("chunk")
    return ordered.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``df``, which is read once."""
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = frequencies(docs, "doc_id", buckets).repartition("bucket")
    return sums(partial_sums(packed, path))
