"""Token ids in files of canonical, length-limited Huffman codes.

1. Every whole text becomes ids with the tokenizers library; each distinct word
   of a task is encoded once. The ids are stored, since two later steps read them.
2. Ids are counted over all documents. The counts are as many as the vocabulary
   has ids, whatever the corpus size, so their table of code lengths (package-merge)
   is made on the driver and sent to the tasks.
3. Documents are ranged by ``doc_id`` and sorted. Each task cuts its run into blocks
   of whole documents and packs their codes. A block is decodable by itself; bit
   offsets stand at every ``STEP`` ids, so a block is decoded from many places at once
   through one table of 2^16 entries.
4. Reading adds, per part, the ids of all parts before it; only one row per part meets.

File format, a folder of two Parquet tables that any Hadoop file system can hold:
``codes`` (id, bits: code length) and ``blocks`` (part, block, first_id: ids before it in its part,
doc_ids, doc_sizes: ids per document, bit_offsets: of ids 0, STEP, 2 STEP and so on, payload: bits,
most significant first). Codes are canonical: shorter first, equal lengths by id.

Defined cases: null or empty text gives the end id alone; null ``doc_id`` stands first; equal ``doc_id``
stand next to each other, ordered by a hash of their ids; repeated rows are all written. An empty table
gives empty files. Other columns are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedback_spark.llm.frames import Batches, slices, texts_of
from feedback_spark.llm.word_pieces import Vocabulary
from feedback_spark.session import shared_path

MOST_BITS = 16
STEP = 128
BLOCK_IDS = 131_072
# Words kept between batches of a task; when full the store starts anew.
MOST_KEPT = 600_000


class LibraryEncoder:
    """Ids by the tokenizers library, one call per thousand distinct pre-tokens.

    Ids are held as little-endian unsigned 16-bit integers, as the files' codes need.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocabulary = v = Vocabulary(path)
        if len(v.strings) > 1 << 16:
            raise ValueError("the file format holds vocabularies of at most 65,536 ids")
        # Pre-tokens arrive cut, lower-cased and in byte letters, so the library's own model runs behind a plain split.
        self.library = Tokenizer(Tokenizer.from_file(path).model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_letters = str.maketrans({chr(b): letter for b, letter in enumerate(v.letters)})
        self.ends = np.array([s.endswith(v.suffix) for s in v.strings])
        self.special = {text: number.to_bytes(2, "little") for text, number in v.special.items()}
        self.kept: dict[str, bytes] = dict(self.special)
        self.pieces: dict[str, bytes] = {}

    def _learn(self, words: set[str], whole: set[str]) -> None:
        """Ids of composed lower-case ``words`` and of pre-tokens, which stay ``whole``."""
        kept, pieces, findall = self.kept, self.pieces, self.vocabulary.pattern.findall
        if len(kept) > MOST_KEPT:
            pieces.clear()
            kept.clear()
            kept.update(self.special)
        new, whole = list(words.difference(kept)), list(whole.difference(kept))
        # A word of letters is one pre-token, a mark behind it another; all others are cut by the pattern.
        cut = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".,!?" and w[:-1].isalpha() else findall(w) for w in new]
        self._learn_pieces(list({p for c in cut for p in c}.union(whole).difference(pieces)))
        for w in whole:
            kept[w] = pieces[w]
        for w, c in zip(new, cut):
            kept[w] = pieces[c[0]] if len(c) == 1 else b"".join([pieces[p] for p in c])

    def _learn_pieces(self, new: list[str]) -> None:
        for start in range(0, len(new), 1000):
            part = new[start : start + 1000]
            # Printable ASCII stands for itself.
            letters = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.byte_letters) for p in part]
            ids = np.array(self.library.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u2")
            cuts = [0, *(2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(texts), 256):
            words: set[str] = set()
            whole: set[str] = set()
            cut = []
            for text in texts[start : start + 256]:
                lower = self.vocabulary.plain(text)
                cut.append(self.vocabulary.cut(text) if lower is None else lower.split())
                (whole if lower is None else words).update(cut[-1])
            self._learn(words, whole)
            get = self.kept.__getitem__
            out.extend(b"".join(map(get, c)) for c in cut)
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encode_ids(df: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each document with the end id, as little-endian unsigned 16-bit integers."""

    def run(batches: Batches) -> Batches:
        encoder, end = library_encoder(path), end_id.to_bytes(2, "little")
        for batch in batches:
            for part in slices(batch, [text_column], 1024):
                made = [b + end for b in encoder.encode(texts_of(part, text_column))]
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    return df.select(id_column, text_column).mapInArrow(run, "doc_id long, ids binary")


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents. Each task adds up its own ids before anything is shuffled."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(b or b"" for b in batch.column("ids").to_pylist()), "<u2")
            total += np.bincount(joined, minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("i4")), pa.array(total[found])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most_bits`` (package-merge); 0 for ids that never occur.

    A level's list holds the single symbols and the pairs of the level below, by weight. Taking the lightest
    items of the last level and following pairs down counts, for each symbol, the levels in which it is taken.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) > 1 << most_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {most_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    singles, level = [], weights
    for _ in range(most_bits):
        singles.append(len(level))
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        single = np.concatenate([np.ones(len(weights), bool), np.zeros(len(pairs), bool)])
        place = np.argsort(merged, kind="stable")
        singles[-1] = np.cumsum(single[place])
        level = merged[place]
    take = 2 * len(order) - 2
    # The top list is the one made last but one: its items are chosen, then those below them.
    tops = [np.arange(1, len(weights) + 1), *singles[: most_bits - 1]]
    for counted in reversed(tops):
        n = int(counted[take - 1]) if take else 0
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, bits = 0, 0
    for symbol in order.tolist():
        code <<= int(lengths[symbol]) - bits
        bits = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` and the bit offset of each one."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return b"", at
    code, word = codes[ids].astype(np.uint64), at >> 6
    room = 64 - (at & 63) - size
    over = np.flatnonzero(room < 0)
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros((total + 63) // 64, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] = np.bitwise_or.reduceat(head, starts)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at


class Decoder:
    """Decodes blocks through one table from the next 16 bits to (id, length)."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical_codes(lengths)
        self.symbol, self.size = np.zeros(1 << MOST_BITS, np.int64), np.zeros(1 << MOST_BITS, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used] << (MOST_BITS - lengths[used]), kind="stable")]
        span = 1 << (MOST_BITS - lengths[used])
        filled = np.repeat(used, span)
        self.symbol[: len(filled)] = filled
        self.size[: len(filled)] = lengths[filled]

    def block(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block, all runs of STEP ids side by side."""
        if not n:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int64)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        at, out, last = offsets.astype(np.int64).copy(), np.empty((len(offsets), STEP), np.int64), len(window) - 1
        for k in range(STEP):
            look = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7))) & 0xFFFF
            out[:, k] = self.symbol[look]
            at += self.size[look]
        return out.ravel()[:n]


def write_files(ids: DataFrame, folder: str) -> None:
    """Write the files of ``encode_ids`` below ``folder`` in ascending order of ``doc_id``. ``ids`` is read twice."""
    spark = ids.sparkSession
    counts = np.zeros(1 << MOST_BITS, np.int64)
    for row in count_ids(ids).collect():  # one row per id of the vocabulary at most
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    table = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(table, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codes")

    def blocks(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        number, before, docs, held, size = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, docs, held, size
            raw = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
            payload, at = pack(raw, codes, lengths)
            row = {
                "part": [part], "block": [number], "first_id": [before], "doc_ids": [docs],
                "doc_sizes": [[len(h) // 2 for h in held]], "bit_offsets": [at[::STEP]], "payload": [payload],
            }
            number, before, docs, held, size = number + 1, before + len(raw), [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                held.append(value)
                size += len(value) // 2
                if size >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    keyed = ids.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK_COLUMNS).write.parquet(f"{folder}/blocks")


BLOCK_COLUMNS = (
    "part int, block int, first_id long, doc_ids array<long>, doc_sizes array<long>, bit_offsets array<long>, payload binary"
)
BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_sizes", pa.list_(pa.int64())), ("bit_offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``ids`` as little-endian unsigned 32-bit integers, ``start`` the ids of all documents before."""
    lengths = np.zeros(1 << MOST_BITS, np.int64)
    for row in spark.read.parquet(f"{folder}/codes").collect():  # one row per id of the vocabulary at most
        lengths[row.id] = row.bits
    stored = spark.read.schema(BLOCK_COLUMNS).parquet(f"{folder}/blocks")

    def run(batches: Batches) -> Batches:
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_sizes"], np.int64)
                raw = decoder.block(row["payload"], np.array(row["bit_offsets"], np.int64), int(sizes.sum())).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                values = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["first_id"]), pa.array(sizes), pa.array(values, pa.binary()),
                ], names=["part", "doc_id", "within", "n_tokens", "ids"])

    decoded = stored.mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids binary")
    sizes = stored.select("part", F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row of two numbers per part, and there are as many parts as there were tasks.
    return decoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def round_trip(df: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encode, write below the shared folder and read back."""
    spark = df.sparkSession
    staged = shared_path(spark, "token_ids")
    encode_ids(df, path, end_id).write.option("compression", "zstd").parquet(staged)
    folder = shared_path(spark, "token_files")
    write_files(spark.read.schema("doc_id long, ids binary").parquet(staged), folder)
    return read_files(spark, folder)
