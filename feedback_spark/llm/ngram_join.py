"""Near-duplicate join on the Jaccard similarity of word n-grams.

1. Each document becomes the set of its five-word shingles (64-bit hashes) and a MinHash signature, cut in
   bands. Bands and rows are chosen for the target recall at the least similarity. Documents of one shingle set,
   copies above all, become one node (64 bits of a digest of the set), so thousands of copies cost as much as one.
2. (band hash, node) rows are shuffled by band hash. A bucket of two nodes or more links its members to its
   least node only, never pair by pair.
3. Nodes linked over buckets form candidate groups. The members' whole shingle sets are fetched once, and a
   group is verified in blocks of about ``BLOCK_NODES`` nodes: every pair of blocks is one unit of work that
   compares all its pairs exactly by an inverted index of shingles and adds up links per node. A block passes on a
   spanning forest, a pair of blocks only the edges that join their classes, so edges grow with the nodes. A group
   of any size is spread over tasks, no link between different texts is lost, and no table of pairs arises.
4. Components over the verified links give the classes.

A pair of exactly the least similarity misses all bands with odds of 1 - ``RECALL``; candidate groups make up
for most of that. Two different shingle sets share a node number with odds of 2^-64.

Defined cases: null, empty and wordless texts have no shingle and link to nothing, also not to each other; a
text of one to four words has its whole word sequence as its one shingle. Repeated rows are copies. A null
``doc_id`` is kept; a class of null ids only has a null ``class_id``. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from feedback_spark.llm.components import components
from feedback_spark.llm.frames import Batches, durable, slices, text_key, texts_of, unused

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999999
MOST_HASHES = 128
BLOCK_NODES = 256
MOST_KEPT = 300_000


def bands_for(similarity: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, and so the fewest false candidates, within the number of hashes."""
    chosen = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(similarity**rows, 1 - 1e-12))))
        if bands * rows <= most_hashes:
            chosen = (bands, rows)
    if chosen is None:
        raise ValueError("no banding reaches this recall within this many hashes")
    return chosen


class WordHashes(dict):
    """64-bit hashes of words, found on first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode().split()  # cuts at exactly the white space of the word rule
    if not words:
        return np.zeros(0, np.uint64)
    known = word_hashes()
    if len(known) > MOST_KEPT:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - WORDS + 1, 1)
    out = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(len(words), WORDS)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def node_number(found: np.ndarray) -> int | None:
    if not len(found):
        return None
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def buckets(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band: a hash of the band and its MinHash values."""
    factors, steps = hash_family(bands * rows)
    least = np.empty(bands * rows, np.uint64)
    for start in range(0, len(least), 16):
        part = slice(start, start + 16)
        values = np.multiply.outer(factors[part], found)
        values += steps[part, None]
        values ^= values >> np.uint64(32)
        least[part] = values.min(axis=1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


@lru_cache(maxsize=4)
def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_24)
    return random.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, n, np.uint64)


def signatures(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, node, buckets) of each row; the texts stay where they are."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, ["text"]):
                sets = [shingles(t) for t in texts_of(batch, "text")]
                nodes = [node_number(s) for s in sets]
                hashed = [buckets(s, bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("key"), pa.array(nodes, pa.int64()), pa.array(hashed, pa.list_(pa.int64())),
                ], names=["doc_id", "key", "node", "buckets"])

    keyed = df.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, node long, buckets array<long>")


def candidate_edges(signed: DataFrame) -> DataFrame:
    """(a, b): each node with the least of its buckets' least nodes, and that one with the others.

    A node has at most one such node per band. Joining these among themselves leaves about one edge per node,
    where a large group of near copies else has one per node and band.
    """
    rows = signed.filter(F.col("node").isNotNull()).select("node", F.explode("buckets").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    linked = rows.join(ends.select("bucket", "low"), "bucket").filter("node != low")
    lows = linked.groupBy("node").agg(F.collect_set("low").alias("lows")).withColumn("a", F.array_min("lows"))
    others = F.filter("lows", lambda x: x != F.col("a"))
    return lows.select("a", F.explode(F.concat(F.array("node"), others)).alias("b")).distinct()


def verified_links(df: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b, links): edges of a spanning forest (b set), and class sizes linked to node ``a`` (b null).

    ``groups``: (doc_id, node, n, label, blocks, block), one row per node.
    """
    wanted = groups.select(F.col("doc_id").alias("rep"), "node", "n", "label", "blocks", "block")
    fetched = df.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")

    def sets(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, ["text"]):
                found = [shingles(t) for t in texts_of(batch, "text")]
                # Rows that share the id of the wanted document but not its shingles fall out here.
                right = [i for i, (s, n) in enumerate(zip(found, batch.column("node").to_pylist())) if node_number(s) == n]
                held = batch.take(pa.array(right, pa.int64()))
                arrays = [held.column(c) for c in ("node", "n", "label", "blocks", "block")]
                made = pa.array([found[i].tobytes() for i in right], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, made], names=["node", "n", "label", "blocks", "block", "set"])

    def verify(batches: Batches) -> Batches:
        current, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                unit = (row["label"], row["low"], row["high"])
                if unit != current:
                    if len(held) > 1:
                        yield compare(list(held.values()), current[1] != current[2], similarity)
                    current, held = unit, {}
                held.setdefault(row["node"], (row["node"], row["n"], row["block"], np.frombuffer(row["set"], np.uint64)))
        if len(held) > 1:
            yield compare(list(held.values()), current[1] != current[2], similarity)

    rows = fetched.mapInArrow(sets, "node long, n long, label long, blocks int, block int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = rows.withColumn("other", other).select(
        "node", "n", "label", "block", "set", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    keys = ("label", "low", "high")
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long")


def compare(held: list[tuple[int, int, int, np.ndarray]], across: bool, similarity: float) -> pa.RecordBatch:
    """All pairs of a unit, by shared shingles.

    A unit of one block gives the links inside it and the edges of a spanning forest. A unit ``across`` two blocks
    gives the links between them, and of edges only those that join classes which the blocks have by themselves: one
    for two blocks of near copies, however many links there are.
    """
    nodes, weights, blocks = (np.array([h[i] for h in held], np.int64) for i in range(3))
    sets = [h[3] for h in held]
    sizes = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    by_value = owner[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number))
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    edges: list[tuple[int, int]] = []
    later: list[tuple[int, np.ndarray]] = []

    def join(i: int, found: np.ndarray, kept: bool) -> None:
        """Gives all classes of ``found`` the label of ``i``; one edge per class that it had not."""
        others, first = np.unique(label[found], return_index=True)
        for other, at in zip(others.tolist(), first.tolist()):
            if other != label[i]:
                if kept:
                    edges.append((i, int(found[at])))
                label[label == other] = label[i]

    cuts = np.cumsum(sizes)
    for i in range(len(sets) - 1):
        mine = number[cuts[i] - sizes[i] : cuts[i]]
        stop = ends[mine]
        start = np.where(mine > 0, ends[mine - 1], 0)
        run = stop - start
        place = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run) + np.repeat(start, run)
        shared = np.bincount(by_value[place], minlength=len(sets))
        close = (1 + similarity) * shared >= similarity * (sizes + sizes[i]) - 1e-9
        close[: i + 1] = False
        found = np.flatnonzero(close)
        if across:
            same = blocks[found] == blocks[i]
            join(i, found[same], kept=False)
            found = found[~same]
            if len(found):
                later.append((i, found))
        else:
            join(i, found, kept=True)
        links[i] += weights[found].sum()
        links[found] += weights[i]
    for i, found in later:
        join(i, found, kept=True)
    some = np.flatnonzero(links)
    a, b = ([int(nodes[e[k]]) for e in edges] for k in range(2))
    return pa.RecordBatch.from_arrays([
        pa.array([*a, *nodes[some].tolist()], pa.int64()), pa.array([*b, *[None] * len(some)], pa.int64()),
        pa.array([*[None] * len(a), *links[some].tolist()], pa.int64()),
    ], names=["a", "b", "links"])


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """(doc_id, key, node, label, class_id, n_links), a row for each row of ``df``.

    ``n_links``: other rows of at least that similarity. ``class_id``: least ``doc_id`` of the class. ``key``: a digest
    of the text.
    """
    bands, rows = bands_for(similarity, recall)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = durable(signatures(docs, bands, rows), "signatures")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    grouped = components(candidate_edges(signed))
    blocks = grouped.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("blocks"))
    groups = grouped.join(blocks, "label").join(nodes, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    links = durable(verified_links(docs, groups, similarity), "links")
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(links.filter("b IS NOT NULL").select("a", "b"))
    known = nodes.join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    per_node = known.join(classes, "label").select(
        "node", "label", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.select("doc_id", "key", "node").join(per_node, "node", "left").select(
        "doc_id", "key", "node", "label",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with one row of each class, that of the least id and then text digest; rows without a word all stay."""
    found = near_duplicates(df, id_column, text_column)
    first = found.filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), "key", "doc_id")).alias("first")
    )
    key, first_id, first_key = unused(df, "key"), unused(df, "first_id"), unused(df, "first_key")
    first = first.select(F.col("first.doc_id").alias(first_id), F.col("first.key").alias(first_key)).distinct()
    marked = df.withColumn(key, text_key(F.col(text_column)))
    wordless = ~F.coalesce(F.col(text_column), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = marked.join(
        first, marked[id_column].cast("long").eqNullSafe(F.col(first_id)) & (F.col(key) == F.col(first_key)), "left_semi"
    ).dropDuplicates([id_column, key])
    return kept.drop(key).select(*df.columns).unionByName(df.filter(wordless))
