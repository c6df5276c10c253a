"""Sharding by best-fit-decreasing bin packing of indivisible groups.

1. Each document becomes a narrow row of its id, size and text digest, stored once. Groups are the documents of one
   text; sizes are added up per group in every task first.
2. Groups that hold at least 1 / (shards * ``FINENESS``) of all bytes are packed one by one; there are at most
   shards * ``FINENESS`` of them. All smaller groups are put by the hash of their text into shards * ``BUNDLES``
   bundles, each packed as one item. So the driver packs a number of items that the parameters bound, whatever
   the corpus size.
3. Items, largest first, enter the bin with the least remaining capacity that holds them, found in a balanced tree
   of capacities; none fitting, a new bin is opened. With a fixed number of shards the least capacity that needs no
   more bins is searched, after every group larger than the fair share of what is left has got a shard of its own.
4. Slots are numbered per shard over ``SLOT_PARTS`` parts of its rows by hash: a part's first slot is the number
   of rows in the parts before it. No task ever sees a whole shard.

Defined cases: null text is empty and of size 1; equal texts always share a shard, whatever their ids; repeated rows
have slots of their own; a null ``doc_id`` is kept; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedback_spark.llm.frames import durable, text_key

FINENESS = 512
BUNDLES = 256
SLOT_PARTS = 1_024


class CapacityTree:
    """A treap of (remaining capacity, bin) pairs: balanced by priorities drawn from a fixed sequence."""

    def __init__(self):
        self.root, self.seed = None, 1

    def insert(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        node = [key, self.seed >> 20, None, None]
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, node), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the pair of least capacity not below ``least``."""
        low, high = self._split(self.root, (least, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._join(low, rest)
        return first[0]

    def _split(self, node, key):
        """Trees of the pairs below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """The bin of each item; None when more than ``most_bins`` are needed. ``sizes`` must fall and fit the capacity."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if bins == most_bins or size > capacity:
                return None
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        tree.insert((found[0] - size, found[1]))
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, sizes near equal. ``sizes`` must fall."""
    total, own = sum(sizes), 0
    # A group above the fair share of what is left fills a shard alone.
    while own < min(len(sizes), shards - 1) and sizes[own] * (shards - own) > total:
        total -= sizes[own]
        own += 1
    rest, bins = sizes[own:], shards - own
    if not rest:
        return list(range(own))
    low = max(-(-total // bins), rest[0])
    high = low
    while (best := best_fit_decreasing(rest, high, bins)) is None:
        high += max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return [*range(own), *(own + b for b in best)]


def shards(df: DataFrame, n: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = durable(df.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        text_key(text).alias("key"), F.monotonically_increasing_id().alias("row"),
    ), "sizes").withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(n * BUNDLES)).cast("int"))
    groups = durable(rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes") * (n * FINENESS) >= F.lit(total)
    # At most n * FINENESS groups and n * BUNDLES bundles.
    heavy = [(bytes(r.key), None, r.bytes) for r in groups.filter(alone).select("key", "bytes").collect()]
    light = [(None, r.bundle, r.bytes) for r in groups.filter(~alone).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()]
    items = sorted(heavy + light, key=lambda r: (-r[2], r[0] or b"", r[1] or 0))
    packed = list(zip(items, pack([r[2] for r in items], n)))
    of_group = spark.createDataFrame([(r[0], s) for r, s in packed if r[0] is not None], "key binary, own int")
    of_bundle = spark.createDataFrame([(r[1], s) for r, s in packed if r[0] is None], "bundle int, shared int")
    placed = rows.join(F.broadcast(of_group), "key", "left").join(F.broadcast(of_bundle), "bundle", "left").select(
        "doc_id", "size", "text_crc32", "key", "row", F.coalesce("own", "shared").alias("shard"),
        F.pmod(F.xxhash64("row"), F.lit(SLOT_PARTS)).cast("int").alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key", "row")) - 1
    numbered = placed.withColumn("within", within)
    # At most n * SLOT_PARTS rows of three numbers.
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).alias("slot")
    )
