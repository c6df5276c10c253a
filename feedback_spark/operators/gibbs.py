"""Topics by collapsed Gibbs sampling, synchronised after each sweep.

A document's words stand in hash buckets, each with a topic. In a sweep every task draws a new topic for each word of its documents,
one after another, from the topic counts of the document as they stand and the topic counts of all documents as they
stood before the sweep (its own word taken out). Then the counts are added up again. A draw's random number depends on
the document's key, the word's place and the sweep only, so partitions and lost executors do not change a result.

Burn-in sweeps are thrown away; of the others every ``thin``-th gives one estimate of the topics, and their mean is the result. The
counts are ``k`` by ``buckets`` numbers, whatever the number of documents or words. The words' topics are kept on the executors
after each sweep and stored in the shared folder after every tenth, so a lost executor repeats ten sweeps at most.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from feedback_spark.operators.variational import PART, part_sum, summed
from feedback_spark.session import by_value, drop_folder, shared_path

by_value(__name__)

# Sweeps thrown away, sweeps after them, of which each fifth counts, and the priors of topics and words.
BURN_IN = 200
SWEEPS = 500
THIN = 5
ALPHA_SUM = 50.0
DELTA = 0.1
STATE = "key long, words array<int>, topics array<int>"
SLICE_WORDS = 1 << 19
FEW_DOCUMENTS = 12
STORED_EACH = 10


@dataclass(frozen=True)
class GibbsModel:
    """``beta``: chance of each bucket in each topic, mean over the sweeps that count; ``state``: (key, words, topics) after the last sweep."""

    beta: np.ndarray
    state: DataFrame
    alpha: float


def draw(key: np.ndarray, place: int | np.ndarray, sweep: int, seed: int) -> np.ndarray:
    """Numbers from 0 up to 1 for (document, place, sweep)."""
    mask = (1 << 64) - 1
    places = np.atleast_1d(np.asarray(place, np.int64)).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = key.astype(np.int64).view(np.uint64) ^ (places + np.uint64((seed * 0x9E3779B97F4A7C15 + sweep * 0x8CB92BA72F3D8DD7) & mask))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sampled(key: np.ndarray, words: list[np.ndarray], topics: list[np.ndarray], counts: np.ndarray, alpha: float, delta: float, vocabulary: int, sweep: int, seed: int) -> list[np.ndarray]:
    """New topics of the documents; all documents take the step to the next place at once, the last few long ones go on alone.

    Words lie by place, those of longer documents first, so a place's words are neighbours. What does not change in a sweep is
    computed for all words before.
    """
    k, totals = len(counts), counts.sum(axis=1)
    order = np.argsort([-len(w) for w in words], kind="stable")
    sizes = np.array([len(words[i]) for i in order], np.int64)
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # documents longer than each place
    base = np.cumsum(active) - active
    row = np.repeat(np.arange(len(order)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = base[place]
    at += row
    word, was = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for out, lists in ((word, words), (was, topics)):
        out[at] = np.concatenate([*[lists[i] for i in order], np.zeros(0, np.int64)])
    number = np.empty(len(row))
    number[at] = draw(key[order][row], place, sweep, seed)
    share = np.empty((len(row), k))
    own = np.empty((len(order), k), np.int64)
    for t in range(k):
        mine = (was == t).astype(np.float64)
        share[:, t] = (counts[t, word] - mine + delta) / (totals[t] - mine + vocabulary * delta)
        own[:, t] = np.bincount(row, mine[at], len(order))
    new, rows, step = np.empty_like(was), np.arange(len(order)), 0
    for step, n in enumerate(active.tolist()):
        if n < FEW_DOCUMENTS:
            break
        here = slice(base[step], base[step] + n)
        own[rows[:n], was[here]] -= 1
        reach = np.cumsum(share[here] * (own[:n] + alpha), axis=1)
        chosen = np.minimum((reach <= (number[here] * reach[:, -1])[:, None]).sum(axis=1), k - 1)
        own[rows[:n], chosen] += 1
        new[here] = chosen
    else:
        step = len(active)
    for i in range(active[step] if step < len(active) else 0):
        rest = base[step : sizes[i]] + i
        mine, chosen = own[i].tolist(), []
        for shares, old, u in zip(share[rest].tolist(), was[rest].tolist(), number[rest].tolist()):
            mine[old] -= 1
            reach = list(accumulate(s * (m + alpha) for s, m in zip(shares, mine)))
            chosen.append(min(bisect_right(reach, u * reach[-1]), k - 1))
            mine[chosen[-1]] += 1
        new[rest] = chosen
    parts = np.split(new[at], np.cumsum(sizes)[:-1]) if len(sizes) else []
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
    for i, part in zip(order, parts):
        out[i] = part
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most SLICE_WORDS words, or one document."""
    ends, at = np.cumsum([len(w) for w in batch.column("words")]), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[len(v) for v in column]])
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _rows(keys: pa.Array, words: list[np.ndarray], topics: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *map(len, words)]).astype("i4"))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*a, np.zeros(0)]).astype("i4"))) for a in (words, topics)]
    return pa.RecordBatch.from_arrays([keys, *lists], names=["key", "words", "topics"])


def topic_counts(state: DataFrame, k: int, used: int, n_parts: int) -> np.ndarray:
    """Words of each topic and bucket. Each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * used, np.int64)
        for batch in batches:
            total += np.bincount(
                batch.column("topics").flatten().to_numpy(zero_copy_only=False).astype(np.int64) * used + batch.column("words").flatten().to_numpy(zero_copy_only=False),
                minlength=k * used,
            )
        yield part_sum(total)

    found = np.zeros(k * used) + summed(state.select("words", "topics").mapInArrow(run, PART), n_parts)
    return found.astype(np.int64).reshape(k, used)


def _kept(state: DataFrame) -> tuple[DataFrame, str, int]:
    """``state`` written to the shared folder and read back, its folder, and its partitions."""
    spark = state.sparkSession
    path = shared_path(spark, "gibbs")
    state.write.parquet(path)
    stored = spark.read.schema(STATE).parquet(path)
    return stored, path, stored.rdd.getNumPartitions()


def fit(
    documents: DataFrame, k: int, used: int, *, burn_in: int = BURN_IN, sweeps: int = SWEEPS, thin: int = THIN,
    vocabulary: int | None = None, alpha: float | None = None, delta: float = DELTA, seed: int = 1234,
) -> GibbsModel:
    """Sample over (key long, words array<int>), words numbered below ``used``; ``vocabulary`` of the numbers occur."""
    spark, vocabulary = documents.sparkSession, vocabulary or used
    alpha = ALPHA_SUM / k if alpha is None else alpha

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, key = _arrays(batch, "words"), batch.column("key").to_numpy()
            topics = [np.zeros(len(w), np.int64) for w in words]
            for i, w in enumerate(words):
                mixed = draw(np.full(len(w), key[i]) ^ (np.arange(len(w)) << 20), 0, 0, seed)
                topics[i] = np.minimum((mixed * k).astype(np.int64), k - 1)
            yield _rows(batch.column("key"), words, topics)

    state, path, n_parts = _kept(documents.select("key", "words").mapInArrow(start, STATE))
    total, taken = np.zeros((k, used)), 0
    counts = topic_counts(state, k, used, n_parts)
    for sweep in range(1, burn_in + sweeps + 1):

        def run(batches: Iterator[pa.RecordBatch], counts: np.ndarray = counts, sweep: int = sweep) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole):
                    words, topics = _arrays(batch, "words"), _arrays(batch, "topics")
                    new = sampled(batch.column("key").to_numpy(), words, topics, counts, alpha, delta, vocabulary, sweep, seed)
                    yield _rows(batch.column("key"), words, new)

        after = state.mapInArrow(run, STATE)
        if sweep % STORED_EACH and sweep < burn_in + sweeps:
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
            counts = topic_counts(after, k, used, n_parts)  # the next sweep's, and those of this one's estimate
            state.unpersist()
        else:
            after, stored, n_parts = _kept(after)
            state.unpersist()
            drop_folder(spark, path)
            path = stored
            counts = topic_counts(after, k, used, n_parts)
        state = after
        if sweep > burn_in and (sweep - burn_in) % thin == 0:
            total += (counts + delta) / (counts.sum(axis=1, keepdims=True) + vocabulary * delta)
            taken += 1
    if not taken:
        total, taken = (counts + delta) / (counts.sum(axis=1, keepdims=True) + vocabulary * delta), 1
    return GibbsModel(total / taken, state, alpha)


def document_shares(fitted: GibbsModel) -> DataFrame:
    """(key, shares): the topics' shares in each document after the last sweep."""
    k = len(fitted.beta)
    n = F.size("topics")
    own = [(F.size(F.filter("topics", lambda t, i=i: t == i)) + F.lit(fitted.alpha)) / (n + F.lit(k * fitted.alpha)) for i in range(k)]
    return fitted.state.select("key", F.array(*own).alias("shares"))
