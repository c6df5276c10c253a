"""Latent Dirichlet allocation by online variational Bayes, with the steps and random numbers of Spark ML's optimizer.

Spark infers one document at a time. Here a task takes many documents of like length at once, and a document that an iteration's
sample (with replacement, as in Spark) holds several times is inferred once and counted as often. Initial values come from
the same generators with the same seeds per iteration and partition, so model and shares are Spark's up to rounding.

The driver holds one weight per topic and bucket; a task holds as many sums and a block of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from feedback_spark.session import by_value

by_value(__name__)

# Fixed values of Spark's optimizer: shape of initial values, learning offset and decay, mean change at which a document is done.
SHAPE = 100.0
OFFSET = 1024
DECAY = 0.51
CHANGE = 1e-3
# Seed of the initial values when a fitted model is applied: Spark's default, the hash of its model class's name.
APPLY_SEED = 1421925485
# Cells of a block of documents, those of them that may be empty, and vectors that the driver adds up by itself.
BLOCK_CELLS = 1 << 16
WASTE_CELLS = 1 << 14
FEW_PARTS = 32
PART = "part int, cells binary"


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        bits = self.state >> 16
        return bits - (1 << 32) if bits >> 31 else bits

    def next_long(self) -> int:
        high = self._next()
        bits = ((high << 32) + self._next()) & ((1 << 64) - 1)
        return bits - (1 << 64) if bits >> 63 else bits


def gamma_draws(seed: int, n: int, shape: float = SHAPE) -> np.ndarray:
    """Gamma values of mean 1 by Marsaglia and Tsang, from a Mersenne twister seeded with a long."""
    twister = np.random.RandomState(np.array([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF], np.uint32))

    def uniforms() -> Iterator[float]:
        while True:
            raw = twister.randint(0, 1 << 32, 2 * max(16, min(n, 1 << 16)), np.uint32).astype(np.uint64) >> np.uint64(6)
            yield from (((raw[::2] << np.uint64(26)) | raw[1::2]).astype(np.float64) * 2.0**-52).tolist()

    b = shape - 1 / 3
    c, scale, u, out, held = 1 / math.sqrt(9 * b), 1 / shape, uniforms(), [], None
    while len(out) < n:
        if held is None:
            angle, r = 2 * math.pi * next(u), math.sqrt(-2 * math.log(next(u)))
            x, held = r * math.cos(angle), r * math.sin(angle)
        else:
            x, held = held, None
        v = 1 + c * x
        if v <= 0:
            continue
        v3, y = v * v * v, next(u)
        if y < 1 - 0.0331 * (x * x) * (x * x) or math.log(y) < 0.5 * x * x + b * (1 - v3 + math.log(v3)):
            out.append(scale * (b * v3))
    return np.array(out)


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive ``x``: six steps up by recurrence, taken together, then the asymptotic series.

    Breeze steps up to 49 and has the third and fourth terms of the series with the other sign, some 3e-9 in all; that is followed, as it
    moves the sixth digit of a small weight.
    """
    y, z = x * (x + 5), x + 6
    w = 1 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w * (1 / 132 - w * (691 / 32760 - w / 12))))))
    far = x + np.maximum(np.ceil(49 - x), 0)
    v = 1 / (far * far)
    return np.log(z) - 0.5 / z - series - (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6)) - v * v * (1 / 60 - v / 126)


def trigamma(x: np.ndarray) -> np.ndarray:
    below, z = sum(1 / (x + i) ** 2 for i in range(10)), x + 10
    w = 1 / (z * z)
    return below + 1 / z + w / 2 + w / z * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w * (1 / 30 - w * 5 / 66))))


def _cubics(low: int, high: int, per_unit: int) -> np.ndarray:
    """Coefficients of ``digamma(x) - log(x)`` between the points of a grid over ``log(x)``, to some 1e-12 of the value."""
    u = np.arange(low * per_unit, high * per_unit + 1) / per_unit
    x = np.exp(u)
    f, slope = digamma(x) - u, (trigamma(x) * x - 1) / per_unit
    rise, a, b = np.diff(f), slope[:-1], slope[1:]
    return np.stack([f[:-1], a, 3 * rise - 2 * a - b, a + b - 2 * rise], axis=1)


GRID_LOW, GRID_HIGH, GRID_PER_UNIT = -10, 20, 256
GRID = _cubics(GRID_LOW, GRID_HIGH, GRID_PER_UNIT)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """``exp(digamma(x))`` from the grid, in a third of the calls that the series takes; for ``log(x)`` within the grid."""
    u = np.log(x)
    place = (u - GRID_LOW) * GRID_PER_UNIT
    cell = place.astype(np.intp)
    place -= cell
    c = GRID[cell]
    return np.exp(((c[..., 3] * place + c[..., 2]) * place + c[..., 1]) * place + c[..., 0] + u)


def expectation(x: np.ndarray) -> np.ndarray:
    """Mean logarithm of the parts of Dirichlet distributions in the last axis."""
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def inferred(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, beta: np.ndarray, alpha: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, theta, ratio): topic weights of documents, the exponential of their digamma, and each word's count over its norm.

    Spark's theta is this one over that of the document's total, which cancels wherever theta is used.

    ``words`` and ``counts`` of all documents one after another, none of them empty; ``beta``: (word, topic). A block is left once half of
    its documents are done; what is open then goes into new blocks with others, as some documents need a hundred times the steps of others.
    """
    n, start = len(sizes), np.cumsum(sizes) - sizes
    gamma, ratio = np.repeat(first[None], n, axis=0), np.empty(len(words))
    # No weight is less than the least alpha or more than all words.
    inside = alpha.min() > math.exp(GRID_LOW) and counts.sum() + alpha.sum() < math.exp(GRID_HIGH)
    power = exp_digamma if inside else lambda x: np.exp(digamma(x))
    theta = power(gamma)
    left = np.argsort(sizes, kind="stable")
    while len(left):
        rest, at, ranked = [], 0, sizes[left]
        full = np.cumsum(ranked)
        while at < len(left):
            padded = (np.arange(at, len(left)) + 1 - at) * ranked[at:]
            held = full[at:] - full[at] + ranked[at]
            fits = (padded <= BLOCK_CELLS) & (padded - held <= np.maximum(WASTE_CELLS, held // 4))
            end = at + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
            rest.append(_block(left[at:end], words, counts, sizes, start, beta, alpha, power, gamma, theta, ratio))
            at = end
        left = np.concatenate(rest)
        left = left[np.argsort(sizes[left], kind="stable")]
    return gamma, theta, ratio


def _block(rows, words, counts, sizes, start, beta, alpha, power, gamma, theta, ratio) -> np.ndarray:
    """Takes documents ``rows`` step by step until half of them are done, and returns the others."""
    n, k, width = len(rows), beta.shape[1], int(sizes[rows].max())
    held = np.arange(width) < sizes[rows, None]
    cells = np.where(held, start[rows, None] + np.arange(width), 0)
    b, c = beta[words[cells]], np.where(held, counts[cells], 0.0)
    g, t, open_, n_open = gamma[rows], theta[rows], np.ones(n, bool), n
    # Written over in each step: new arrays of this size would cost more than the arithmetic.
    r = np.empty_like(c)

    def weigh() -> None:
        np.matmul(b, t[:, :, None], out=r[:, :, None])
        np.add(r, 1e-100, out=r)
        np.divide(c, r, out=r)

    weigh()
    while True:
        new = np.matmul(r[:, None, :], b)[:, 0, :] * t + alpha
        change = np.abs(new - g).sum(axis=1)
        g, t = new, power(new)
        weigh()
        # Not "<=": a value that is no number ends the steps, as it does in Spark.
        done = ~(change > CHANGE * k)
        if done.any():
            done &= open_
            found = rows[done]
            gamma[found], theta[found] = g[done], t[done]
            ratio[cells[done][held[done]]] = r[done][held[done]]
            open_ &= ~done
            n_open = int(open_.sum())
            if n_open <= n // 2:
                gamma[rows[open_]], theta[rows[open_]] = g[open_], t[open_]
                return rows[open_]


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4") for c in ("words", "counts"))
    return words, counts, np.array([len(x) // 4 for x in batch.column("words").to_pylist()], np.int64)


def bags(lists: DataFrame, key: str, bucket: Column) -> DataFrame:
    """(key, place, words, counts): each document's distinct buckets and their counts as packed numbers; rows stay where they are.

    ``bucket``: array of the buckets of a document's terms.
    """
    numbered = lists.select(key, F.monotonically_increasing_id().alias("place"), bucket.alias("words"))
    out = StructType([numbered.schema[key], *StructType.fromDDL("place long, words binary, counts binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) for x in column], np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            pairs, counts = np.unique(rows << 32 | flat, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(1, len(sizes)) << 32)
            packed = [[x.tobytes() for x in np.split(a.astype("<i4"), ends)] if len(sizes) else [] for a in (pairs & 0xFFFFFFFF, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p, pa.binary()) for p in packed]], names=[key, "place", "words", "counts"])

    return numbered.mapInArrow(run, out)


def summed(parts: DataFrame, n_parts: int) -> np.ndarray | float:
    """Sum of the vectors of (part, cells), one of packed doubles per partition, always in the same order; 0 without any.

    The driver gets a few vectors, whatever the number of partitions.
    """
    few = math.isqrt(n_parts)

    def add(table: pa.Table) -> pa.Table:
        made = sorted(zip(table.column("part").to_pylist(), table.column("cells").to_pylist()))
        total = sum(np.frombuffer(cells, "<f8") for _, cells in made)
        return pa.table({"part": pa.array([made[0][0] % few], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    if n_parts > FEW_PARTS:
        parts = parts.groupBy((F.col("part") % few).alias("lead")).applyInArrow(add, PART)
    return sum((np.frombuffer(r.cells, "<f8") for r in sorted(parts.collect(), key=lambda r: r.part)), 0.0)


def used_buckets(documents: DataFrame, buckets: int, n_parts: int) -> tuple[np.ndarray, int]:
    """Buckets that occur, in ascending order, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets + 1)
        for batch in batches:
            seen[_bags(batch)[0]] = 1
            seen[-1] += batch.num_rows
        yield part_sum(seen)

    found = np.zeros(buckets + 1) + summed(documents.select("words", "counts").mapInArrow(run, PART), n_parts)
    return np.flatnonzero(found[:-1]), int(found[-1])


def part_sum(cells: np.ndarray) -> pa.RecordBatch:
    part = pa.array([TaskContext.get().partitionId()], pa.int32())
    return pa.RecordBatch.from_arrays([part, pa.array([cells.astype("<f8").tobytes()], pa.binary())], names=["part", "cells"])


@dataclass(frozen=True)
class VariationalModel:
    """``weights``: parameters of each topic's words, in the order of ``used``; ``alpha``: those of a document's topics."""

    weights: np.ndarray
    alpha: np.ndarray
    used: np.ndarray
    buckets: int

    def getK(self) -> int:
        return len(self.weights)

    def vocabSize(self) -> int:
        return len(self.used)

    def beta(self) -> np.ndarray:
        """Chance of each word in each topic."""
        return self.weights / self.weights.sum(axis=1, keepdims=True)

    def expected(self) -> np.ndarray:
        """Exponential expectation of each topic's words, by bucket."""
        out = np.ones((self.buckets, self.getK()))
        out[self.used] = np.exp(expectation(self.weights)).T
        return out


def fit(documents: DataFrame, used: np.ndarray, k: int, buckets: int, n_parts: int, *, iterations: int, seed: int) -> VariationalModel:
    """Fit on ``bags`` that are kept; the order of ``used`` is that of the initial values."""
    random = JavaRandom(seed)
    weights = gamma_draws(random.next_long(), k * len(used)).reshape(k, len(used))
    alpha, eta, step = np.full(k, 1 / k), 1 / k, 0
    for _ in range(iterations):
        sample = random.next_long()
        ahead = JavaRandom(0)
        ahead.state = random.state
        draw, beta = ahead.next_long(), VariationalModel(weights, alpha, used, buckets).expected()

        def run(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta, alpha: np.ndarray = alpha, draw: int = draw) -> Iterator[pa.RecordBatch]:
            stats, means, seen, full, first = np.zeros((k, buckets)), np.zeros(k), 0, 0, None
            for batch in batches:
                if first is None:
                    first = gamma_draws(draw + TaskContext.get().partitionId(), k)
                place = batch.column("place").to_numpy()
                lead = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
                times = np.diff(np.r_[lead, len(place)])
                words, counts, sizes = _bags(batch.take(pa.array(lead)))
                seen += len(place)
                times, sizes = times[sizes > 0], sizes[sizes > 0]
                full += int(times.sum())
                gamma, theta, ratio = inferred(words, counts, sizes, beta, alpha, first)
                means += (expectation(gamma) * times[:, None]).sum(axis=0)
                for t in range(k):
                    stats[t] += np.bincount(words, np.repeat(theta[:, t] * times, sizes) * ratio, buckets)
            yield part_sum(np.r_[stats.ravel(), means, seen, full])

        drawn = documents.select("place", "words", "counts").sample(True, 1.0, sample)
        cells = np.zeros(k * buckets + k + 2) + summed(drawn.mapInArrow(run, PART), n_parts)
        seen, full = cells[-2:]
        if not seen:
            continue
        random, step = ahead, step + 1
        if not full:
            continue
        rate = (OFFSET + step) ** -DECAY
        stats = (cells[: k * buckets].reshape(k, buckets) * beta.T)[:, used]
        weights = (1 - rate) * weights + rate * (stats + eta)
        slope = full * (cells[k * buckets : -2] / full - expectation(alpha))
        c, q = full * trigamma(alpha.sum()), -full * trigamma(alpha)
        moved = alpha - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        if (moved > 0).all():
            alpha = moved
    return VariationalModel(weights, alpha, used, buckets)


def document_shares(model: VariationalModel, documents: DataFrame) -> DataFrame:
    """(key, shares): the topics' shares in each document; all zero in one without words."""
    key, k, beta, alpha = documents.columns[0], model.getK(), model.expected(), model.alpha
    out = StructType([documents.schema[key], StructField("shares", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = gamma_draws(APPLY_SEED, k)
        for batch in batches:
            words, counts, sizes = _bags(batch)
            shares = np.zeros((len(sizes), k))
            gamma, _, _ = inferred(words, counts, sizes[sizes > 0], beta, alpha, first)
            shares[sizes > 0] = gamma / gamma.sum(axis=1, keepdims=True)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype="i4") * k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))], names=[key, "shares"])

    return documents.select(key, "words", "counts").mapInArrow(run, out)
