"""Quality scores from trusted positives and unlabelled text (positive-unlabelled learning).

1. Each whole text becomes ``FEATURES`` numbers: rates of every ASCII mark, of digits, capitals, foreign and control bytes, and of
   repeated words and lines. They are stored once per row; all later passes read these narrow rows.
2. A first logistic model tells trusted positives (labelled good, outside the held-out fold) from all text. The share of good text
   (class prior) is the least ratio of the shares of all text and of positives above a score: above a high score all text is good
   text, so the ratio is the prior there. Shares come from counts in ``BINS`` bins over all rows, with a margin for chance.
3. The non-negative risk  prior * E+[l(z)] + max(0, E[l(-z)] - prior * E+[l(-z)])  with logistic loss l and a small
   ridge is minimised by Newton steps; the corner of max(0, .) is rounded over a width of ``MARGIN``, which keeps the curvature positive.
   Each step's gradient and curvature, and the risks at some lengths of the step, are sums over all rows, made in two passes of Spark.

Negative labels are never looked at: only a label of 1 outside the fold has a part in learning. All trusted positives are used.
What reaches the driver is a matrix of ``FEATURES`` by ``FEATURES`` numbers per pass and ``BINS`` counts.

Defined cases: null and empty texts have all rates zero and are scored like any text; repeated rows count and get equal scores; a null
``doc_id`` is unlabelled and not held out; repeated labels of an id: positive if any is 1; null labels say nothing. Without a trusted
positive nothing can be learnt: every score is 0.5. An empty table gives an empty table. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import Batches, durable, slices, texts_of

MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
FEATURES = len(MARKS) + 12
RIDGE = 1e-3
MARGIN = 1e-3
STEPS = 12
PRIOR_STEPS = 6
LEAST_GAIN = 1e-5
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03)
BINS = 1_000
THRESHOLD = 0.5


def features(text: str) -> list[float]:
    """Rates of a text on a logarithmic scale, so that a stretch of junk shows in a long text too."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    n, m = max(len(raw), 1), max(len(words), 1)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    repeats = sum(map(str.__eq__, words, words[1:]))
    rates = [
        *(1000 * counts[MARKS] / n).tolist(),
        1000 * int(counts[48:58].sum()) / n, 100 * int(counts[65:91].sum()) / letters, 100 * int(counts[128:].sum()) / n,
        1000 * int(counts[:9].sum() + counts[11:32].sum() + counts[127]) / n, 1000 * int(counts[10]) / n,
        100 * repeats / m, 100 * (len(words) - len(set(words))) / m, 100 * (len(lines) - len(set(lines))) / max(len(lines), 1),
        100 * sum(not any(map(str.isalnum, w)) for w in set(words)) / m, len(words), len(text) / m, max(map(len, words), default=0),
    ]
    return [math.log1p(r) for r in rates]


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose labels are never looked at."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def feature_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, x, trusted) of every row."""
    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, ["text"]):
                made = np.array([features(t) for t in texts_of(batch, "text")], np.float32).reshape(-1, FEATURES)
                offsets = np.arange(0, made.size + 1, FEATURES, dtype="i4")
                x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    made = plain.mapInArrow(run, "doc_id long, x array<float>")
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out()).distinct()
    return made.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").select(
        "doc_id", "x", F.coalesce("trusted", F.lit(False)).alias("trusted")
    )


@dataclass
class Scale:
    mean: np.ndarray
    spread: np.ndarray

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """The batch's rows, standardised, behind a one; far values are drawn in."""
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -8, 8)])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def summed(rows: DataFrame, size: int, work) -> np.ndarray:
    """The sum over all rows of the vectors that ``work`` makes of each batch; one row of ``size`` numbers is collected."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="i4")), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "trusted").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def scale_of(rows: DataFrame) -> tuple[Scale, int, int]:
    """(scale, rows, trusted rows)."""

    def work(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)
        return np.concatenate([[len(x), flags(batch).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    made = summed(rows, 2 + 2 * FEATURES, work)
    n = max(made[0], 1)
    mean = made[2 : 2 + FEATURES] / n
    spread = np.sqrt(np.maximum(made[2 + FEATURES :] / n - mean * mean, 0))
    return Scale(mean, np.maximum(spread, 0.05)), int(made[0]), int(made[1])


def flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)


def minimise(rows: DataFrame, scale: Scale, n: int, n_trusted: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative risk for a class prior; see the module's step 3."""
    size = FEATURES + 1
    ridge = np.full(size, RIDGE)
    ridge[0] = 1e-6
    upper = np.triu_indices(size)

    def square(part: np.ndarray) -> np.ndarray:
        made = np.zeros((size, size))
        made[upper] = part
        return made + np.triu(made, 1).T

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            x = scale(batch)
            z, good = x @ w, flags(batch)
            p = sigmoid(z)
            curved, curved_good = ((y * (q * (1 - q))[:, None]).T @ y for y, q in ((x, p), (x[good], p[good])))
            rest = softplus(z).sum() / n - prior * softplus(z[good]).sum() / n_trusted
            sums = p @ x / n, p[good] @ x[good] / n_trusted, x[good].sum(axis=0) / n_trusted
            return np.concatenate([[rest], *sums, curved[upper] / n, curved_good[upper] / n_trusted])

        made = summed(rows, 1 + 3 * size + 2 * len(upper[0]), work)
        every, pulled, mean = made[1 : 1 + 3 * size].reshape(3, size)
        every_curved, good_curved = (square(v) for v in made[1 + 3 * size :].reshape(2, -1))
        # How far the non-negative part is switched on: 1 well above zero, 0 well below.
        on = sigmoid(np.array(made[0] / MARGIN))
        slope = every - prior * pulled
        gradient = prior * (pulled - mean) + on * slope + ridge * w
        hessian = (1 - on) * prior * good_curved + on * every_curved + on * (1 - on) / MARGIN * np.outer(slope, slope) + np.diag(ridge)
        return gradient, hessian

    def risks(tried: np.ndarray) -> np.ndarray:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            z = scale(batch) @ tried.T
            good = z[flags(batch)]
            return np.concatenate([softplus(-good).sum(axis=0) / n_trusted, softplus(good).sum(axis=0) / n_trusted, softplus(z).sum(axis=0) / n])

        good, bad, every = summed(rows, 3 * len(tried), work).reshape(3, -1)
        return prior * good + MARGIN * softplus((every - prior * bad) / MARGIN) + (ridge * tried * tried).sum(axis=1) / 2

    w = np.zeros(size)
    w[0] = math.log(prior / (1 - prior))
    best = risks(w[None])[0]
    for _ in range(steps):
        gradient, hessian = derivatives(w)
        step = np.linalg.solve(hessian, gradient)
        tried = w - np.array(LENGTHS)[:, None] * step
        found = risks(tried)
        least = int(np.argmin(found))
        if not found[least] < best - LEAST_GAIN:
            break
        w, best = tried[least], found[least]
    return w


def class_prior(rows: DataFrame, scale: Scale, n: int, n_trusted: int) -> float:
    """The share of good text, from a model that tells trusted rows from all text, both of equal weight."""
    w = minimise(rows, scale, n, n_trusted, 0.5, PRIOR_STEPS)

    def work(batch: pa.RecordBatch) -> np.ndarray:
        place = np.minimum((sigmoid(scale(batch) @ w) * BINS).astype(np.int64), BINS - 1)
        trusted = flags(batch)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[trusted], minlength=BINS)]).astype(np.float64)

    every, good = summed(rows, 2 * BINS, work).reshape(2, -1)
    every, good = (np.cumsum(v[::-1]) / total for v, total in ((every, n), (good, n_trusted)))
    # Binomial margins keep a score that few rows exceed from deciding by chance.
    margin = 1.5 * (np.sqrt(every * (1 - every) / n) + np.sqrt(np.maximum(good * (1 - good), 1e-9) / n_trusted))
    usable = good >= 0.05
    ratio = (every[usable] + margin[usable]) / good[usable]
    at = int(np.argmin(ratio))
    return float(np.clip(every[usable][at] / good[usable][at], 0.02, 0.98))


@dataclass
class Model:
    scale: Scale
    weights: np.ndarray
    prior: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return sigmoid(self.scale(batch) @ self.weights)


def learn(rows: DataFrame) -> Model | None:
    """A model from ``feature_rows``; None without a trusted row."""
    scale, n, n_trusted = scale_of(rows)
    if not n_trusted:
        return None
    prior = class_prior(rows, scale, n, n_trusted)
    return Model(scale, minimise(rows, scale, n, n_trusted, prior), prior)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = durable(feature_rows(docs, labels, id_column, text_column), "quality_features")
    model = learn(rows)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = model.scores(batch) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made), pa.array((made >= THRESHOLD).astype("i4"))], names=["doc_id", "score", "predicted"]
            )

    scored = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
