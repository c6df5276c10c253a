"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter matrix.

1. An entry c becomes the whole number floor(64 c). The sums and the sums of products of all rows are added up exactly:
   tasks multiply in doubles only where no product sum reaches 2^53, cut larger entries into limbs, and pass on each
   sum as limbs, so that no addition of Spark's overflows. n * (sum of products) - sum * sum is the integer scatter
   matrix M, n^2 times the covariance. A constant added to all entries cancels, so it is left out.
2. The characteristic polynomial of M modulo a prime of 31 bits comes from its Hessenberg form. One task works through
   some primes; as many primes are used as the coefficients' bound needs, and Chinese remaindering gives the exact integers.
3. All roots are real and none is negative, so the sign changes of the polynomial shifted by a are just as many as
   roots lie above a (Descartes). Bisection by that count isolates the greatest roots; a root alone in its interval is
   narrowed by the sign of exact values, a bundle that stays together by the count.
4. One task per interval solves M - e in decimal arithmetic of ``DIGITS`` digits (null-space inverse iteration, two steps from
   fixed starts). Roots within 2^-``BITS`` of the greatest root are one interval; they get orthonormal vectors of their common space.
5. Rows are centred (n x - S, exact), projected and divided by the root's square root. Their covariance is measured over all rows.

What is collected grows with the dimensions only: sums of products, residues of coefficients, 32 components.

Defined cases: rows with a null vector or a null or non-finite entry are dropped; so are vectors of another length than the most
frequent one (the longer of two equally frequent), which have no place in one matrix. Entries beyond the range of long integers after
scaling take its nearest end. A ``deviation`` beyond long is null. Components of eigenvalue zero cannot be whitened and are left out, so
one row, equal rows, vectors without entries and an empty table give an empty result. Repeated rows count and are returned each time, a null
``vec_id`` is kept. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import Batches, durable

SCALE = 64
COMPONENTS = 32
BITS = 240
DIGITS = 220
LIMB_BITS = 20
SUM_BITS = 40
SUM_LIMBS = 6
CHUNK_ROWS = 4_096
PRIMES_PER_TASK = 8

SUMS = ", ".join(["i int", "j int", *(f"l{k} long" for k in range(SUM_LIMBS))])


# ---- exact sums --------------------------------------------------------------

def whole_entries(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of all entries, a row per vector."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    scaled = np.floor(values * SCALE)
    out = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    out[scaled >= 2.0**63] = 2**63 - 1
    return out


def limbs(rows: np.ndarray) -> list[np.ndarray]:
    """The entries as a sum of limbs times powers of 2^LIMB_BITS, as doubles; one limb when all are small."""
    if not rows.size or (rows.max() < 1 << LIMB_BITS and rows.min() > -(1 << LIMB_BITS)):
        return [rows.astype(np.float64)]
    low = [(rows >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(3)]
    return [x.astype(np.float64) for x in [*low, rows >> (3 * LIMB_BITS)]]


def product_sums(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns (a one in front gives the sums and the count), as Python integers."""
    d = rows.shape[1] + 1
    total = np.zeros((d, d), object)
    for start in range(0, len(rows), CHUNK_ROWS):
        part = rows[start : start + CHUNK_ROWS]
        part = np.column_stack([np.ones(len(part), np.int64), part])
        # Limbs are below 2^20 (the last may be negative), 4096 products of two of them stay below 2^53.
        cut = limbs(part)
        for x, a in enumerate(cut):
            for y, b in enumerate(cut):
                exact = (a.T @ b).astype(np.int64).astype(object)
                total += exact << (LIMB_BITS * (x + y)) if x + y else exact
    return total


def sum_rows(total: np.ndarray) -> pa.RecordBatch:
    """A row per product sum of the upper triangle, in limbs whose last one carries the sign."""
    i, j = np.triu_indices(len(total))
    values = total[i, j].tolist()
    columns = [pa.array(i.astype("i4")), pa.array(j.astype("i4"))]
    for k in range(SUM_LIMBS):
        last = k == SUM_LIMBS - 1
        columns.append(pa.array([v >> (SUM_BITS * k) if last else (v >> (SUM_BITS * k)) & ((1 << SUM_BITS) - 1) for v in values], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"l{k}" for k in range(SUM_LIMBS))])


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, integer scatter matrix) of the column ``vector``."""

    def run(batches: Batches) -> Batches:
        total, seen = np.zeros((d + 1, d + 1), object), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + product_sums(whole_entries(batch.column("vector"), d)), True
        if seen:
            yield sum_rows(total)

    sums = vectors.select("vector").mapInArrow(run, SUMS).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(SUM_LIMBS)])
    products = [[0] * (d + 1) for _ in range(d + 1)]
    for row in sums.collect():  # (d + 1)(d + 2) / 2 rows
        value = sum(row[f"l{k}"] << (SUM_BITS * k) for k in range(SUM_LIMBS))
        products[row.i][row.j] = products[row.j][row.i] = value
    n, s = products[0][0], products[0][1:]
    return n, s, [[n * products[i + 1][j + 1] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ---- characteristic polynomial -----------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.4e14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The greatest primes of 31 bits whose product has more than ``bits`` bits."""
    found, n, have = [], 2**31 - 1, 0.0
    while have <= bits:
        if is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, greatest power first, of det(x - matrix) modulo ``p``, by Hessenberg reduction."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, lowest power first.
    made = [np.zeros(d + 1, np.int64)]
    made[0][0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = made[k][:-1]
        new = (new - h[k, k] * made[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            new = (new - int(h[i, k]) * product % p * made[i]) % p
        made.append(new)
    return made[d][::-1].tolist()


def coefficient_bits(matrix: list[list[int]]) -> int:
    """More bits than any coefficient has: the k-th is at most binomial(d, k) (trace / d)^k, as no eigenvalue is negative."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max((math.comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 2


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, greatest power first; a Spark task works through ``PRIMES_PER_TASK`` primes."""
    d = len(matrix)
    primes = primes_for(coefficient_bits(matrix))

    def run(batches: Batches) -> Batches:
        whole = np.array(matrix, object).reshape(d, d)
        for batch in batches:
            for p in batch.column("p").to_pylist():
                made = polynomial_mod((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([made], pa.list_(pa.int64()))], names=["p", "residues"])

    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, len(primes) // PRIMES_PER_TASK))
    residues = {r.p: r.residues for r in listed.mapInArrow(run, "p long, residues array<long>").collect()}
    total = math.prod(primes)
    shares = [(total // p) * pow(total // p, -1, p) for p in primes]
    values = [sum(s * residues[p][k] for p, s in zip(primes, shares)) % total for k in range(d + 1)]
    return [v - total if v > total // 2 else v for v in values]


# ---- roots -------------------------------------------------------------------

def shifted(poly: list[int], at: int) -> list[int]:
    """The coefficients of poly(x + at), by repeated synthetic division."""
    out = list(poly)
    for last in range(len(out) - 1, 0, -1):
        for k in range(1, last + 1):
            out[k] += at * out[k - 1]
    return out


def roots_above(poly: list[int], at: int) -> int:
    """How many roots exceed ``at``, with their multiplicity, when all roots are real."""
    signs = [c > 0 for c in shifted(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(poly: list[int], at: int) -> int:
    value = 0
    for c in poly:
        value = value * at + c
    return (value > 0) - (value < 0)


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times those of ``poly``."""
    return [c << (bits * k) for k, c in enumerate(poly)]


def greatest_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(low, high, multiplicity) of the greatest positive roots, greatest first, in units of 2^-shift of ``root_shift``.

    Each interval (low, high] holds that many roots and is at most 2^-BITS of the greatest root wide, or a point.
    """
    poly = list(poly)
    while len(poly) > 1 and poly[-1] == 0:
        poly.pop()
    found: list[tuple[int, int, int]] = []
    degree = len(poly) - 1
    if not degree:
        return found
    top = 1 << max(0, (-poly[1]).bit_length())  # the trace
    fine, unit = scaled(poly, root_shift(poly)), root_shift(poly)
    # Intervals are bisected at the coarsest power of two that still splits them.
    waiting = [(0, top << unit, 0, degree)]  # (low, high, roots above high, roots above low)
    taken = 0
    width = max(1, (top << unit) >> (BITS + 1))
    while waiting and taken < wanted:
        low, high, above_high, above_low = waiting.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:
            sign = value_sign(fine, high)
            while sign and high - low > width:
                middle = (low + high) // 2
                here = value_sign(fine, middle)
                if here == 0 or here == sign:
                    high, sign = middle, here
                else:
                    low = middle
            found.append((high if not sign else low, high, 1))
            taken += 1
        elif high - low <= width:
            found.append((low, high, inside))
            taken += inside
        else:
            middle = (low + high) // 2
            split = _count(poly, fine, middle, unit)
            waiting.append((low, middle, split, above_low))
            waiting.append((middle, high, above_high, split))
    return found


def root_shift(poly: list[int]) -> int:
    """Bits after the point that roots are held with."""
    return max(0, BITS + 2 - (-poly[1]).bit_length())


def _count(poly: list[int], fine: list[int], at: int, unit: int) -> int:
    """Roots above ``at``; early points are whole numbers, where the unscaled polynomial has shorter coefficients."""
    if unit and at % (1 << unit) == 0:
        return roots_above(poly, at >> unit)
    return roots_above(fine, at)


# ---- components --------------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors of the space that ``matrix`` - ``root`` nearly annuls."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS, Emin=-(10**9), Emax=10**9)):
        a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        for i in range(d):
            a[i, i] -= root
        tiny = max(root, Decimal(1)).scaleb(-DIGITS // 2)
        b = np.array([[Decimal((i * 7919 + k * 104_729 + 1) % 1009 - 504) for k in range(count)] for i in range(d)], object).reshape(d, count)
        order = []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            order.append(pivot)
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                factors = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= np.multiply.outer(factors, a[k, k + 1 :])
                a[k + 1 :, k] = factors
        for _ in range(2):
            for k, pivot in enumerate(order):
                if pivot != k:
                    b[[k, pivot]] = b[[pivot, k]]
            for k in range(d - 1):
                b[k + 1 :] -= np.multiply.outer(a[k + 1 :, k], b[k])
            for k in range(d - 1, -1, -1):
                b[k] = b[k] / a[k, k]
                if k:
                    b[:k] -= np.multiply.outer(a[:k, k], b[k])
            for x in range(count):
                for _ in range(2):
                    for y in range(x):
                        b[:, x] = b[:, x] - b[:, y] * (b[:, x] * b[:, y]).sum()
                    b[:, x] = b[:, x] / (b[:, x] * b[:, x]).sum().sqrt()
        for x in range(count):
            lead = max(range(d), key=lambda i: abs(b[i, x]))
            if b[lead, x] < 0:
                b[:, x] = -b[:, x]
        return [list(b[:, x]) for x in range(count)]


def components(spark, matrix: list[list[int]], wanted: int = COMPONENTS) -> tuple[list[float], list[float], np.ndarray]:
    """(square roots of the greatest eigenvalues, their shares of the trace, their unit vectors as rows)."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [], [], np.zeros((0, d))
    poly = characteristic_polynomial(spark, matrix)
    shift = root_shift(poly)
    bundles = greatest_roots(poly, wanted)
    listed = [(k, str(low + high), count) for k, (low, high, count) in enumerate(bundles)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                with localcontext(Context(prec=DIGITS, Emin=-(10**9), Emax=10**9)):
                    root = Decimal(row["twice"]) / (1 << (shift + 1))
                    size, share = float(root.sqrt()), float(root / trace)
                vectors = [[float(v) for v in vector] for vector in null_vectors(matrix, root, row["n"])]
                yield pa.RecordBatch.from_pydict(
                    {"k": [row["k"]] * row["n"], "x": list(range(row["n"])), "size": [size] * row["n"], "share": [share] * row["n"], "vector": vectors},
                    schema=pa.schema([("k", pa.int32()), ("x", pa.int32()), ("size", pa.float64()), ("share", pa.float64()), ("vector", pa.list_(pa.float64()))]),
                )

    tasks = spark.createDataFrame(listed, "k int, twice string, n int").repartition(max(1, len(listed)), "k")
    rows = tasks.mapInArrow(run, "k int, x int, size double, share double, vector array<double>").collect()  # about ``wanted`` rows
    rows = sorted(rows, key=lambda r: (r.k, r.x))[:wanted]
    return [r.size for r in rows], [r.share for r in rows], np.array([r.vector for r in rows]).reshape(-1, d)


# ---- whitening ---------------------------------------------------------------

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vector = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).filter(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == d)
    n, sums, matrix = scatter(rows, d)
    sizes, shares, vectors = components(spark, matrix, wanted)
    if not sizes:
        return spark.createDataFrame([], schema)
    weights = vectors.T / np.array(sizes)
    most = max(map(abs, sums))

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int | None]]:
        """n x - S as doubles, and the exact sum of its squares."""
        x = whole_entries(batch.column("vector"), d)
        largest = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + most
        if largest**2 * d < 2**63:
            exact = x * n - np.array(sums, np.int64)
            return exact.astype(np.float64), (exact * exact).sum(axis=1).tolist()
        exact = x.astype(object) * n - np.array(sums, object)
        squares = [int(v) for v in (exact * exact).sum(axis=1)]
        return exact.astype(np.float64), [v if v < 2**63 else None for v in squares]

    k = len(sizes)

    def moments(batches: Batches) -> Batches:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            made = np.column_stack([np.ones(batch.num_rows), centred(batch)[0] @ weights])
            total += made.T @ made
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(total[i, j])], names=["i", "j", "v"])

    measured = {(r.i, r.j): r.v for r in rows.select("vector").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    # The rows are centred already; what rounding left of their mean is taken off.
    mean = [measured[0, i + 1] / n for i in range(k)]
    error = max(abs(measured[i + 1, j + 1] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))

    def project(batches: Batches) -> Batches:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                exact, squares = centred(batch)
                m = batch.num_rows
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((exact @ weights).ravel()),
                    pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ], names=[part.split()[0] for part in schema.split(", ")])

    return rows.mapInArrow(project, schema)
