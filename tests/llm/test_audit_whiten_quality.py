"""Filter audit, whitening of embeddings and quality from positive-unlabelled learning."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from check import connect, difference
from feedback_spark.llm import filter_audit, pu_quality, queries, whitening

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


# ---- filter audit ------------------------------------------------------------

def plain_audit(docs, labels):
    """Applies every order step by step to the documents themselves."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in range(2))
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((part or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order):
                gone = [r for r in own if r[1] & set(order[:step])]
                here = [r for r in own if c in r[1] and not r[1] & set(order[:step])]
                kept = len(own) - len(gone) - len(here)
                out[part, order, step + 1] = (
                    kept, len(here), sum(c in r[1] for r in gone), sum(r[1] == {c} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)
                )
                shapley[part, c] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in filter_audit.audit(docs, labels).collect()}


def test_audit_equals_every_order_applied(frame):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long, None), (3, long, ""), (4, "a a a a a", "en"), (5, "ABC #", "de"), (6, None, "de"), (7, "", "en"),
        (8, "x | y", "en"), (None, long, "en"), (None, "", "de"), (9, long + " $", "en"), (10, long.upper(), "de"), (2, long, "en"), (11, "word " * 300, "de"),
        (12, "   ", "en"), (13, "no break", "en"), (1, long, "de"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (9, 1, 0), (99, 1, 1), (10, 1, 1)]
    given = frame("doc_id long, text string, lang string", *docs), frame("doc_id long, quality int, toxic int", *labels)
    assert audited(*given) == plain_audit(docs, labels)


def test_audit_of_no_rows_and_clashing_names(frame):
    labels = frame("doc_id long, quality int, toxic int, part string", (1, 1, 1, "x"))
    assert audited(frame("doc_id long, text string, lang string"), labels) == {}
    names = ["id", "part", "key", "own", "mask", "n", "good", "toxic", "g", "t", "prefix", "LANG_"]
    docs = frame("doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names), (1, "x #", "en", *["z"] * len(names)))
    assert audited(docs, labels.limit(0)) == plain_audit([(1, "x #", "en")], [])


def test_recursion_is_bounded_and_has_all_prefixes(frame):
    cells = frame("part string, mask int, n long", *[(f"p{i}", i % 32, 1) for i in range(500)])
    made = filter_audit.prefix_outcomes(cells)
    assert made.count() == 32 * 325 and made.select("prefix").distinct().count() == 325


def test_audit_query_equals_sql(spark):
    got = contract.queries()["op11_filter_audit"](spark, SMALL).toPandas()
    assert difference(got, connect(SMALL).execute(contract.oracle_sql()["op11_filter_audit"]).df()) is None


# ---- whitening ---------------------------------------------------------------

def plain_poly(matrix):
    """Exact coefficients by Faddeev and Le Verrier."""
    d = len(matrix)
    a, m, out = np.array(matrix, object).reshape(d, d), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * np.eye(d, dtype=object).astype(int).astype(object) if k > 1 else np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        out.append(-sum(a.dot(m)[i, i] for i in range(d)) // k)
    return out


def gram(rows):
    return [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


@pytest.mark.parametrize("seed, n, d", [(1, 20, 7), (2, 4, 9), (3, 1, 5)])
def test_polynomial_is_exact(spark, seed, n, d):
    matrix = gram(np.random.default_rng(seed).integers(-10**6, 10**6, (n, d)).tolist())
    assert whitening.characteristic_polynomial(spark, matrix) == plain_poly(matrix)


def test_primes_and_modular_polynomial():
    primes = whitening.primes_for(300)
    assert primes[0] == 2**31 - 1 and len(set(primes)) == len(primes) and all(p % q for p in primes for q in range(3, 2000, 2))
    shift = np.zeros((4, 4), np.int64)
    shift[3, 0] = shift[0, 1] = 5  # zero pivots
    p = primes[0]
    assert whitening.polynomial_mod(shift, p) == [c % p for c in plain_poly(shift.tolist())]


def test_roots_with_multiplicity_are_isolated():
    poly = [1]
    roots = [9, 9, 9, 4, 4, 1, 0, 0, 10**12, 10**12 - 1]
    for r in roots:
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly])]
    found = whitening.greatest_roots(poly, 32)
    unit = 1 << whitening.root_shift([c for c in poly])
    assert [(round((a + b) / 2 / unit), m) for a, b, m in found] == [(10**12, 1), (10**12 - 1, 1), (9, 3), (4, 2), (1, 1)]
    assert whitening.greatest_roots([1, 0, 0], 32) == []


def test_sums_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    for most in (100, 2**19, 2**40, 2**62):
        rows = rng.integers(-most, most, (70, 3))
        rows[0, 0] = -(2**63) if most == 2**62 else most
        full = [[1, *map(int, r)] for r in rows]
        assert whitening.product_sums(rows).tolist() == gram(full)


def whitened(made):
    rows = made.collect()
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whitening_against_numpy(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    table = df.collect()
    x = np.array([[math.floor(64 * c) for c in r.embedding] for r in table], float)
    n, centred = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    made = whitened(queries.QUERIES["op12_whitening"](spark, SMALL))
    assert len(made) == n
    for i, r in enumerate(table):
        got = made[r.vec_id]
        assert sorted(got) == list(range(1, 33))
        exact = [n * math.floor(64 * c) for c in r.embedding]
        assert got[1].deviation == sum((e - s) ** 2 for e, s in zip(exact, map(int, x.sum(axis=0)))) and got[1].n == n
        for k in range(32):
            want = centred[i] @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
            assert abs(abs(got[k + 1].whitened) - abs(want)) < 1e-6
            assert abs(got[k + 1].explained - values[-1 - k] / values.sum()) < 1e-12 and got[k + 1].identity_error < 1e-12


def test_equal_and_zero_eigenvalues(frame):
    """Four equal eigenvalues and a constant dimension: an orthonormal basis of their common space, no component of eigenvalue zero."""
    rows = [(k, [float(s) if j == k % 4 else 0.0 for j in range(4)] + [3.5]) for k, s in enumerate([1, 1, 1, 1, -1, -1, -1, -1])]
    made = whitened(whitening.whiten(frame("vec_id long, embedding array<float>", *rows)))
    table = np.array([[made[k][c].whitened for c in range(1, 5)] for k in range(8)])
    assert {len(v) for v in made.values()} == {4} and np.abs(table.T @ table / 8 - np.eye(4)).max() < 1e-12
    assert all(abs(r.explained - 0.25) < 1e-12 for v in made.values() for r in v.values())


def test_close_eigenvalues_are_told_apart(spark):
    """Eigenvalues a part in 10^15 apart still give their own vectors."""
    big = 10**15
    sizes, shares, vectors = whitening.components(spark, [[big, 0, 0], [0, big + 1, 0], [0, 0, 7]])
    assert np.abs(vectors - [[0, 1, 0], [1, 0, 0], [0, 0, 1]]).max() < 1e-100 and sizes[2] == math.sqrt(7)
    assert shares == [(big + 1) / (2 * big + 8), big / (2 * big + 8), 7 / (2 * big + 8)]


def test_whitening_of_awkward_rows(frame):
    schema = "vec_id long, embedding array<float>, vector string, component int"
    good = [(None, [1.0, 2.0], "x", 9), (2, [0.5, -7.0], "x", 9), (2, [0.5, -7.0], "x", 9), (3, [4.0, 1.0], "x", 9)]
    bad = [(4, None, "x", 9), (5, [None, 1.0], "x", 9), (6, [float("nan"), 1.0], "x", 9), (7, [float("inf"), 1.0], "x", 9), (8, [1.0], "x", 9), (9, [], "x", 9)]
    made = whitening.whiten(frame(schema, *good, *bad)).collect()
    assert Counter((r.vec_id, r.component) for r in made) == Counter({(None, 1): 1, (None, 2): 1, (2, 1): 2, (2, 2): 2, (3, 1): 1, (3, 2): 1})
    assert {r.n for r in made} == {4}
    for rows in ([], bad[:2], good[:1], good[1:3], [(1, [], "x", 9)]):
        assert whitening.whiten(frame(schema, *rows)).count() == 0
    huge = whitening.whiten(frame(schema, (1, [3e38, 1.0], "x", 9), (2, [-3e38, 2.0], "x", 9), (3, [1.0, 5.0], "x", 9))).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3) and huge[0].identity_error < 1e-9


# ---- quality from positives and unlabelled text --------------------------------

def test_held_out_quality(spark):
    rows = queries.QUERIES["op13_pu_quality"](spark, MIDDLE).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(told) > 80 and sum(p == q for p, q in told) / len(told) > 0.95
    assert sum(p == q for p, q in told if q == 0) / sum(q == 0 for _, q in told) > 0.8


def test_only_trusted_positives_are_learnt_from(spark, frame):
    """Negative labels and held-out labels change nothing."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    fold = pu_quality.held_out()
    other = labels.filter("quality = 1").filter(~fold).unionByName(docs.filter(fold).selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    scores = [{r.doc_id: round(r.score, 9) for r in pu_quality.score(docs, given).collect()} for given in (labels, other)]
    assert scores[0] == scores[1]


def test_prior_and_risk_on_two_clouds(spark):
    """Text of two known kinds, 70% good: prior and classes are found without a negative label."""
    rng = np.random.default_rng(3)
    clean = [" ".join(f"w{rng.integers(10**6)}" for _ in range(30)) + "." for _ in range(700)]
    junk = [" ".join("spam! $$$" for _ in range(12)) + f" {rng.integers(10**6)}" for _ in range(300)]
    texts = clean + junk
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 700, 3)], "doc_id long, quality int, toxic int")
    rows = pu_quality.feature_rows(docs, labels).coalesce(1).cache()
    model = pu_quality.learn(rows)
    assert abs(model.prior - 0.7) < 0.05
    table = rows.orderBy("doc_id").select("x").toArrow().combine_chunks().to_batches()[0]
    assert ((model.scores(table) >= 0.5) == (np.arange(1000) < 700)).sum() >= 995


def test_risk_is_the_stated_sum(spark):
    """The minimum found beats nearby weights under a plain version of the risk."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = pu_quality.feature_rows(docs, labels).coalesce(1).cache()
    scale, n, trusted = pu_quality.scale_of(rows)
    table = rows.collect()
    x = np.column_stack([np.ones(n), np.clip((np.array([r.x for r in table]) - scale.mean) / scale.spread, -8, 8)])
    good = np.array([r.trusted for r in table])
    assert trusted == good.sum()

    def risk(w):
        z = x @ w
        ridge = pu_quality.RIDGE * (w[1:] @ w[1:]) / 2 + 1e-6 * w[0] ** 2 / 2
        rest = np.logaddexp(0, z).mean() - 0.8 * np.logaddexp(0, z[good]).mean()
        return 0.8 * np.logaddexp(0, -z[good]).mean() + max(0, rest) + ridge

    w = pu_quality.minimise(rows, scale, n, trusted, 0.8)
    rng = np.random.default_rng(1)
    assert risk(w) < risk(np.zeros(len(w))) and np.mean([risk(w + rng.normal(0, 0.1, len(w))) > risk(w) - 1e-3 for _ in range(50)]) == 1


def test_quality_of_awkward_rows(frame, docs, no_docs):
    labels = frame("doc_id long, quality int, toxic int", (2, 1, 0), (2, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 1))
    made = pu_quality.score(docs, labels).collect()
    assert len(made) == docs.count() and all(0 <= r.score <= 1 for r in made)
    assert len({r.score for r in made if r.doc_id == 4}) == 1 and [r.held_out for r in made if r.doc_id is None] == [False]
    assert {r.score for r in pu_quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.score(no_docs, labels).count() == 0
    clashing = no_docs.withColumnRenamed("lang", "x").withColumnRenamed("source", "trusted").withColumnRenamed("ids", "score")
    assert pu_quality.score(clashing, labels).count() == 0
