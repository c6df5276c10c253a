"""Topics by variational Bayes against Spark ML's own."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from feedback_spark.operators import topics, variational


def documents(n=60, seed=5):
    """Documents of two kinds, of one to sixty words; one has no word at all."""
    rng = random.Random(seed)
    return [(i, [f"{'ab'[i % 2]}{rng.randrange(15)}" for _ in range(0 if i == 7 else rng.randrange(1, 60))]) for i in range(n)]


@pytest.mark.parametrize("parts", [3, 40])
def test_model_and_shares_are_those_of_spark(spark, frame, parts):
    """Same samples, initial values, steps and priors; with 40 partitions the sums of tasks are added up in two steps."""
    lists = frame("doc_id long, terms array<string>", *documents()).repartitionByRange(parts, "doc_id")
    fitted = topics.fit_topics(lists, k=3, iterations=6)
    place = {int(b): i for i, b in enumerate(fitted.used)}
    bucket = topics.bucket_of(F.col("term"), topics.BUCKETS).cast("int").alias("b")
    number = {r.term: place[r.b] for r in lists.select(F.explode("terms").alias("term")).select("term", bucket).distinct().collect()}
    kind = StructType([StructField("doc_id", LongType()), StructField("features", VectorUDT())])

    def vector(terms):
        counts = {}
        for t in terms:
            counts[number[t]] = counts.get(number[t], 0) + 1
        return SparseVector(len(place), counts)

    vectors = spark.createDataFrame(lists.rdd.map(lambda r: (r.doc_id, vector(r.terms))), kind)
    model = LDA(k=3, seed=topics.SEED, maxIter=6, optimizer="online", subsamplingRate=1.0).fit(vectors)
    assert np.allclose(fitted.model.weights, model.topicsMatrix().toArray().T, rtol=1e-7)
    want = {r.doc_id: r.topicDistribution.toArray() for r in model.transform(vectors).collect()}
    made = {r.doc_id: r.shares for r in variational.document_shares(fitted.model, fitted.documents).collect()}
    assert made.keys() == want.keys() and all(np.allclose(made[i], want[i], atol=1e-7) for i in want)
    fitted.release()


def test_inference_does_not_depend_on_the_other_documents():
    """Documents of one to many words, taken together, in blocks of few cells or one by one."""
    rng = np.random.default_rng(3)
    sizes = np.r_[rng.integers(1, 9, 40), 700, 3, 250]
    words, counts = (rng.integers(low, high, sizes.sum()) for low, high in ((0, 90), (1, 4)))
    beta, alpha, first = rng.random((90, 3)), np.array([0.3, 0.2, 0.4]), np.array([1.0, 0.9, 1.1])
    gamma, theta, ratio = variational.inferred(words, counts, sizes, beta, alpha, first)
    at = 0
    for i, n in enumerate(sizes):
        one = variational.inferred(words[at : at + n], counts[at : at + n], np.array([n]), beta, alpha, first)
        assert np.allclose(gamma[i], one[0]) and np.allclose(theta[i], one[1]) and np.allclose(ratio[at : at + n], one[2])
        at += n


def test_grid_of_digamma_equals_the_series():
    x = np.exp(np.linspace(-5, 15, 5001))
    assert np.allclose(variational.exp_digamma(x), np.exp(variational.digamma(x)), rtol=1e-9)
