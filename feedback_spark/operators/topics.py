"""Topics by latent Dirichlet allocation, their labels and sentiment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedback_spark.functions.labels import polarity_group
from feedback_spark.functions.numbers import whole_percent
from feedback_spark.functions.text import title_case
from feedback_spark.operators import gibbs, variational
from feedback_spark.session import durable

# Size of the model and of the reported lists.
TOPICS = 3
TERMS = 8
LABEL_TERMS = 3
SEED = 1234
ITERATIONS = 20
# Words share this many hash buckets, so neither vectors nor model grow with the vocabulary.
BUCKETS = 1 << 16


@dataclass(frozen=True)
class TopicModel:
    """A fitted model; ``documents`` are the kept bags of words it was fitted on, by key, ``lists`` their terms."""

    model: variational.VariationalModel
    lists: DataFrame
    documents: DataFrame
    used: list[str]
    buckets: int

    def release(self) -> None:
        """Drop the kept vectors once the results have been used or stored."""
        self.documents.unpersist()


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("string")


def fit_topics(
    lists: DataFrame,
    k: int = TOPICS,
    *,
    key: str = "doc_id",
    buckets: int = BUCKETS,
    iterations: int = ITERATIONS,
    seed: int = SEED,
) -> TopicModel | None:
    """Fit on (key, terms) rows; None when fewer than two topics can be told apart.

    Each iteration samples as many documents as there are, with replacement, as Spark's optimizer does. Terms are hashed
    to ``buckets`` features: the driver holds the used buckets and one weight per
    topic and bucket, whatever the vocabulary. Two words in one bucket count as
    one word to the model; ``topic_beta`` tells them apart again.
    """
    numbers = F.transform("terms", lambda t: bucket_of(t, buckets).cast("int"))
    documents = variational.bags(lists, key, numbers).persist(StorageLevel.MEMORY_AND_DISK)
    n_parts = documents.rdd.getNumPartitions()
    found, n = variational.used_buckets(documents, buckets, n_parts)
    use = min(k, n - 1)
    if not len(found) or use < 2:
        documents.unpersist()
        return None
    used = sorted(map(str, found.tolist()))  # initial values are drawn in the order of names
    model = variational.fit(documents, np.array(used, np.int64), use, buckets, n_parts, iterations=iterations, seed=seed)
    return TopicModel(model, lists, documents, used, buckets)


def term_weights(lists: DataFrame, shares: DataFrame, chosen: list[str], buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """(bucket, term, weights) of all words in the ``chosen`` buckets: per topic their counts, each weighed by the topic's share of its document.

    ``shares``: (key, shares). Shares are summed in billionths, so any order of rows gives the same sums.
    """
    bucket = bucket_of(F.col("term"), buckets)
    words = lists.select(key, F.explode("terms").alias("term")).filter(bucket.isin(chosen))
    per_document = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = per_document.join(shares, key).select(
        "term", F.posexplode(F.transform("shares", lambda s: F.rint(s * 1e9).cast("long"))).alias("topic", "share"), "n"
    )
    summed = weighed.groupBy("term", "topic").agg(F.sum(F.col("share") * F.col("n")).alias("weight"))
    return summed.withColumn("bucket", bucket)


def split_beta(found: list[tuple[int, str, float]], weights: DataFrame) -> DataFrame:
    """(topic, term, beta): each bucket's beta split over its words by their weights in the topic."""
    heavy = weights.sparkSession.createDataFrame(found, "topic int, bucket string, whole double")
    in_bucket = Window.partitionBy("topic", "bucket")
    joined = weights.withColumn("topic", F.col("topic") + 1).join(F.broadcast(heavy), ["topic", "bucket"])
    part = F.col("weight") / F.greatest(F.sum("weight").over(in_bucket), F.lit(1))
    return joined.select("topic", "term", (F.col("whole") * part).alias("beta"))


def split_terms(ranked, lists: DataFrame, shares: DataFrame, n_buckets: int, limit: int, buckets: int, key: str = "doc_id") -> DataFrame:
    """The leading terms of all topics when buckets are split, ties at the last place kept.

    ``ranked(m)`` gives (topic, bucket, beta) of each topic's ``m`` heaviest buckets. A word is no heavier than its bucket, so the list
    is complete once the last bucket looked at is lighter than the last term listed; until then twice as many are asked for.
    """
    asked = min(4 * limit, n_buckets)
    while True:
        found = ranked(asked)
        chosen = sorted({b for _, b, _ in found})
        terms = durable(top_terms_ties(split_beta(found, term_weights(lists, shares, chosen, buckets, key)), limit), "topic_terms")
        lightest: dict[int, float] = {}
        for topic, _, beta in found:
            lightest[topic] = min(beta, lightest.get(topic, beta))
        # One row per topic.
        listed = {r.topic: r for r in terms.groupBy("topic").agg(F.min("beta").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
        if asked == n_buckets or all(t in listed and listed[t].n >= limit and lightest[t] < listed[t].least for t in lightest):
            return terms
        asked = min(2 * asked, n_buckets)


def topic_beta(fitted: TopicModel, limit: int = TERMS) -> DataFrame:
    """(topic, term, beta) of the leading terms, ties at the last place kept; words that share a bucket share its weight."""
    shares = variational.document_shares(fitted.model, fitted.documents)
    ranked = heaviest(fitted.model.beta(), fitted.used)
    return split_terms(ranked, fitted.lists, shares, len(fitted.used), limit, fitted.buckets, fitted.documents.columns[0])


def heaviest(beta: np.ndarray, used: list[str]):
    """``ranked`` of ``split_terms`` for the weights of each topic's buckets."""
    def ranked(asked: int) -> list[tuple[int, str, float]]:
        return [(t + 1, used[i], float(row[i])) for t, row in enumerate(beta) for i in np.argsort(-row, kind="stable")[:asked].tolist()]

    return ranked


def gibbs_beta(
    lists: DataFrame, k: int = TOPICS, *, limit: int = TERMS, key: str = "doc_id", buckets: int = BUCKETS, seed: int = SEED, **sweeps: float
) -> DataFrame | None:
    """``topic_beta`` of topics found by collapsed Gibbs sampling over (key, terms); None when fewer than two topics can be told apart.

    ``sweeps``: burn_in, sweeps, thin, alpha and delta of ``gibbs.fit``.
    """
    numbered = lists.select(
        F.col(key).cast("long").alias("key"), F.transform("terms", lambda t: bucket_of(t, buckets).cast("int")).alias("words")
    )
    used = [r.word for r in numbered.select(F.explode("words").alias("word")).distinct().orderBy("word").collect()]  # at most ``buckets``
    use = min(k, lists.limit(k + 1).count() - 1)
    if not used or use < 2:
        return None
    fitted = gibbs.fit(numbered, use, buckets, vocabulary=len(used), seed=seed, **sweeps)
    shares = gibbs.document_shares(fitted).withColumnRenamed("key", key)
    return split_terms(heaviest(fitted.beta[:, used], list(map(str, used))), lists, shares, len(used), limit, buckets, key)


def top_terms_ties(table: DataFrame, limit: int = TERMS, group: str = "topic", weight: str = "beta") -> DataFrame:
    """The ``limit`` heaviest rows of each group and all that tie with the last.

    A rank filter right above the window lets Spark cut each partition to its
    leading rows before the shuffle (window group limit).
    """
    place = F.rank().over(Window.partitionBy(group).orderBy(F.desc(weight)))
    return table.withColumn("place", place).filter(F.col("place") <= limit)


def topic_terms(ranked: DataFrame) -> DataFrame:
    """(topic, terms): names of the leading terms, heaviest first, ties by name."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("beta")).alias("rank"), "term")))
    return ranked.groupBy("topic").agg(F.transform(listed, lambda t: t["term"]).alias("terms"))


def topic_label(topic: Column, terms: Column) -> Column:
    named = F.array_join(F.slice(terms, 1, LABEL_TERMS), ", ")
    shown = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, named)
    return title_case(F.coalesce(shown, F.concat(F.lit("topic "), topic.cast("string"))))


def topic_labels(terms: DataFrame) -> DataFrame:
    """(topic, label, number) with the number as two digits."""
    return terms.select(
        "topic",
        topic_label(F.col("topic"), F.col("terms")).alias("label"),
        F.lpad(F.col("topic").cast("string"), 2, "0").alias("number"),
    )


def dominant_topics(fitted: TopicModel, key: str = "doc_id") -> DataFrame:
    """(key, topic, weight, topics): the heaviest topic and all weights of each document."""
    weights = F.col("shares")
    listed = F.transform(weights, lambda w, i: F.struct((i + 1).alias("topic_id"), w.alias("weight")))
    best = F.array_position(weights, F.array_max(weights)).cast("int")
    return variational.document_shares(fitted.model, fitted.documents).select(
        key, best.alias("topic"), F.array_max(weights).alias("weight"), listed.alias("topics")
    )


SIDES = ["positive", "neutral", "negative"]


def sentiment_profile(entries: DataFrame, *by: str) -> DataFrame:
    """(…, positive, neutral, negative) counts of the corpus or of each group."""
    side = polarity_group(F.col("polarity"))
    return entries.groupBy(*by).agg(*[F.count_if(side == s).alias(s) for s in SIDES])


def topic_profile(polarities: DataFrame, topics: DataFrame, mode: str = "global", key: str = "doc_id") -> DataFrame:
    """Profile of each topic: of the whole corpus, or of the documents it dominates.

    ``topics`` holds (key, topic) for ``per_topic`` and (topic) for ``global``.
    """
    if mode == "per_topic":
        return sentiment_profile(polarities.join(topics.select(key, "topic"), key), "topic")
    counts = sentiment_profile(polarities).select(F.struct(*SIDES).alias("p")).scalar()
    return topics.select("topic").distinct().withColumn("p", counts).select("topic", "p.*")


def topic_share(profile: DataFrame, by: str = "topic") -> DataFrame:
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    return profile.select(
        by,
        whole_percent(F.col("positive"), total).alias("pos_pct"),
        whole_percent(F.col("negative"), total).alias("neg_pct"),
    )
