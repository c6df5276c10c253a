"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Quality rules drop documents, then toxicity; one document of each near-duplicate class stays; documents that
leak a benchmark item go; the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedback_spark.llm import host_rules, leak_search, merge_tree, ngram_join, toxicity
from feedback_spark.llm.frames import durable, importable, table
from feedback_spark.session import shared_path

VOCABULARY = "word_bpe_49k.json"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``text`` and ``needed``, with all columns but the text in one struct, whose names meet no operator's working names."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("rest"), "text", *needed)


def unpacked(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were."""
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is kept."""
    importable(spark)
    return unpacked(host_rules.judge(packed(docs, "source")).filter("kept"), docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is learnt from the labelled ones among them."""
    importable(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).filter("predicted = 0"), docs)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    importable(spark)
    return ngram_join.keep_one(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    importable(spark)
    return leak_search.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded) of each document.

    The ids are stored before they are decoded: both steps in one Spark stage would keep two Python workers per core alive, each
    with its own vocabulary, for this stage and those after it.
    """
    importable(spark)
    path = public_tokenizers.path(VOCABULARY)
    ids = durable(merge_tree.encode(docs.select("doc_id", "source", "text"), path).select("doc_id", "source", "ids"), "ids")
    return merge_tree.decode(ids, path).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", non_toxic),
    ("ngram_join", one_per_class),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

# Learnt scores, BM25 retrieval and BPE have no SQL form; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are stored below the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
