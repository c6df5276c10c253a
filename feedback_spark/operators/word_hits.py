"""Which words of a list of any length each text holds, in one pass over the texts.

A task builds an Aho-Corasick automaton over the words once and runs each text through it once, so its work is the length
of the texts and not their length times the number of words. A task sends one row per word it found, with its counts.

The list is dealt by hash into blocks of at most about ``BLOCK_CHARACTERS``; each block is one more pass over the texts. So
what the driver and a task hold at a time stays bounded however long the list grows, and no word is left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedback_spark.functions.labels import polarity_group
from feedback_spark.session import by_value
from feedback_spark.sources import row_keys

by_value(__name__)

# An automaton takes some 50 bytes per letter.
BLOCK_CHARACTERS = 4_000_000
COUNTED = "at int, pos_hits long, neg_hits long"


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds the places of ``words``, which are not empty, in the list."""
    made = ahocorasick.Automaton()
    for at, word in enumerate(words):
        made.add_word(word, at)
    made.make_automaton()
    return made


def _counted(texts: DataFrame, words: list[str]) -> DataFrame:
    """COUNTED of (low, side); a word counts once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(words)
        pos, neg = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for batch in batches:
            for low, side in zip(batch.column("low"), batch.column("side").to_pylist()):
                at = list({at for _, at in found.iter(low.as_py())})
                (pos if side == "positive" else neg)[at] += 1
        at = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(neg[at])], names=["at", "pos_hits", "neg_hits"]
        )

    sided = texts.filter(F.col("side").isin("positive", "negative"))
    sums = sided.mapInArrow(run, COUNTED).groupBy("at")
    return sums.agg(F.sum("pos_hits").alias("pos_hits"), F.sum("neg_hits").alias("neg_hits"))


def word_hits(
    texts: DataFrame, words: DataFrame, text_column: str = "text", block_characters: int = BLOCK_CHARACTERS
) -> DataFrame:
    """(word, pos_hits, neg_hits): for each different word the positive and negative texts that hold it.

    ``texts`` has ``text_column`` and ``polarity``. A word counts wherever it stands, also inside a longer one, as it is
    written against the text in lower case. A null word is left out; the empty word stands in every text; a null text is
    empty; a null polarity is on neither side.
    """
    spark = texts.sparkSession
    low = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    sided = texts.select(low.alias("low"), polarity_group(F.col("polarity")).alias("side"))
    listed = words.select("word").filter("word IS NOT NULL").distinct()
    size = listed.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    blocks = -(-size // block_characters)
    out = spark.createDataFrame([], "word string, pos_hits long, neg_hits long")
    for block in range(blocks):
        own = listed.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block)
        # About ``block_characters`` letters, whatever the length of the list.
        held = [r.word for r in own.collect()]
        full = [w for w in held if w]
        if full:
            places = spark.createDataFrame(list(enumerate(full)), "at int, word string")
            counted = places.join(_counted(sided, full), "at", "left")
            out = out.unionByName(counted.select("word", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pos_hits", "neg_hits")]))
        if len(full) < len(held):
            of = lambda side: F.count_if(F.col("side") == side).alias(f"{side[:3]}_hits")
            out = out.unionByName(sided.agg(of("positive"), of("negative")).select(F.lit("").alias("word"), "pos_hits", "neg_hits"))
    return out


def keyword_hits(texts: DataFrame, top: DataFrame, text_column: str = "text", key: str = "row_index") -> DataFrame:
    """(rank, word, n, pos_hits, neg_hits, first_polarity) of a ranked list (word, n) of any length.

    The rows are those of ``keywords.keyword_hits``, whose expressions serve short lists without Python. Ranks come from
    range partitions and their counts, so a long list is not sorted in one task.
    """
    ordered = row_keys.row_index(top.select((-F.col("n")).alias("minus"), "word"), "minus", "word", name="place")
    ranked = ordered.select((F.col("place") + 1).cast("int").alias("rank"), "word", (-F.col("minus")).alias("n"))
    first = texts.agg(F.min_by("polarity", key)).scalar()
    hits = word_hits(texts, top, text_column)
    return ranked.join(hits, "word").select("rank", "word", "n", "pos_hits", "neg_hits", first.alias("first_polarity"))
