"""Keyword hits of long lists by automaton."""

import random

import pytest
from pyspark.sql import functions as F

from feedback_spark.operators import keywords, word_hits

LEVELS = ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative", None]


def plain(rows, words):
    out = {}
    for word in {w for w in words if w is not None}:
        held = [p or "" for text, p in rows if word in (text or "").lower()]
        out[word] = (sum("Positive" in p for p in held), sum("Negative" in p for p in held))
    return out


@pytest.mark.parametrize("block", [4_000_000, 40, 1])
def test_hits_equal_a_search_per_word(spark, frame, block):
    rng = random.Random(block)
    rows = [("".join(rng.choices("abAB é漢", k=rng.randrange(30))), rng.choice(LEVELS)) for _ in range(200)] + [(None, "Positive"), ("", "Negative")]
    words = ["", None, "a", "ab", "b", "aba", "é", "漢a", "a b", "zz", "A"] + ["".join(rng.choices("ab", k=4)) for _ in range(12)]
    texts = frame("text string, polarity string", *rows).repartition(3)
    listed = frame("word string, other int", *[(w, 1) for w in words + words[:5]])
    made = {r.word: (r.pos_hits, r.neg_hits) for r in word_hits.word_hits(texts, listed, block_characters=block).collect()}
    assert made == plain(rows, words)


def test_empty_inputs(frame):
    texts, words = frame("text string, polarity string", ("a", "Positive")), frame("word string", ("a",))
    assert word_hits.word_hits(texts, words.limit(0)).count() == 0
    assert [tuple(r) for r in word_hits.word_hits(texts.limit(0), words).collect()] == [("a", 0, 0)]


def test_long_and_short_lists_agree(frame):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("red green blue black white".split(), k=5)), rng.choice(LEVELS[:5])) for i in range(90)]
    texts = frame("row_index long, text string, polarity string", *rows)
    top = frame("word string, n long", ("red", 9), ("green", 9), ("lack", 4), ("purple", 1))
    short = keywords.keyword_hits(keywords.keyword_marks(texts, top)).orderBy("rank")
    long = word_hits.keyword_hits(texts, top).orderBy("rank")
    assert long.collect() == short.select(long.columns).collect() and dict(long.dtypes) == dict(short.dtypes)


def test_texts_are_read_once_for_a_list_of_thousands(spark, frame):
    words = frame("word string", *[(f"w{i}",) for i in range(5000)])
    texts = frame("text string, polarity string", *[(f"w{i} w{i + 1}", "Positive") for i in range(300)])
    made = word_hits.word_hits(texts, words)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    hits = {r.word: r.pos_hits for r in made.filter(F.col("pos_hits") > 0).collect()}
    assert hits == {w: n for w, (n, _) in plain([(f"w{i} w{i + 1}", "Positive") for i in range(300)], [f"w{i}" for i in range(5000)]).items() if n}
