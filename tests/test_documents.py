"""Cleaning, polarity, emotions and keywords on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from feedback_spark.operators import cleaning, emotions, entries, keywords, polarity, tokens
from feedback_spark.sources import lexicons
from feedback_spark.sources.lexicons import Shifters, inline_table


@pytest.fixture
def lists(spark):
    return lexicons.Lexicons(
        polarity=inline_table(spark, "word, sentiment", [("good", "positive"), ("great", "positive"), ("bad", "negative")]),
        weights=inline_table(spark, "word, weight", [("good", 0.5), ("great", 1.0), ("bad", -0.75)]),
        emotions=inline_table(spark, "word, sentiment", [
            ("good", "joy"), ("good", "trust"), ("good", "positive"), ("bad", "anger"), ("great", "joy")]),
        stops=inline_table(spark, "word", [("the",), ("and",)]),
        shifters=Shifters(("not",), ("very",), ("slightly",)),
    )


@pytest.fixture
def cleaned(frame):
    def build(*texts):
        rows = [(i, t, "neutral") for i, t in enumerate(texts)]
        return cleaning.clean_documents(frame("doc_id long, raw_text string, label string", *rows))

    return build


def scored(cleaned_frame, lists):
    got = polarity.hybrid_polarity(cleaned_frame, lists.polarity, lists.weights, lists.shifters)
    return {r.doc_id: r for r in got.collect()}


def test_build_documents_drops_blank_rows(frame):
    rows = frame("row_index long, t string, l string", (0, " a ", "pos"), (1, "   ", "neg"), (2, None, "neg"), (3, "b", "Odd"))
    got = cleaning.build_documents(rows, "t", labelled=True, label_column="l").orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, "a", "pos"), (3, "b", "odd")]
    with pytest.raises(ValueError, match="missing"):
        cleaning.build_documents(rows, "missing")


def test_a_dropped_row_does_not_shift_scores(cleaned, lists):
    got = scored(cleaned("good", "!!!", "bad", "plain"), lists)
    assert sorted(got) == [0, 2, 3]
    assert (got[0].positive, got[2].negative, got[3].polarity_score) == (1, 1, 0.0)
    assert got[3].polarity_class == "Neutral"


def test_scores_by_hand(cleaned, lists):
    got = scored(cleaned("very good course", "not good", "slightly not bad day", "bad not good"), lists)
    valence = [0.5 * 1.8 / math.sqrt(3), -0.5 / math.sqrt(2), 0.75 * 0.2 / math.sqrt(4), (0.75 - 0.5) / math.sqrt(3)]
    for i, want in enumerate(valence):
        assert got[i].valence_score == pytest.approx(want, abs=1e-12)
    assert got[0].bing_score == 0.5
    assert got[0].polarity_score == pytest.approx(0.65 * valence[0] + 0.35 * 0.5)
    assert got[0].word_count == 3


def test_shifters_reach_five_back_and_two_ahead(cleaned, lists):
    got = scored(cleaned("not a b c d good", "not a b c d e good", "good a not", "good a b not"), lists)
    assert [got[i].valence_score < 0 for i in range(4)] == [True, False, True, False]


def test_scores_against_a_plain_loop(cleaned, lists):
    """Every placing of shifters and hits in a text, against a direct computation."""
    import random

    rng = random.Random(7)
    texts = [" ".join(rng.choice("good great bad not very slightly x y".split()) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    got = scored(cleaned(*texts), lists)
    weight = {"good": 0.5, "great": 1.0, "bad": -0.75}
    for i, t in enumerate(texts):
        ws, total = t.split(), 0.0
        for p, w in enumerate(ws):
            near = ws[max(0, p - 5):p] + ws[p + 1:p + 3]
            scale = near.count("very") - near.count("slightly")
            total += weight.get(w, 0) * (-1) ** near.count("not") * max(0, 1 + 0.8 * scale)
        assert got[i].valence_score == pytest.approx(total / math.sqrt(len(ws)), abs=1e-9)


def test_a_long_word_list_gives_the_same_scores(spark, cleaned, lists):
    docs = cleaned("very good and not bad", "plain", "not slightly great x y z w bad")
    short = scored(docs, lists)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scored(docs, lists) == short
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_fine_weights_count_and_finer_ones_are_an_error(spark, cleaned, lists):
    def score(weight):
        weights = spark.createDataFrame([("fine", weight)], "word string, weight double")
        return polarity.hybrid_polarity(cleaned("fine fine"), lists.polarity, weights, lists.shifters).head().valence_score

    assert score(0.0004) == pytest.approx(0.0008 / math.sqrt(2), abs=1e-15)
    with pytest.raises(Exception, match="billionth"):
        score(2e-10)


def test_an_empty_corpus_has_a_summary(spark, cleaned, lists):
    nothing = cleaned("x").limit(0)
    made = polarity.corpus_summary(polarity.hybrid_polarity(nothing, lists.polarity, lists.weights, lists.shifters)).head()
    assert tuple(made) == (0, None, None, None)


def test_only_positive_hits_still_has_both_columns(cleaned, lists):
    counts = polarity.lexicon_counts(tokens.tokens(cleaned("good great", "good")), lists.polarity)
    wide = polarity.lexicon_pivot(counts)
    assert sorted(tuple(r) for r in wide.select("doc_id", "positive", "negative").collect()) == [(0, 2, 0), (1, 1, 0)]


def test_a_word_of_both_classes_counts_in_both(spark, cleaned, lists):
    both = inline_table(spark, "word, sentiment", [("good", "positive"), ("good", "negative")])
    row = polarity.hybrid_polarity(cleaned("good x"), both, lists.weights, lists.shifters).first()
    assert (row.word_count, row.positive, row.negative, row.bing_score) == (2, 1, 1, 0.0)


def test_summary_counts_and_distribution(cleaned, lists):
    df = polarity.hybrid_polarity(cleaned("good", "great", "bad", "x y"), lists.polarity, lists.weights, lists.shifters)
    row = polarity.corpus_summary(df).first()
    assert tuple(row) == (4, 1, 50.0, 25.0)
    assert [tuple(r)[:2] for r in polarity.polarity_counts(df).collect()] == [("Very Positive", 2), ("Neutral", 1), ("Very Negative", 1)]
    dist = {r.polarity: r.n for r in polarity.polarity_distribution(df, "polarity_class").collect()}
    assert dist == {"Very Positive": 2, "Positive": 0, "Neutral": 1, "Negative": 0, "Very Negative": 1}


def test_empty_input(cleaned, lists):
    none = cleaned("x").filter("doc_id > 5")
    df = polarity.hybrid_polarity(none, lists.polarity, lists.weights, lists.shifters)
    assert df.count() == 0
    assert sum(r.n for r in polarity.polarity_distribution(df, "polarity_class").collect()) == 0
    assert polarity.polarity_percent(df, "polarity_class").filter("pct <> 0").count() == 0


def test_result_does_not_depend_on_partitions(cleaned, lists):
    docs = cleaned(*[f"good bad {i} not great" for i in range(40)])
    one = scored(docs.coalesce(1), lists)
    many = scored(docs.repartition(8), lists)
    assert one == many


def test_percent_and_running_share(frame):
    df = frame("polarity string", *[("Positive",)] * 3, *[("Negative",)] * 1, ("Neutral",))
    pct = {r.bucket: r.pct for r in polarity.polarity_percent(df).collect()}
    assert pct["Positive"] == 60 and pct["group positive"] == 60 and pct["group neutral"] == 20 and pct["Very Negative"] == 0
    run = polarity.polarity_cumulative(df).collect()
    assert [r.share_before for r in run] == [0.0, 0.0, 0.6, 0.8, 1.0]


def test_emotions(cleaned, lists, frame):
    words = tokens.tokens(cleaned("good good bad", "plain", "great"))
    counts = keywords.word_counts(words.select("word"))
    got = [tuple(r) for r in emotions.emotion_shares(counts, lists.emotions).collect()]
    assert got == [("joy", 3, 50.0), ("trust", 2, 33.3), ("anger", 1, 16.7)]
    dist = emotions.emotion_distribution(emotions.emotion_shares(counts, lists.emotions))
    assert {tuple(r) for r in dist.collect()} == {("happiness", 0.5), ("anger", 0.167)}
    whole = emotions.emotion_distribution(emotions.emotion_shares(counts, lists.emotions), renormalise=True)
    assert sum(r.share for r in whole.collect()) == pytest.approx(1, abs=1e-3)
    by_doc = {(r.doc_id, r.emotion): r.share for r in emotions.emotion_by_document(words, lists.emotions).collect()}
    assert by_doc == {(0, "joy"): 0.4, (0, "trust"): 0.4, (0, "anger"): 0.2, (2, "joy"): 1.0}
    assert emotions.emotions_map(dist).first().emotions == {"happiness": 0.5, "anger": 0.167}
    assert [(r.emotion, r.pct) for r in emotions.emotion_percent(dist).collect()] == [
        ("Joy", 50), ("Sadness", 0), ("Anger", 17), ("Surprise", 0), ("Fear", 0), ("Disgust", 0)]
    odd = frame("emotion string, pct string", ("JOY", "oops"), ("Fear", "25"), ("positive", "9"))
    assert {tuple(r) for r in emotions.emotion_distribution(odd).collect()} == {("happiness", 0.0), ("fear", 0.25)}


def test_corpus_emotions_reach_every_entry(frame):
    made = frame("row_index long", (0,), (1,))
    shared = emotions.emotions_map(frame("emotion string, share double", ("fear", 0.4)))
    assert [r.emotions for r in entries.entries_with_emotions(made, shared).collect()] == [{"fear": 0.4}] * 2
    none = emotions.emotions_map(frame("emotion string, share double"))
    assert entries.entries_with_emotions(made, none).first().emotions == {}


def test_top_words_and_pairs(cleaned, lists):
    docs = cleaned("the big cat and the big dog", "big cat", "single", "of it cat cat")
    top = keywords.top_words(keywords.word_counts(tokens.words_only(docs)), lists.stops)
    assert [tuple(r) for r in top.collect()] == [("cat", 4), ("big", 3), ("dog", 1), ("single", 1)]
    pairs = keywords.top_bigrams(tokens.bigrams(docs), lists.stops)
    assert [(r.bigram, r.n) for r in pairs.collect()] == [("big cat", 2), ("big dog", 1), ("cat cat", 1)]


def test_one_word_gives_no_pair(cleaned):
    got = tokens.bigrams(cleaned("one", "one two three", "!")).collect()
    assert sorted((r.doc_id, r.w1, r.w2) for r in got) == [(1, "one", "two"), (1, "two", "three")]


def test_keyword_sides(frame):
    texts = frame(
        "row_index long, text string, polarity string",
        (0, "START here", "Positive"), (1, "the art of it", "Negative"), (2, "smart", "Very Positive"), (3, "tie tie", "Neutral"),
    )
    top = frame("word string, n long", ("art", 60), ("tie", 10), ("here", 5))
    hits = {r.word: (r.rank, r.pos_hits, r.neg_hits) for r in keywords.keyword_hits(keywords.keyword_marks(texts, top)).collect()}
    assert hits == {"art": (1, 2, 1), "tie": (2, 0, 0), "here": (3, 1, 0)}
    got = [(r.side, r.place, r.word, r.score) for r in keywords.keyword_scores(keywords.keyword_hits(keywords.keyword_marks(texts, top))).collect()]
    assert sorted(got) == [("positive", 1, "art", 0.95), ("positive", 2, "tie", 0.2), ("positive", 3, "here", 0.1)]
    flipped = texts.withColumn("polarity", F.when(F.col("row_index") == 0, "Neutral").otherwise(F.col("polarity")))
    sides = {r.word: (r.side, r.score) for r in keywords.keyword_scores(keywords.keyword_hits(keywords.keyword_marks(flipped, top))).collect()}
    assert sides["tie"] == ("negative", -0.2)


def test_ten_keywords_a_side(frame):
    texts = frame("row_index long, text string, polarity string", (0, "x", "Positive"))
    top = frame("word string, n long", *[(f"w{i:02d}", 100 - i) for i in range(30)])
    scores = keywords.keyword_scores(keywords.keyword_hits(keywords.keyword_marks(texts, top)))
    assert [r.word for r in scores.orderBy("place").collect()] == [f"w{i:02d}" for i in range(10)]
    cloud = keywords.word_cloud(top, scores).orderBy(F.desc("weight")).collect()
    assert len(cloud) == 30 and cloud[0].size == 1.0 and cloud[0].is_positive and not cloud[15].is_positive
    relative = keywords.keyword_relative(scores).collect()
    assert max(r.relative for r in relative) == 1.0
    assert {r.side: r.word for r in keywords.leading_keywords(scores).collect()} == {"positive": "w00"}


def test_topic_tokens(cleaned, lists):
    got = tokens.topic_tokens(cleaned("the 2024 cat is an and x1y ok"), lists.stops).collect()
    assert sorted(r.word for r in got) == ["cat", "x1y"]
    assert {(r.word, r.n) for r in tokens.doc_term_counts(tokens.tokens(cleaned("a b a"))).collect()} == {("a", 2), ("b", 1)}


def test_stemmed_words_keep_their_rows(cleaned):
    words = tokens.tokens(cleaned("cats cat cat", "running dog"))
    got = sorted((r.doc_id, r.pos, r.word) for r in tokens.stemmed(words).collect())
    assert got == [(0, 0, "cat"), (0, 1, "cat"), (0, 2, "cat"), (1, 0, "run"), (1, 1, "dog")]
