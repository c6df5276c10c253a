"""Entries, trend, aspects, topics, whole analyses."""

import pytest
from pyspark.sql import functions as F

from feedback_spark.operators import cleaning, entries, scoring, tokens, topics, trend
from feedback_spark.plans import assemble as plan, corpus, insights
from feedback_spark.sources import lexicons

ENTRY = ("row_index long, polarity string, polarity_confidence double, intent string, sarcasm_flag boolean, "
         "sarcasm_confidence double, emotions map<string,double>, aspects array<struct<term:string,sentiment:string,score:double>>")


@pytest.fixture
def made(frame):
    return frame(
        ENTRY,
        (0, "Positive", 0.9, "complaint", False, 0.1, {"fear": 0.3, "anger": 0.1}, [("food", "Positive", 0.5)]),
        (1, "Very Positive", 0.6, "statement", True, 0.8, {}, [("food", "mildly negative", -0.5), ("price", "mixed", 0.0)]),
        (2, "Negative", 0.59, "inquiry", False, 0.0, {"fear": 0.29}, []),
        (3, "Neutral", 0.5, "complaint", True, 0.7, {"joy": 1.0}, [("food", "Very Positive", 1.0)]),
    )


def keys(df):
    return sorted(r.row_index for r in df.collect())


def test_filters_combine(made):
    assert keys(entries.entries_filter(made)) == [0, 1, 2, 3]
    assert keys(entries.entries_filter(made, polarity="Positive")) == [0]
    assert keys(entries.entries_filter(made, group="positive")) == [0, 1]
    assert keys(entries.entries_filter(made, emotion="fear")) == [0]
    assert keys(entries.entries_filter(made, sarcasm=False)) == [0, 2]
    assert keys(entries.entries_filter(made, intent="complaint", min_confidence=0.5, sarcasm=True)) == [3]
    assert entries.entries_total(entries.entries_filter(made, sarcasm=True)).first().total == 2


def test_pages_cover_everything_once(frame):
    df = frame("row_index long", *[(i,) for i in range(45)]).repartition(5)
    pages = [keys(entries.entries_page(df, page=p, limit=20)) for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0] and sum(pages, []) == list(range(45))
    assert keys(entries.entries_after(df, 19)) == list(range(20, 40))
    with pytest.raises(ValueError):
        entries.entries_page(df, page=0)
    with pytest.raises(ValueError):
        entries.entries_page(df, limit=101)


def test_confidence(made):
    assert keys(entries.low_confidence(made)) == [2, 3]
    assert tuple(entries.confidence_stats(made).first()) == (65, 2)
    rows = entries.confidence_table(made.withColumn("original_text", F.lit("x" * 50))).orderBy("row_index").collect()
    assert [(r.emotion, r.intent, r.confidence_pct, r.flag) for r in rows] == [
        ("Fear", "Complaint", 90, "—"), ("—", "General", 60, "Sarcasm"), ("Fear", "Inquiry", 59, "Low"), ("joy", "Complaint", 50, "Sarcasm"),
    ]
    assert rows[0].entry == "x" * 40 + "..."
    empty = entries.confidence_stats(made.filter("false")).first()
    assert tuple(empty) == (0, 0)


def test_intents_and_sarcasm(made):
    assert {r.intent: r.n for r in entries.intent_distribution(made).collect()} == {
        "complaint": 2, "suggestion": 0, "inquiry": 1, "compliment": 0, "statement": 1}
    assert tuple(entries.sarcasm_summary(made).first()) == (2, 4, 50)
    assert keys(entries.exclude_sarcasm(made, include=True)) == [0, 1, 2, 3]
    assert keys(entries.exclude_sarcasm(made, include=False)) == [0, 2]
    assert keys(entries.merge_sarcastic(made, shown=2)) == [0, 1, 3]


def test_aspects(made):
    got = [tuple(r) for r in entries.aspect_table(made).collect()]
    assert got == [("food", 3, 67, 0, 33, 67), ("price", 1, 0, 100, 0, 50)]
    assert entries.aspect_distinct(made).first().aspects == 2


def test_export_keeps_unmatched_rows(made, frame):
    rows = frame("row_index long, comment string", (0, "a"), (7, "b"))
    got = entries.annotated_rows(rows, made, "x_").orderBy("row_index").collect()
    assert got[0].x_dominant_emotion == "fear" and got[0].x_emotion_scores == "fear=0.3; anger=0.1" and got[0].x_sarcasm_flag == "False"
    assert got[1].comment == "b" and got[1].x_polarity is None


def test_entry_document(made, frame):
    rows = frame("row_index long, comment string, day int", (0, "a", 3), (2, None, 4))
    got = entries.entry_document(rows, made, "comment", "j").orderBy("row_index").collect()
    assert got[0].original_row == {"comment": "a", "day": "3"} and got[0].job_id == "j"
    assert got[1].original_text == ""
    assert entries.entry_lookup(entries.entry_document(rows, made, "comment", "j"), "j", 2).count() == 1


def test_trend(frame):
    df = frame(
        "polarity string, t string", ("Positive", "2025-01-02"), ("Neutral", "2025-01-03"), ("Very Negative", "2025-03-01"),
        ("Negative", "2025-02-01"), ("Positive", "nonsense"), ("other", "02/05/2025"),
    )
    months = trend.monthly_trend(df, "t")
    assert [tuple(r) for r in months.collect()] == [("2025-01", 0.25), ("2025-02", -0.25), ("2025-03", -1.0)]
    assert trend.trend_direction(months).first().direction == "declining"
    assert tuple(trend.trend_low_point(months).first()) == ("2025-03", -1.0, True)
    tied = frame("period string, avg_polarity double", ("b", 0.0), ("a", 0.0))
    assert tuple(trend.trend_low_point(tied).first()) == ("a", 0.0, False)
    assert trend.trend_direction(tied).first().direction == "stable"
    assert trend.trend_direction(tied.filter("false")).count() == 0


def test_top_terms_keep_ties(frame):
    rows = [(1, f"t{i}", 1.0 - i / 10) for i in range(7)] + [(1, "a", 0.05), (1, "b", 0.05), (1, "c", 0.01), (2, "z", 1.0)]
    ranked = topics.top_terms_ties(frame("topic int, term string, beta double", *rows))
    assert ranked.filter("topic = 1").count() == 9
    lists = {r.topic: r.terms for r in topics.topic_terms(ranked).collect()}
    assert lists[1] == [f"t{i}" for i in range(7)] + ["a", "b"]
    named = {r.topic: (r.label, r.number) for r in topics.topic_labels(topics.topic_terms(ranked)).collect()}
    assert named == {1: ("T0, T1, T2", "01"), 2: ("Z", "02")}


def test_topic_label_without_terms(frame):
    df = frame("topic int, terms array<string>", (4, []), (5, None))
    assert [r.label for r in topics.topic_labels(df).orderBy("topic").collect()] == ["Topic 4", "Topic 5"]


def test_profiles(frame):
    polarity = frame("doc_id long, polarity string", (0, "Positive"), (1, "Negative"), (2, "Very Positive"), (3, "Neutral"))
    found = frame("doc_id long, topic int", (0, 1), (1, 1), (2, 2), (3, 2))
    one = {r.topic: tuple(r)[1:] for r in topics.topic_profile(polarity, found, "per_topic").collect()}
    assert one == {1: (1, 0, 1), 2: (1, 1, 0)}
    both = {r.topic: tuple(r)[1:] for r in topics.topic_profile(polarity, found, "global").collect()}
    assert both == {1: (2, 1, 1), 2: (2, 1, 1)}
    assert {r.topic: (r.pos_pct, r.neg_pct) for r in topics.topic_share(topics.topic_profile(polarity, found, "per_topic")).collect()} == {
        1: (50, 50), 2: (50, 0)}


COMMENTS = [
    "The lectures were excellent and very engaging", "Too much workload and stressful deadlines", "lectures clear and helpful",
    "deadlines are awful and overwhelming", "", "exam was unfair and the workload terrible", "great lectures great professor",
]


@pytest.fixture
def rows(frame):
    return frame(
        "row_index long, comment string, day string, label string",
        *[(i, t, f"2025-0{i % 3 + 1}-05", "pos" if i % 2 == 0 else "neg") for i, t in enumerate(COMMENTS)],
    )


def test_topics_are_repeatable_and_need_two(rows, spark):
    docs = cleaning.clean_documents(cleaning.build_documents(rows, "comment"))
    words = tokens.topic_terms(docs, lexicons.stop_words(spark), "row_index")
    runs = []
    for _ in range(2):
        fitted = topics.fit_topics(words.coalesce(1), key="row_index", iterations=3)
        runs.append([tuple(r) for r in topics.topic_beta(fitted).orderBy("topic", "place", "term").collect()])
        assert fitted.model.getK() == 3
        weights = topics.dominant_topics(fitted, "row_index").collect()
        assert len(weights) == 6 and all(sum(t.weight for t in r.topics) == pytest.approx(1) for r in weights)
    assert runs[0] == runs[1]
    assert topics.fit_topics(words.filter("row_index < 2"), key="row_index") is None


def test_topics_of_a_vocabulary_larger_than_the_buckets(spark):
    lists = spark.range(400).selectExpr(
        "id AS doc_id", "concat(transform(sequence(id * 800, id * 800 + 799), x -> concat('w', x)), array_repeat(concat('lead', id % 2), 300)) AS terms"
    )
    fitted = topics.fit_topics(lists, k=2, iterations=2)
    assert fitted.documents.count() == 400 and fitted.model.vocabSize() <= topics.BUCKETS
    assert {"lead0", "lead1"} <= {r.term for r in topics.topic_beta(fitted).collect()}
    fitted.release()


def test_topic_terms_are_those_of_the_token_table(spark, frame):
    docs = cleaning.clean_documents(frame("doc_id long, raw_text string, label string", (1, "The running cats 2024 and x1y ok", "pos"), (2, "an of", "pos")))
    stops = lexicons.stop_words(spark)
    table = {}
    for r in tokens.topic_tokens(docs, stops).collect():
        table.setdefault(r.doc_id, []).append(r.word)
    assert {r.doc_id: r.terms for r in tokens.topic_terms(docs, stops).collect()} == {k: sorted(v) for k, v in table.items()}
    assert tokens.topic_terms(docs, stops, stem=True).head().terms == ["cat", "run", "x1y"]
    plan = tokens.topic_terms(docs, stops, stem=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("Subquery")[0]


def test_trained_scores(rows):
    model = scoring.train_classifier(rows.filter("comment <> ''"), "comment", "label", features=1 << 10, iterations=10)
    raw = scoring.score_texts(rows, model, "comment")
    assert raw.count() == len(COMMENTS)
    for r in raw.collect():
        assert sum(r.probabilities.values()) == pytest.approx(1) and r.sentiment in scoring.CLASSES
    made = {r.row_index: r.polarity for r in scoring.predictions(raw).collect()}
    assert "Positive" in made[0] and "Negative" in made[1]


def test_scores_of_a_given_model(rows):
    import pandas as pd

    def predict(texts):
        return pd.DataFrame({
            "sentiment": ["positive" if "great" in t else "neutral" for t in texts],
            "probabilities": [{"positive": [0.8], "neutral": "bad"} for _ in texts],
        })

    got = {r.row_index: (r.polarity, r.polarity_confidence) for r in scoring.predictions(scoring.score_with(rows, predict, "comment")).collect()}
    assert got[6] == ("Very Positive", 0.8) and got[0] == ("Neutral", 0.5) and len(got) == len(COMMENTS)


@pytest.fixture
def predictions(rows):
    return rows.select("row_index", F.when(F.col("label") == "pos", "Positive").otherwise("Very Negative").alias("polarity"), F.lit(0.8).alias("polarity_confidence"))


def test_whole_analysis(rows, predictions, spark):
    docs = cleaning.build_documents(rows, "comment")
    result = corpus.corpus_analysis(docs, lexicons.Lexicons.seed(spark), topic_options={"iterations": 2})
    record = corpus.corpus_record(result).first()
    assert record.summary.documents == 6
    assert sum(c.count if not callable(c.count) else c["count"] for c in record.polarity_distribution) == 6
    assert [w.word for w in record.top_words][:2] == ["lectures", "deadlines"]
    assert len(record.topics) == 3 and {e.emotion for e in record.emotions} >= {"joy", "fear"}
    made = plan.assemble(rows, predictions, result, text_column="comment", timestamp_column="day", topic_mode="per_topic")
    assert made.entries.count() == len(COMMENTS)
    first = made.entries.orderBy("row_index").first()
    assert first.intent == "" and first.aspects == [] and len(first.topics) == 3 and "happiness" in first.emotions
    summary = plan.summary_record(made, "j").first()
    assert summary.polarity_distribution == {"Very Positive": 0, "Positive": 4, "Neutral": 0, "Negative": 0, "Very Negative": 3}
    assert summary.sarcasm_count == 0 and [p.period for p in summary.temporal_trend] == ["2025-01", "2025-02", "2025-03"]
    assert summary.keywords_positive[0].word == "lectures" and summary.word_cloud[0].word == "lectures"
    assert sum(t.positive + t.neutral + t.negative for t in summary.topics) == 6
    facts = {(r.theme, r.fact): r.value for r in insights.insight_facts(made).collect()}
    assert facts["finegrained", "tone"] == "predominantly positive" and facts["topics", "found"] == "3"
    assert facts["keywords", "positive"] == "lectures" and facts["confidence", "average_pct"] == "80"
    result.release()


def test_without_corpus(rows, predictions):
    made = plan.assemble(rows, predictions, None, text_column="comment", timestamp_column="day")
    assert made.entries.first().emotions == {}
    summary = plan.summary_record(made, "j").first()
    assert summary.word_cloud == [] and summary.topics == [] and summary.emotion_distribution == {}
    assert sum(summary.polarity_distribution.values()) == len(COMMENTS) and len(summary.temporal_trend) == 3
    themes = {r.theme for r in insights.insight_facts(made).collect()}
    assert themes == {"finegrained", "aspect", "intent", "sarcasm", "confidence", "trend"}


def test_sarcasm_switch_changes_aggregates(rows, predictions):
    flagged = predictions.withColumn("sarcasm_flag", F.col("row_index") == 0)
    kept = plan.assemble(rows, flagged, None, text_column="comment", include_sarcasm=False)
    assert {r.polarity: r.n for r in kept.polarity_distribution.collect()}["Positive"] == 3
    assert kept.sarcasm.first().sarcasm_count == 1 and kept.entries.count() == len(COMMENTS)
