"""Trained models and whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import query
from feedback_spark.functions import labels
from feedback_spark.operators import cleaning, emotions, scoring, tokens, topics
from feedback_spark.plans import assemble as plan, corpus, insights, job, partials
from feedback_spark.session import durable, shared_path
from feedback_spark.sources import store


def _fitted(spark, sf):
    return topics.fit_topics(tokens.topic_terms(base.cleaned(spark, sf), base.lexicons(spark).stops))


def _stored(df, *held):
    """``df`` written to the shared folder, and the blocks it was made from dropped."""
    out = durable(df, "result")
    for part in held:
        if part is not None:
            part.release()
    return out


@query("lda_topics")
def lda_topics(spark, sf):
    fitted = _fitted(spark, sf)
    return _stored(topics.topic_beta(fitted), fitted)


@query("gibbs_topics")
def gibbs_topics(spark, sf):
    terms = durable(tokens.topic_terms(base.cleaned(spark, sf), base.lexicons(spark).stops), "terms")
    return topics.gibbs_beta(terms).select("topic", "term", "beta")


@query("document_topics")
def document_topics(spark, sf):
    fitted = _fitted(spark, sf)
    return _stored(topics.dominant_topics(fitted).select("doc_id", "topic", "weight"), fitted)


@query("document_topic_facts", """SELECT doc_id, 3 AS topics, 1.0::DOUBLE AS weight_sum, true AS leads FROM (
    SELECT DISTINCT doc_id FROM tok WHERE length(word) > 2 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN (SELECT word FROM stops))""")
def document_topic_facts(spark, sf):
    """What holds of every document with a word for topics: all topics once, weights of sum 1, the heaviest named."""
    weights = F.transform("topics", lambda t: t["weight"])
    total = F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6)
    leads = (F.array_max(weights) == F.col("weight")) & (F.get(weights, F.col("topic") - 1) == F.col("weight"))
    fitted = _fitted(spark, sf)
    facts = topics.dominant_topics(fitted).select(
        "doc_id", F.size(F.array_distinct(F.transform("topics", lambda t: t["topic_id"]))).alias("topics"),
        total.alias("weight_sum"), leads.alias("leads"),
    )
    return _stored(facts, fitted)


@query("topic_profile")
def topic_profile(spark, sf):
    polarities = base.document_entries(spark, sf).select("doc_id", "polarity")
    fitted = _fitted(spark, sf)
    return _stored(topics.topic_profile(polarities, topics.dominant_topics(fitted), "per_topic"), fitted)


@query("model_scores")
def model_scores(spark, sf):
    """A classifier trained on the labelled documents, applied to all of them."""
    rows = base.feedback(spark, sf).withColumn("class", labels.normalise_label(F.col("label"), F.lit(True)))
    model = scoring.train_classifier(rows.filter("label IS NOT NULL"), "text", "class")
    return scoring.predictions(scoring.score_texts(rows, model, "text", "doc_id"), "doc_id")


def _corpus(spark, sf, with_topics):
    docs = cleaning.build_documents(base.documents(spark, sf), "text", key="doc_id")
    return corpus.corpus_analysis(docs, base.lexicons(spark), key="doc_id", with_topics=with_topics)


def _rows(spark, sf):
    when = "concat('2025-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-01') AS happened"
    return base.documents(spark, sf).selectExpr("doc_id", "text", when)


def _predictions(spark, sf):
    return base.document_entries(spark, sf).select("doc_id", "polarity", "polarity_confidence")


@query("run_analysis")
def run_analysis(spark, sf):
    result = _corpus(spark, sf, True)
    return _stored(corpus.corpus_record(result), result)


_CORPUS_SQL = f"""SELECT 'summary' AS part, 'documents' AS name, count(*)::DOUBLE AS value FROM scored
    UNION ALL SELECT 'summary', 'avg_word_count', round_even(avg(word_count), 0) FROM scored
    UNION ALL SELECT 'summary', 'positive_pct', {base.half_even("(100.0::DOUBLE * count(*) FILTER (polarity_class IN ('Very Positive', 'Positive')) / count(*))", 1)} FROM scored
    UNION ALL SELECT 'summary', 'negative_pct', {base.half_even("(100.0::DOUBLE * count(*) FILTER (polarity_class IN ('Very Negative', 'Negative')) / count(*))", 1)} FROM scored
    UNION ALL SELECT 'polarity_distribution', polarity_class, count(*)::DOUBLE FROM scored GROUP BY polarity_class
    UNION ALL SELECT 'top_words', word, n::DOUBLE FROM topw
    UNION ALL (SELECT 'top_bigrams', concat(word, ' ', next), count(*)::DOUBLE AS n FROM (
        SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok)
        WHERE length(word) > 2 AND length(next) > 2 AND word NOT IN (SELECT word FROM stops) AND next NOT IN (SELECT word FROM stops)
        GROUP BY word, next ORDER BY n DESC, word, next LIMIT 20)
    UNION ALL SELECT 'emotions', emotion, pct FROM emo"""


@query("corpus_without_topics", _CORPUS_SQL)
def corpus_without_topics(spark, sf):
    """The nested result in long form."""
    result = _corpus(spark, sf, False)
    record = _stored(corpus.corpus_record(result), result)
    summary = record.select(F.lit("summary").alias("part"), F.explode(F.create_map(*[
        x for f in ("documents", "avg_word_count", "positive_pct", "negative_pct") for x in (F.lit(f), F.col(f"summary.{f}").cast("double"))
    ])).alias("name", "value"))
    lists = {"polarity_distribution": ("class", "count"), "top_words": ("word", "count"), "top_bigrams": ("bigram", "count"), "emotions": ("emotion", "pct")}
    for part, (name, value) in lists.items():
        cells = record.select(F.inline(part)).select(F.lit(part).alias("part"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
        summary = summary.unionByName(cells)
    return summary


def _assembled(spark, sf, with_corpus=True, with_topics=True):
    result = _corpus(spark, sf, with_topics) if with_corpus else None
    made = plan.assemble(
        _rows(spark, sf), _predictions(spark, sf), result,
        text_column="text", timestamp_column="happened", key="doc_id", topic_mode="per_topic",
    )
    return made, result


@query("assemble")
def assemble(spark, sf):
    made, result = _assembled(spark, sf)
    return _stored(plan.summary_record(made, "job-1"), made, result)


@query("assembled_entries")
def assembled_entries(spark, sf):
    made, result = _assembled(spark, sf)
    return _stored(made.entries, made, result)


_MONTH = "concat('2025-', lpad((doc_id % 12 + 1)::VARCHAR, 2, '0'))"
_DOC_TREND = f"""SELECT {_MONTH} AS period, {base.half_even(f"(sum(CAST({base.score_sql('polarity')} * 2 AS BIGINT))::DOUBLE / 2 / count(*))", 3)} AS avg_polarity
    FROM docentries GROUP BY 1"""


@query("assemble_minimal", f"""SELECT 'polarity_distribution' AS part, l.polarity AS name, count(d.doc_id)::DOUBLE AS value
    FROM {base.LEVELS_SQL} LEFT JOIN docentries d ON d.polarity = l.polarity GROUP BY l.polarity
    UNION ALL SELECT 'intent_distribution', intent, 0 FROM (VALUES ('complaint'), ('suggestion'), ('inquiry'), ('compliment'), ('statement')) v(intent)
    UNION ALL SELECT 'temporal_trend', period, avg_polarity FROM ({_DOC_TREND})
    UNION ALL SELECT 'sizes', name, 0 FROM (VALUES ('sarcasm_count'), ('emotion_distribution'), ('word_cloud'), ('topics')) v(name)""")
def assemble_minimal(spark, sf):
    """Without a corpus result, in long form: distributions and trend stay, the other parts are empty."""
    made, _ = _assembled(spark, sf, with_corpus=False)
    record = _stored(plan.summary_record(made, "job-1"), made)
    out = record.select(F.lit("temporal_trend").alias("part"), F.inline("temporal_trend")).toDF("part", "name", "value")
    for part in ("polarity_distribution", "intent_distribution"):
        out = out.unionByName(record.select(F.lit(part).alias("part"), F.explode(part).alias("name", "value")).withColumn("value", F.col("value").cast("double")))
    sizes = F.create_map(
        F.lit("sarcasm_count"), F.col("sarcasm_count").cast("double"),
        *[x for c in ("emotion_distribution", "word_cloud", "topics") for x in (F.lit(c), F.size(c).cast("double"))],
    )
    return out.unionByName(record.select(F.lit("sizes").alias("part"), F.explode(sizes).alias("name", "value")))


_TONE = ", ".join(
    base.percent_sql(f"(count(*) FILTER ({base.group_sql('polarity')} = '{g}'))", "count(*)") + f" AS {g}_pct" for g in ("positive", "neutral", "negative")
)


@query("insight_facts", f"""SELECT 'finegrained' AS theme, unnest(['tone', 'positive_pct', 'neutral_pct', 'negative_pct']) AS fact, unnest([
        CASE WHEN positive_pct >= 50 THEN 'predominantly positive' WHEN negative_pct >= 40 THEN 'skewing negative' ELSE 'mixed' END,
        positive_pct::VARCHAR, neutral_pct::VARCHAR, negative_pct::VARCHAR]) AS value FROM (SELECT {_TONE} FROM docentries)
    UNION ALL SELECT 'aspect', 'aspects', '0'
    UNION ALL SELECT 'intent', intent, '0' FROM (VALUES ('complaint'), ('suggestion'), ('inquiry'), ('compliment'), ('statement')) v(intent)
    UNION ALL SELECT 'sarcasm', name, '0' FROM (VALUES ('count'), ('pct')) v(name)
    UNION ALL SELECT 'confidence', unnest(['average_pct', 'low']), unnest([a::VARCHAR, b::VARCHAR]) FROM (SELECT
        (sum(CAST(round_even(polarity_confidence * 10000, 0) AS BIGINT)) + count(*) * 50) // (count(*) * 100) AS a,
        count(*) FILTER (polarity_confidence < 0.6) AS b FROM docentries)
    UNION ALL SELECT 'emotion', unnest(['emotion', 'pct']), unnest([CASE emotion WHEN 'happiness' THEN 'Joy' ELSE concat(upper(emotion[1]), emotion[2:]) END,
        CAST(floor(share * 100 + 0.5) AS BIGINT)::VARCHAR]) FROM (SELECT * FROM emodist ORDER BY share DESC, emotion LIMIT 1)
    UNION ALL SELECT 'keywords', side, word FROM kwscores WHERE place = 1
    UNION ALL SELECT 'trend', unnest(['direction', 'first', 'last']), unnest([CASE WHEN l > f THEN 'improving' WHEN l < f THEN 'declining' ELSE 'stable' END, a, b])
        FROM (SELECT min(period) AS a, max(period) AS b, arg_min(avg_polarity, period) AS f, arg_max(avg_polarity, period) AS l FROM ({_DOC_TREND}))""")
def insight_facts(spark, sf):
    made, result = _assembled(spark, sf, with_topics=False)
    return _stored(insights.insight_facts(made), made, result)


def _own_model(texts):
    """A caller's model: class and probabilities from the length of a text."""
    import pandas as pd

    names = ["positive", "neutral", "negative"]
    sizes = texts.fillna("").str.len()
    return pd.DataFrame({
        "sentiment": [names[n % 3] for n in sizes],
        "probabilities": [{names[n % 3]: [(n % 101) / 100]} for n in sizes],
    })


@query("score_with", f"""SELECT doc_id, CASE WHEN k = 0 THEN CASE WHEN c >= 0.75 THEN 'Very Positive' ELSE 'Positive' END
    WHEN k = 2 THEN CASE WHEN c >= 0.75 THEN 'Very Negative' ELSE 'Negative' END ELSE 'Neutral' END AS polarity, c AS polarity_confidence
    FROM (SELECT doc_id, length(text) % 3 AS k, (length(text) % 101)::DOUBLE / 100 AS c FROM documents)""")
def score_with(spark, sf):
    return scoring.predictions(scoring.score_with(base.documents(spark, sf), _own_model, "text", "doc_id"), "doc_id")


@query("document_emotions", """SELECT doc_id, CASE emotion WHEN 'joy' THEN 'happiness' ELSE emotion END AS emotion, share FROM (
    SELECT doc_id, emotion, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) * 10000.0, 0) / 10000.0 AS share FROM (
        SELECT t.doc_id, e.sentiment AS emotion, count(*) AS n FROM tok t JOIN emolex e ON t.word = e.word
        WHERE e.sentiment NOT IN ('positive', 'negative') GROUP BY t.doc_id, e.sentiment))
    WHERE emotion NOT IN ('trust', 'anticipation')""")
def document_emotions(spark, sf):
    """In long form, as entries carry them when emotions are taken per entry."""
    found = emotions.document_emotions(tokens.tokens(base.cleaned(spark, sf)), base.lexicons(spark).emotions)
    return found.select("doc_id", F.explode("emotions").alias("emotion", "share"))


_FLAG = "doc_id % 7 = 0"


def _stored_job(spark, sf, include_sarcasm):
    rows = _rows(spark, sf).withColumnRenamed("doc_id", "row_index")
    flags = [F.expr(_FLAG).alias("sarcasm_flag"), F.lit("inquiry").alias("intent")]
    found = _predictions(spark, sf).select(F.col("doc_id").alias("row_index"), "polarity", "polarity_confidence", *flags)
    options = job.JobOptions("text", "happened", include_sarcasm=include_sarcasm, with_topics=False, emotions_per_entry=True)
    folder = shared_path(spark, "jobs")
    job.run_job(rows, base.lexicons(spark), folder, "job-1", options, found)
    return folder, options


@query("run_job", f"""SELECT doc_id AS row_index, polarity, polarity_confidence, {_FLAG} AS sarcasm_flag, text AS original_text,
    'job-1' AS job_id FROM docentries""")
def run_job(spark, sf):
    """A job of all documents, stored, and its entries read back."""
    folder, _ = _stored_job(spark, sf, True)
    return job.job_entries(spark, folder, "job-1").select(
        "row_index", "polarity", "polarity_confidence", "sarcasm_flag", "original_text", "job_id"
    )


def _flat(summary):
    """(part, name, value) of a stored summary's parts."""
    def of_map(part):
        return summary.select(F.lit(part).alias("part"), F.explode(part).alias("name", "value")).withColumn("value", F.col("value").cast("double"))

    def of_list(part, name, value):
        return summary.select(F.lit(part).alias("part"), F.inline(part)).select("part", F.col(name).alias("name"), F.col(value).cast("double").alias("value"))

    kept = summary.select(F.lit("setting").alias("part"), F.lit("include_sarcasm").alias("name"), F.col("setting.include_sarcasm").cast("int").cast("double").alias("value"))
    count = summary.select(F.lit("sarcasm").alias("part"), F.lit("count").alias("name"), F.col("sarcasm_count").cast("double").alias("value"))
    parts = [of_map("polarity_distribution"), of_map("emotion_distribution"), of_list("word_cloud", "word", "weight"), of_list("temporal_trend", "period", "avg_polarity"), kept, count]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _flat_sql(where, include):
    """The same parts over the documents that ``where`` leaves."""
    level = f"""SELECT 'polarity_distribution' AS part, l.polarity AS name, count(d.doc_id)::DOUBLE AS value FROM {base.LEVELS_SQL}
        LEFT JOIN (SELECT * FROM docentries WHERE {where}) d ON d.polarity = l.polarity GROUP BY l.polarity"""
    emotion = f"""SELECT 'emotion_distribution', CASE emotion WHEN 'joy' THEN 'happiness' ELSE emotion END, {base.half_even('(pct / 100.0)', 4)} FROM (
        SELECT emotion, {base.half_even('(100.0::DOUBLE * n / sum(n) OVER ())', 1)} AS pct FROM (
        SELECT e.sentiment AS emotion, count(*) AS n FROM tok t JOIN emolex e ON t.word = e.word
        WHERE {where} AND e.sentiment NOT IN ('positive', 'negative') GROUP BY e.sentiment)) WHERE emotion NOT IN ('trust', 'anticipation')"""
    words = f"""SELECT 'word_cloud', word, n::DOUBLE FROM (SELECT word, count(*) AS n FROM tok WHERE {where} AND length(word) > 2
        AND word NOT IN (SELECT word FROM stops) GROUP BY word ORDER BY n DESC, word LIMIT 30)"""
    trend = f"""SELECT 'temporal_trend', concat('2025-', lpad((doc_id % 12 + 1)::VARCHAR, 2, '0')),
        {base.half_even(f"(sum(CAST({base.score_sql('polarity')} * 2 AS BIGINT))::DOUBLE / 2 / count(*))", 3)} FROM docentries WHERE {where} GROUP BY 2"""
    rest = f"SELECT 'setting', 'include_sarcasm', {include}::DOUBLE UNION ALL SELECT 'sarcasm', 'count', count(*)::DOUBLE FROM docentries WHERE {_FLAG}"
    return " UNION ALL ".join([level, f"({emotion})", f"({words})", f"({trend})", rest])


@query("job_summary", _flat_sql(f"NOT ({_FLAG})", 0))
def job_summary(spark, sf):
    """The stored summary of a job that leaves sarcastic rows out of every aggregate."""
    folder, _ = _stored_job(spark, sf, False)
    return _flat(job.job_summary(spark, folder, "job-1"))


@query("job_resummary", _flat_sql(f"NOT ({_FLAG})", 0))
def job_resummary(spark, sf):
    """A job stored with all rows, then summed up anew from its entries without the sarcastic ones."""
    folder, _ = _stored_job(spark, sf, True)
    options = job.JobOptions("text", "happened", include_sarcasm=False, with_topics=False)
    return _flat(job.resummarise(spark, base.lexicons(spark), folder, "job-1", options))


_INTENT_NAMES = ", ".join(f"('{i}')" for i in labels.INTENTS)


@query("partial_summary", f"""SELECT 'polarity' AS part, l.polarity AS name, count(e.row_index)::DOUBLE AS value FROM {base.LEVELS_SQL}
    LEFT JOIN (SELECT * FROM entries WHERE NOT sarcasm_flag) e ON e.polarity = l.polarity GROUP BY l.polarity
    UNION ALL SELECT 'intent', i.intent, count(e.row_index)::DOUBLE FROM (VALUES {_INTENT_NAMES}) i(intent)
    LEFT JOIN (SELECT * FROM entries WHERE NOT sarcasm_flag) e ON e.intent = i.intent GROUP BY i.intent
    UNION ALL SELECT 'trend', period, {base.half_even(f"(sum(CAST({base.score_sql('polarity')} * 2 AS BIGINT))::DOUBLE / 2 / count(*))", 3)}
    FROM (SELECT polarity, {base.period_sql('happened')} AS period FROM entries WHERE NOT sarcasm_flag) WHERE period IS NOT NULL GROUP BY period
    UNION ALL SELECT 'sarcasm', 'count', count(*)::DOUBLE FROM entries WHERE sarcasm_flag""")
def partial_summary(spark, sf):
    """Entries counted once per event type, stored, merged and summed up without the sarcastic ones."""
    path = shared_path(spark, "partials")
    entries = base.dated_entries(spark, sf).withColumn("job_id", F.concat(F.lit("job-"), F.col("intent")))
    store.upsert_aggregates(partials.partial_counts(entries, "job_id", timestamp_column="happened"), path)
    return partials.summary(partials.merged(spark.read.parquet(path)), include_sarcasm=False)
