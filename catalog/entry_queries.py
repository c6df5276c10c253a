"""Entries: mappings, filters, pages, joins and dashboard figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import query
from feedback_spark.functions import labels, numbers, shares, text
from feedback_spark.functions.dates import parse_period
from feedback_spark.operators import entries as rows_of
from feedback_spark.operators import polarity, scoring, trend
from feedback_spark.plans import insights
from feedback_spark.session import shared_path
from feedback_spark.sources import entry_pages

COLUMNS = "row_index, polarity, polarity_confidence, intent, sarcasm_flag"
SHOWN = [c.strip() for c in COLUMNS.split(",")]


# ---- mappings --------------------------------------------------------------

def _prediction_sql() -> str:
    raw = ", ".join(base.RAW)
    side = "CASE WHEN lower(sentiment) IN ('positive', 'neutral', 'negative') THEN lower(sentiment) ELSE 'neutral' END"
    p = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in
         {"positive": base.P_POSITIVE, "negative": base.P_NEGATIVE, "neutral": base.P_NEUTRAL}.items()}
    return f"""SELECT row_index, sentiment, coalesce(CASE {side} WHEN 'negative' THEN TRY_CAST({p['negative']} AS DOUBLE)
        WHEN 'positive' THEN CASE WHEN event_id % 7 <> 0 THEN TRY_CAST({p['positive']} AS DOUBLE) END
        ELSE CASE WHEN event_id % 7 <> 0 THEN TRY_CAST({p['neutral']} AS DOUBLE) END END, 0.5) AS c
        FROM (SELECT *, {raw} FROM ev)"""


_FIVE = """CASE WHEN lower(trim(sentiment)) = 'positive' THEN CASE WHEN c >= 0.75 THEN 'Very Positive' ELSE 'Positive' END
    WHEN lower(trim(sentiment)) = 'negative' THEN CASE WHEN c >= 0.75 THEN 'Very Negative' ELSE 'Negative' END ELSE 'Neutral' END"""


@query("prediction_confidence", f"SELECT row_index, {base.half_even('c', 4)} AS polarity_confidence FROM ({_prediction_sql()})")
def prediction_confidence(spark, sf):
    confidence = labels.rounded_confidence(F.col("sentiment"), F.col("probabilities"))
    return base.raw_predictions(spark, sf).select("row_index", confidence.alias("polarity_confidence"))


@query("five_level", f"SELECT row_index, {_FIVE} AS polarity FROM ({_prediction_sql()})")
def five_level(spark, sf):
    return scoring.predictions(base.raw_predictions(spark, sf)).select("row_index", "polarity")


@query("polarity_score_map", f"SELECT row_index, CAST({base.score_sql('polarity')} AS DOUBLE) AS score FROM entries")
def polarity_score_map(spark, sf):
    return base.entries(spark, sf).select("row_index", labels.level_score(F.col("polarity")).alias("score"))


@query("polarity_group", f"SELECT {base.group_sql('polarity')} AS polarity_group, count(*) AS n FROM entries GROUP BY 1")
def polarity_group(spark, sf):
    group = labels.polarity_group(F.col("polarity")).alias("polarity_group")
    return base.entries(spark, sf).groupBy(group).agg(F.count(F.lit(1)).alias("n"))


@query("safe_cast", """SELECT event_id AS row_index, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN concat('v', event_type)
    WHEN event_id % 8 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE), 1.0) AS number FROM events""")
def safe_cast(spark, sf):
    typed = F.expr("""CASE WHEN event_id % 3 = 0 THEN concat('v', event_type) WHEN event_id % 8 = 0 THEN NULL
        ELSE CAST(value AS STRING) END""")
    return base.table(spark, sf, "events").select(
        F.col("event_id").alias("row_index"), numbers.number_or(typed, 1.0).alias("number")
    )


@query("truncate_text", """SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE concat(substr(text, 1, 40), '...') END AS shown
    FROM documents UNION ALL SELECT row_index, CASE WHEN length(original_text) <= 40 THEN original_text
    ELSE concat(substr(original_text, 1, 40), '...') END FROM entries""")
def truncate_text(spark, sf):
    docs = base.table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("shown"))
    lines = base.entries(spark, sf).select(F.col("row_index").alias("doc_id"), text.truncate(F.col("original_text")).alias("shown"))
    return docs.unionByName(lines)


@query("display_labels", """SELECT row_index, CASE WHEN intent = 'statement' THEN 'General' ELSE concat(upper(intent[1]), intent[2:]) END AS intent_label,
    CASE WHEN polarity LIKE '%Negative%' THEN 'neg' WHEN polarity LIKE '%Positive%' THEN 'pos' ELSE 'neu' END AS badge,
    CASE coalesce(d.emotion, '') WHEN 'happiness' THEN 'Joy' WHEN 'sadness' THEN 'Sadness' WHEN 'anger' THEN 'Anger'
        WHEN 'fear' THEN 'Fear' ELSE '' END AS emotion_label FROM entries e LEFT JOIN dominant d USING (row_index)""")
def display_labels(spark, sf):
    return base.entries(spark, sf).select(
        "row_index",
        labels.intent_label(F.col("intent")).alias("intent_label"),
        labels.badge_group(F.col("polarity")).alias("badge"),
        shares.emotion_name(shares.dominant(F.col("emotions"))).alias("emotion_label"),
    )


@query("dominant_emotion", """SELECT e.row_index, coalesce(d.emotion, '') AS dominant_emotion
    FROM entries e LEFT JOIN dominant d USING (row_index)""")
def dominant_emotion(spark, sf):
    return base.entries(spark, sf).select("row_index", shares.dominant(F.col("emotions")).alias("dominant_emotion"))


_EMOTION_TEXT = """SELECT row_index, string_agg(concat(emotion, '=', CAST(share AS VARCHAR)), '; ' ORDER BY share DESC, emotion) AS emotion_scores
    FROM shares GROUP BY row_index"""


@query("emotion_text", f"""SELECT e.row_index, coalesce(s.emotion_scores, '') AS emotion_scores
    FROM entries e LEFT JOIN ({_EMOTION_TEXT}) s USING (row_index)""")
def emotion_text(spark, sf):
    return base.entries(spark, sf).select("row_index", shares.shares_text(F.col("emotions")).alias("emotion_scores"))


@query("map_total", f"""SELECT e.row_index, {base.half_even('coalesce(s.total, 0)', 6)} AS total FROM entries e LEFT JOIN (
    SELECT row_index, sum(share) AS total FROM shares GROUP BY row_index) s USING (row_index)""")
def map_total(spark, sf):
    total = numbers.round_half_even(shares.total(F.col("emotions")), 6)
    return base.entries(spark, sf).select("row_index", total.alias("total"))


@query("parse_period", "SELECT row_index, happened, " + base.period_sql("happened") + " AS period FROM entries")
def parse_period_(spark, sf):
    return base.dated_entries(spark, sf).select("row_index", "happened", parse_period(F.col("happened")).alias("period"))


# ---- filters and pages -----------------------------------------------------

@query("entries_filter", f"""SELECT {COLUMNS} FROM entries WHERE polarity = 'Negative' AND intent = 'complaint' AND NOT sarcasm_flag
    AND polarity_confidence >= 0.7 AND row_index IN (SELECT row_index FROM shares WHERE emotion = 'happiness' AND share >= 0.3)""")
def entries_filter(spark, sf):
    return rows_of.entries_filter(
        base.entries(spark, sf), polarity="Negative", intent="complaint", sarcasm=False, emotion="happiness", min_confidence=0.7
    ).select(SHOWN)


@query("entries_filter_group", f"SELECT {COLUMNS} FROM entries WHERE {base.group_sql('polarity')} = 'positive'")
def entries_filter_group(spark, sf):
    return rows_of.entries_filter(base.entries(spark, sf), group="positive").select(SHOWN)


def _jobs(spark, sf):
    return base.entries(spark, sf).withColumn("job_id", F.concat(F.lit("job-"), F.col("intent")))


@query("entry_lookup", f"SELECT {COLUMNS} FROM entries WHERE intent = 'complaint' AND row_index = 0")
def entry_lookup(spark, sf):
    return rows_of.entry_lookup(_jobs(spark, sf), "job-complaint", 0).select(SHOWN)


@query("entries_ordered", f"SELECT {COLUMNS} FROM entries ORDER BY row_index")
def entries_ordered(spark, sf):
    return rows_of.entries_ordered(base.entries(spark, sf).select(SHOWN))


@query("entries_page", f"SELECT {COLUMNS} FROM entries WHERE intent = 'inquiry' ORDER BY row_index LIMIT 20 OFFSET 40")
def entries_page(spark, sf):
    chosen = rows_of.entries_filter(base.entries(spark, sf).select(SHOWN), intent="inquiry")
    return rows_of.entries_page(chosen, page=3, limit=20)


def _paged(spark, sf):
    path = shared_path(spark, "entry_pages")
    entry_pages.write_pages(_jobs(spark, sf).select(*SHOWN, "job_id"), path)
    return path


@query("stored_page", f"SELECT {COLUMNS} FROM entries WHERE intent = 'inquiry' ORDER BY row_index LIMIT 20 OFFSET 40")
def stored_page(spark, sf):
    return entry_pages.stored_page(spark, _paged(spark, sf), "job-inquiry", page=3, limit=20).select(SHOWN)


@query("stored_totals", """SELECT concat('job-', intent) AS job_id, count(*) AS total, min(row_index) AS first, max(row_index) AS last
    FROM entries GROUP BY intent""")
def stored_totals(spark, sf):
    listed = entry_pages.directory(spark, _paged(spark, sf))
    return listed.groupBy("job_id").agg(
        F.sum("rows").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")
    )


@query("entries_after", f"SELECT {COLUMNS} FROM entries WHERE row_index > 500 ORDER BY row_index LIMIT 20")
def entries_after(spark, sf):
    return rows_of.entries_after(base.entries(spark, sf).select(SHOWN), 500)


@query("entries_total", "SELECT count(*) AS total FROM entries WHERE intent = 'inquiry' AND polarity_confidence >= 0.8")
def entries_total(spark, sf):
    return rows_of.entries_total(rows_of.entries_filter(base.entries(spark, sf), intent="inquiry", min_confidence=0.8))


@query("low_confidence", f"SELECT {COLUMNS} FROM entries WHERE polarity_confidence < 0.6")
def low_confidence(spark, sf):
    return rows_of.low_confidence(base.entries(spark, sf).select(SHOWN))


@query("first_entries", f"SELECT {COLUMNS} FROM entries ORDER BY row_index LIMIT 20")
def first_entries(spark, sf):
    return rows_of.first_entries(base.entries(spark, sf).select(SHOWN))


@query("exclude_sarcasm", f"""SELECT l.polarity, count(e.row_index) AS n FROM {base.LEVELS_SQL}
    LEFT JOIN (SELECT * FROM entries WHERE NOT sarcasm_flag) e ON e.polarity = l.polarity GROUP BY l.polarity""")
def exclude_sarcasm(spark, sf):
    return polarity.polarity_distribution(rows_of.exclude_sarcasm(base.entries(spark, sf), include=False))


@query("merge_sarcastic", f"""SELECT {COLUMNS} FROM entries WHERE sarcasm_flag
    UNION SELECT {COLUMNS} FROM (SELECT * FROM entries ORDER BY row_index LIMIT 100)""")
def merge_sarcastic(spark, sf):
    return rows_of.merge_sarcastic(base.entries(spark, sf).select(SHOWN))


# ---- joins -----------------------------------------------------------------

@query("entry_document", """SELECT event_id AS row_index, 'job-1' AS job_id, polarity, original_text, event_type AS cell_type,
    CAST(user_id AS VARCHAR) AS cell_user, props AS cell_props FROM entries""")
def entry_document(spark, sf):
    """The original row comes back as a map, read here by three of its keys."""
    made = base.entries(spark, sf)
    originals = made.select("row_index", "original_text")
    rows = base.table(spark, sf, "events").select(F.col("event_id").alias("row_index"), "event_type", "user_id", "props")
    document = rows_of.entry_document(rows.join(originals, "row_index"), made.select("row_index", "polarity"), "original_text", "job-1")
    cell = {c: F.col("original_row")[c] for c in ("event_type", "user_id", "props")}
    return document.select(
        "row_index", "job_id", "polarity", "original_text", cell["event_type"].alias("cell_type"),
        cell["user_id"].alias("cell_user"), cell["props"].alias("cell_props"),
    )


@query("list_predictions", f"SELECT row_index, {_FIVE} AS polarity, {base.half_even('c', 4)} AS polarity_confidence FROM ({_prediction_sql()})")
def list_predictions(spark, sf):
    """Answers whose class and probabilities each come as a list of one."""
    listed = base.raw_predictions(spark, sf).select(
        "row_index", F.array("sentiment").alias("sentiment"),
        F.transform_values("probabilities", lambda _, v: F.array(v)).alias("probabilities"),
    )
    return scoring.predictions(listed)


@query("rows_predictions", f"""SELECT e.row_index, e.original_text, {_FIVE} AS polarity, {base.half_even('c', 4)} AS polarity_confidence
    FROM entries e JOIN ({_prediction_sql()}) p ON e.row_index = p.row_index""")
def rows_predictions(spark, sf):
    rows = base.entries(spark, sf).select("row_index", "original_text")
    return rows_of.rows_predictions(rows, scoring.predictions(base.raw_predictions(spark, sf)))


@query("annotated_export", f"""SELECT d.doc_id AS row_index, d.lang, d.source, e.polarity AS fb_polarity, e.polarity_confidence AS fb_polarity_confidence,
    e.intent AS fb_intent, CASE e.sarcasm_flag WHEN true THEN 'True' WHEN false THEN 'False' END AS fb_sarcasm_flag, e.sarcasm_confidence AS fb_sarcasm_confidence,
    CASE WHEN e.row_index IS NOT NULL THEN coalesce(m.emotion, '') END AS fb_dominant_emotion,
    CASE WHEN e.row_index IS NOT NULL THEN coalesce(s.emotion_scores, '') END AS fb_emotion_scores
    FROM documents d LEFT JOIN (SELECT * FROM entries WHERE row_index IN (SELECT doc_id FROM labels)) e ON e.row_index = d.doc_id
    LEFT JOIN dominant m ON m.row_index = e.row_index LEFT JOIN ({_EMOTION_TEXT}) s ON s.row_index = e.row_index""")
def annotated_export(spark, sf):
    """Documents as source rows; those with a label have an entry, the rest stay blank."""
    rows = base.table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), "lang", "source")
    known = base.table(spark, sf, "labels").select(F.col("doc_id").alias("row_index"))
    return rows_of.annotated_rows(rows, base.entries(spark, sf).join(known, "row_index", "left_semi"), "fb_")


@query("job_dataset", """SELECT j.lang AS dataset_id, concat(j.lang, '-', j.source) AS job_id, d.row_count FROM
    (SELECT DISTINCT lang, source FROM documents) j JOIN (SELECT lang, count(*) AS row_count FROM documents GROUP BY lang) d ON j.lang = d.lang""")
def job_dataset(spark, sf):
    """Languages as data sets, each source of a language as a job over it."""
    docs = base.table(spark, sf, "documents")
    datasets = docs.groupBy(F.col("lang").alias("dataset_id")).agg(F.count(F.lit(1)).alias("row_count"))
    jobs = docs.select(F.col("lang").alias("dataset_id"), F.concat_ws("-", "lang", "source").alias("job_id")).distinct()
    return rows_of.job_dataset(jobs, datasets)


# ---- figures ---------------------------------------------------------------

@query("confidence_table", """SELECT e.row_index, CASE WHEN length(original_text) <= 40 THEN original_text
        ELSE concat(substr(original_text, 1, 40), '...') END AS entry, polarity,
    CASE coalesce(d.emotion, '') WHEN 'happiness' THEN 'Joy' WHEN 'sadness' THEN 'Sadness' WHEN 'anger' THEN 'Anger'
        WHEN 'fear' THEN 'Fear' ELSE '—' END AS emotion,
    CASE WHEN intent = 'statement' THEN 'General' ELSE concat(upper(intent[1]), intent[2:]) END AS intent,
    CAST(floor(polarity_confidence * 100 + 0.5) AS BIGINT) AS confidence_pct,
    CASE WHEN sarcasm_flag THEN 'Sarcasm' WHEN polarity_confidence < 0.6 THEN 'Low' ELSE '—' END AS flag
    FROM entries e LEFT JOIN dominant d ON d.row_index = e.row_index""")
def confidence_table(spark, sf):
    return rows_of.confidence_table(base.entries(spark, sf))


@query("confidence_stats", f"""SELECT
    CAST((sum(CAST(round_even(polarity_confidence * 10000, 0) AS BIGINT)) + count(*) * 50) // (count(*) * 100) AS BIGINT) AS avg_confidence_pct,
    count(*) FILTER (polarity_confidence < 0.6) AS low_count FROM entries""")
def confidence_stats(spark, sf):
    return rows_of.confidence_stats(base.entries(spark, sf))


@query("intent_distribution", """SELECT l.intent, count(e.row_index) AS n FROM
    (VALUES ('complaint'), ('suggestion'), ('inquiry'), ('compliment'), ('statement')) l(intent)
    LEFT JOIN entries e ON e.intent = l.intent GROUP BY l.intent""")
def intent_distribution(spark, sf):
    return rows_of.intent_distribution(base.entries(spark, sf))


@query("sarcasm_summary", f"""SELECT sarcasm_count, entries, {base.percent_sql('sarcasm_count', 'entries')} AS sarcasm_pct FROM (
    SELECT count(*) FILTER (sarcasm_flag) AS sarcasm_count, count(*) AS entries FROM entries)""")
def sarcasm_summary(spark, sf):
    return rows_of.sarcasm_summary(base.entries(spark, sf))


@query("exploded_aspects", "SELECT row_index, term, sentiment, score FROM aspects")
def exploded_aspects(spark, sf):
    return rows_of.exploded_aspects(base.entries(spark, sf))


@query("aspect_table", f"""SELECT term, mentions, {base.percent_sql('pos', 'mentions')} AS positive_pct,
    {base.percent_sql('(mentions - pos - neg)', 'mentions')} AS neutral_pct, {base.percent_sql('neg', 'mentions')} AS negative_pct,
    CAST((total * 50 + mentions * 50500) // (mentions * 1000) AS BIGINT) AS score_pct FROM (
    SELECT term, count(*) AS mentions, sum(CAST(round(score * 1000) AS BIGINT)) AS total, count(*) FILTER (lower(sentiment) LIKE '%positive%') AS pos,
        count(*) FILTER (lower(sentiment) LIKE '%negative%' AND lower(sentiment) NOT LIKE '%positive%') AS neg
    FROM aspects GROUP BY term)""")
def aspect_table(spark, sf):
    return rows_of.aspect_table(base.entries(spark, sf))


@query("aspect_distinct", "SELECT count(DISTINCT term) AS aspects FROM aspects")
def aspect_distinct(spark, sf):
    return rows_of.aspect_distinct(base.entries(spark, sf))


_COUNTED = f"""SELECT l.polarity, count(e.row_index) AS n FROM {base.LEVELS_SQL}
    LEFT JOIN entries e ON e.polarity = l.polarity GROUP BY l.polarity"""


@query("polarity_percent", f"""SELECT bucket, CAST(n AS BIGINT) AS n, {base.percent_sql('n', '(SELECT count(*) FROM entries)')} AS pct FROM (
    SELECT polarity AS bucket, n FROM ({_COUNTED}) UNION ALL
    SELECT concat('group ', {base.group_sql('polarity')}), sum(n) FROM ({_COUNTED}) GROUP BY 1)""")
def polarity_percent(spark, sf):
    return polarity.polarity_percent(base.entries(spark, sf))


@query("polarity_cumulative", f"""SELECT polarity, n::DOUBLE / t AS share, CAST(before AS DOUBLE) / t AS share_before FROM (
    SELECT polarity, n, sum(n) OVER () AS t, coalesce(sum(n) OVER (ORDER BY {base.order_sql('polarity')}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_COUNTED}))""")
def polarity_cumulative(spark, sf):
    return polarity.polarity_cumulative(base.entries(spark, sf))


def _trend(spark, sf):
    return trend.monthly_trend(base.dated_entries(spark, sf), "happened")


@query("monthly_trend", "SELECT period, avg_polarity FROM trend")
def monthly_trend(spark, sf):
    return _trend(spark, sf)


@query("trend_direction", """SELECT *, CASE WHEN last_avg > first_avg THEN 'improving' WHEN last_avg < first_avg THEN 'declining' ELSE 'stable' END AS direction
    FROM (SELECT min(period) AS first_period, max(period) AS last_period, arg_min(avg_polarity, period) AS first_avg,
    arg_max(avg_polarity, period) AS last_avg FROM trend)""")
def trend_direction(spark, sf):
    return trend.trend_direction(_trend(spark, sf))


@query("trend_low_point", "SELECT period, avg_polarity, avg_polarity < 0 AS marked FROM trend ORDER BY avg_polarity, period LIMIT 1")
def trend_low_point(spark, sf):
    return trend.trend_low_point(_trend(spark, sf))


@query("insight_tone", f"""SELECT *, CASE WHEN positive_pct >= 50 THEN 'predominantly positive' WHEN negative_pct >= 40 THEN 'skewing negative'
    ELSE 'mixed' END AS tone FROM (SELECT {', '.join(
        base.percent_sql(f"(count(*) FILTER ({base.group_sql('polarity')} = '{g}'))", 'count(*)') + f' AS {g}_pct'
        for g in ('positive', 'neutral', 'negative'))} FROM entries)""")
def insight_tone(spark, sf):
    return insights.insight_tone(base.entries(spark, sf))
