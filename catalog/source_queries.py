"""Sources and sinks: CSV, JSON, row numbers, stored results.

Files are written from the given tables to the session's shared folder and
read back, so what is scanned grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import query
from feedback_spark.functions import shares
from feedback_spark.operators import entries as rows_of, polarity, tokens
from feedback_spark.session import shared_path
from feedback_spark.sources import csv_files, json_documents as json_source, lexicons, row_keys, store


def _csv(df, path, **options):
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} | options
    df.write.options(**options).csv(path)
    return path


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("csv_scan", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {base.strip_sql('text')} AS text, lang, source,
    CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_scan(spark, sf):
    docs = base.documents(spark, sf, "text", "lang", "source", "n_chars")
    path = _csv(docs.withColumnRenamed("lang", " lang "), shared_path(spark, "csv"))
    return csv_files.read_csv(spark, path)


@query("drop_blank_rows", """SELECT doc_id, quality, toxic FROM (SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS quality,
    CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL""")
def drop_blank_rows(spark, sf):
    """Documents without a label are blank in both label columns."""
    labels = base.table(spark, sf, "labels")
    rows = base.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    rows = rows.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("quality", "toxic")])
    return csv_files.drop_blank_rows(rows, ["quality", "toxic"])


def _headerless(spark, sf):
    rows = base.feedback(spark, sf).select(
        "text", F.when(F.col("label").isNull(), "neutral").when(F.col("label") == "mixed", "neg").otherwise(F.col("label"))
    )
    return _csv(rows, shared_path(spark, "headerless"), header=False)


_TYPED = "CASE WHEN label IS NULL THEN 'neutral' WHEN label = 'mixed' THEN 'neg' ELSE label END"


@query("headerless_detect", "SELECT * FROM (VALUES ('headed', false), ('headerless', true)) v(kind, headerless)")
def headerless_detect(spark, sf):
    """The verdict for the file with and the file without a header, of the same rows."""
    headed = _csv(base.feedback(spark, sf).select(F.col("text").alias("raw_text"), "label"), shared_path(spark, "headed"))
    found = [
        csv_files.file_layouts(spark, path).groupBy(F.lit(kind).alias("kind")).agg(F.bool_and(~F.col("headed")).alias("headerless"))
        for kind, path in (("headed", headed), ("headerless", _headerless(spark, sf)))
    ]
    return found[0].unionByName(found[1])


@query("headerless_scan", f"SELECT {base.strip_sql('text')} AS raw_text, {base.strip_sql(_TYPED)} AS label FROM feedback")
def headerless_scan(spark, sf):
    return csv_files.read_csv(spark, _headerless(spark, sf))


@query("detect_encoding", "SELECT * FROM (VALUES ('UTF-8', true), ('ISO-8859-1', true)) v(encoding, as_written)")
def detect_encoding(spark, sf):
    """Files of both encodings side by side: whether each was found out as written."""
    folder = shared_path(spark, "encodings")
    docs = base.documents(spark, sf)
    for encoding in ("UTF-8", "ISO-8859-1"):
        _csv(docs, f"{folder}/{encoding}", encoding=encoding)
    found = csv_files.file_layouts(spark, [f"{folder}/UTF-8", f"{folder}/ISO-8859-1"])
    found = found.withColumn("encoding", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1"))
    return found.groupBy("encoding").agg(
        F.bool_and(F.contains("file", "encoding")).alias("as_written")
    )


@query("mixed_encoding_scan", f"SELECT CAST(page_id AS VARCHAR) AS page_id, url, host FROM ("
       "SELECT page_id, url, concat('caf', chr(233), ' ', page_id) AS host FROM pages UNION ALL "
       "SELECT page_id + 1000000, url, concat('caf', chr(233), ' ', page_id) FROM pages)")
def mixed_encoding_scan(spark, sf):
    """One data set of UTF-8 and latin-1 files, read as one frame."""
    folder = shared_path(spark, "mixed")
    pages = base.table(spark, sf, "pages").select(
        "page_id", "url", F.concat(F.lit("café "), F.col("page_id").cast("string")).alias("host")
    )
    _csv(pages, f"{folder}/a", encoding="UTF-8")
    _csv(pages.withColumn("page_id", F.col("page_id") + 1_000_000), f"{folder}/b", encoding="ISO-8859-1")
    return csv_files.read_csv(spark, [f"{folder}/a", f"{folder}/b"])


@query("row_cap", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def row_cap(spark, sf):
    return csv_files.row_cap(base.table(spark, sf, "events").select("event_id", "event_type"), 500, "event_id")


@query("row_index", "SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS row_index FROM events")
def row_index(spark, sf):
    return row_keys.row_index(base.table(spark, sf, "events"), "user_id", "event_id")


@query("file_row_index", """SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index,
    CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn FROM conversations""")
def file_row_index(spark, sf):
    """Numbers of rows read from several CSV files of unequal size that carry no key, written in a known order."""
    talk = base.table(spark, sf, "conversations")
    ordered = talk.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    path = _csv(ordered, shared_path(spark, "talk"))
    rows = csv_files.read_csv(spark, path, keep_file=True)
    return row_keys.file_row_index(rows).select("row_index", "conv_id", "turn")


@query("dataset_profile", "SELECT 'documents' AS filename, count(*) AS row_count, 5::BIGINT AS n_columns FROM documents")
def dataset_profile(spark, sf):
    made = csv_files.dataset_profile(base.table(spark, sf, "documents"), "documents")
    return made.select("filename", "row_count", F.size("columns").cast("long").alias("n_columns"))


@query("preview_rows", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def preview_rows(spark, sf):
    return csv_files.preview_rows(base.table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")


@query("guess_columns", """SELECT doc_id, coalesce(arg_min(word, CASE WHEN regexp_matches(word, 'text|comment|review|body|content') THEN pos END),
    arg_min(word, pos)) AS text_column, arg_min(word, CASE WHEN regexp_matches(word, 'date|time|created|timestamp') THEN pos END) AS date_column
    FROM tok GROUP BY doc_id""")
def guess_columns(spark, sf):
    """The words of each document taken as the column names of a data set."""
    names = tokens.tokens(base.cleaned(spark, sf)).withColumnRenamed("word", "name")
    return csv_files.guess_columns(names, "doc_id")


@query("json_documents", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
    text AS raw_text, role AS label FROM conversations""")
def json_documents(spark, sf):
    """One JSON body for each conversation, its turns as the documents."""
    record = F.struct("turn", F.struct(F.col("text").alias("raw_text"), F.col("role").alias("label")).alias("d"))
    listed = F.transform(F.sort_array(F.collect_list(record)), lambda x: x["d"])
    bodies = base.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.to_json(F.struct(listed.alias("documents"))).alias("body")
    )
    return json_source.json_documents(bodies, "body", "conv_id")


@query("json_normalise", """SELECT event_id, event_type AS emotion, value AS pct FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, 'second', value FROM events WHERE event_id % 4 IN (0, 2)""")
def json_normalise(spark, sf):
    """Four shapes in turn: a list, a bare record, a record of records, nothing."""
    one = F.struct(F.col("event_type").alias("emotion"), F.col("value").alias("pct"))
    two = F.struct(F.lit("second").alias("emotion"), F.col("value").alias("pct"))
    kind = F.col("event_id") % 4
    body = (
        F.when(kind == 0, F.to_json(F.array(one, two)))
        .when(kind == 1, F.to_json(one))
        .when(kind == 2, F.to_json(F.struct(one.alias("1"), two.alias("2"))))
    )
    parsed = shares.records(F.col("body"), "emotion string, pct double")
    events = base.table(spark, sf, "events").select("event_id", body.alias("body"))
    return events.select("event_id", F.inline(parsed))


@query("lexicon_profile", """SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment, count(DISTINCT word) AS words
    FROM tok t JOIN labels l ON t.doc_id = l.doc_id GROUP BY 1""")
def lexicon_profile(spark, sf):
    """A word list as large as the vocabulary: words of labelled documents by their label."""
    path = shared_path(spark, "lexicon")
    labels = base.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"))
    tokens.tokens(base.cleaned(spark, sf)).join(labels, "doc_id").select("word", "sentiment").write.parquet(path)
    return lexicons.lexicon_profile(lexicons.load_lexicon(spark, path))


# ---- sinks -----------------------------------------------------------------

_NARROW = ["row_index", "polarity", "polarity_confidence", "sarcasm_flag"]


@query("write_entries", """SELECT row_index, polarity, polarity_confidence, sarcasm_flag, concat('job-', intent) AS job_id
    FROM entries WHERE intent = 'complaint'""")
def write_entries(spark, sf):
    """All jobs appended to one store, one of them read back through its partition."""
    path = shared_path(spark, "entries")
    made = base.entries(spark, sf).select(*_NARROW, F.concat(F.lit("job-"), F.col("intent")).alias("job_id"))
    store.write_entries(made, path)
    return store.read_entries(spark, path, "job-complaint")


def _stored_aggregates(spark, sf):
    path = shared_path(spark, "aggregates")
    counted = base.entries(spark, sf).groupBy(F.concat(F.lit("job-"), F.col("intent")).alias("job_id"), "polarity").agg(
        F.count(F.lit(1)).alias("n")
    )
    store.upsert_aggregates(counted, path)
    again = counted.filter("job_id = 'job-inquiry'").withColumn("n", F.col("n") * 10)
    store.upsert_aggregates(again, path)
    return path


@query("upsert_aggregates", """SELECT concat('job-', intent) AS job_id, polarity,
    count(*) * CASE WHEN intent = 'inquiry' THEN 10 ELSE 1 END AS n FROM entries GROUP BY intent, polarity""")
def upsert_aggregates(spark, sf):
    """All jobs stored, then one of them replaced; the others stay."""
    return spark.read.parquet(_stored_aggregates(spark, sf))


@query("read_summary", "SELECT 'job-complaint' AS job_id, polarity, count(*) AS n FROM entries WHERE intent = 'complaint' GROUP BY polarity")
def read_summary(spark, sf):
    path = _stored_aggregates(spark, sf)
    return store.read_summary(spark, path, "job-complaint")


@query("write_summary_json", f"""SELECT l.polarity, count(e.row_index) AS n FROM {base.LEVELS_SQL}
    LEFT JOIN entries e ON e.polarity = l.polarity GROUP BY l.polarity""")
def write_summary_json(spark, sf):
    """The distribution written as JSON lines and read back."""
    path = shared_path(spark, "summary")
    store.write_json(polarity.polarity_distribution(base.entries(spark, sf)), path)
    return spark.read.schema("polarity string, n bigint").json(path)


@query("write_annotated_csv", """SELECT CAST(e.event_id AS VARCHAR) AS event_id, e.event_type, e.polarity AS fb_polarity,
    CASE WHEN e.sarcasm_flag THEN 'True' ELSE 'False' END AS fb_sarcasm_flag FROM entries e""")
def write_annotated_csv(spark, sf):
    """The annotated rows as CSV parts, scanned again."""
    path = shared_path(spark, "annotated")
    rows = base.table(spark, sf, "events").select(F.col("event_id").alias("row_index"), "event_id", "event_type")
    store.write_annotated_csv(rows_of.annotated_rows(rows, base.entries(spark, sf), "fb_"), path)
    return csv_files.read_csv(spark, path).select("event_id", "event_type", "fb_polarity", "fb_sarcasm_flag")
