"""Physical plans, streams, and every query of the catalogue against its SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalog import base, text_queries
from check import connect, difference
from feedback_spark.functions import labels, text
from feedback_spark.operators import cleaning, keywords, polarity, tokens
from feedback_spark.plans import corpus
from feedback_spark.session import local_session, shared_path, spread
from feedback_spark.sources import csv_files

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cleaned(frame):
    return cleaning.clean_documents(frame("doc_id long, raw_text string, label string", *[(i, f"thor er w{i}", "pos") for i in range(50)]))


def test_lexicons_are_broadcast_and_text_is_not_shuffled(spark, cleaned):
    lists = base.lexicons(spark)
    shown = plan(polarity.hybrid_polarity(cleaned, lists.polarity, lists.weights, lists.shifters))
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    document_shuffles = re.findall(r"Exchange hashpartitioning\(doc_id", shown)
    assert len(document_shuffles) == 1
    after = shown[shown.index("Exchange hashpartitioning(doc_id"):].splitlines()[1]
    assert "partial_count" in after


def test_a_large_lexicon_is_not_broadcast(spark, cleaned):
    path = shared_path(spark, "large")
    spark.range(1000).select(F.sha2(F.col("id").cast("string"), 512).alias("word"), F.lit("positive").alias("sentiment")).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        shown = plan(polarity.bing_hits(tokens.tokens(cleaned), spark.read.parquet(path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in shown


def test_keyword_hits_have_no_join(spark, frame):
    texts = frame("row_index long, text string, polarity string", (0, "a", "Positive"))
    shown = plan(keywords.keyword_hits(keywords.keyword_marks(texts, frame("word string, n long", ("a", 3)))))
    assert "NestedLoopJoin" not in shown and "CartesianProduct" not in shown


def test_cleaning_is_worked_out_once(cleaned):
    assert plan(cleaned.select("doc_id", "cleaned_text")).count("https?") == 1


def test_words_are_split_outside_the_loop_over_words(spark, cleaned):
    """A few times per document (explode, list beside it, null check), never for each word."""
    lists = base.lexicons(spark)
    for df in (
        tokens.bigrams(cleaned),
        polarity.hybrid_polarity(cleaned, lists.polarity, lists.weights, lists.shifters),
    ):
        shown = plan(df)
        above_explode, below_explode = shown[: shown.index("Generate posexplode")], shown[shown.index("Generate posexplode"):]
        assert "split(" not in above_explode and below_explode.count("split(") <= 3


def test_stems_are_worked_out_once_per_distinct_word(cleaned):
    shown = plan(tokens.stemmed(tokens.tokens(cleaned)))
    stems, distinct = shown.index("biliti"), shown.index("HashAggregate(keys=[word")
    assert shown.count("Generate explode(filter(array(CASE WHEN (length(word") == 1 and stems < distinct


def test_top_words_is_a_bounded_sort(spark, cleaned):
    shown = plan(keywords.top_words(keywords.word_counts(tokens.words_only(cleaned)), base.lexicons(spark).stops))
    assert "TakeOrderedAndProject" in shown


@needs_tables
def test_scan_reads_only_needed_columns(spark):
    shown = plan(base.cleaned(spark, SF).select("doc_id", "cleaned_text"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown and "PushedFilters: [IsNotNull(text)]" in shown


def test_spread_leaves_wide_input_alone(spark):
    assert spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_row_operators_run_on_a_stream(spark, frame, tmp_path):
    """Cleaning and mapping keep no state, so they take a stream as they are."""
    source = str(tmp_path / "in")
    frame("doc_id long, raw_text string, label string", (0, "Hello <b>World</b>", "pos"), (1, "!!!", "neg")).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, raw_text string, label string").parquet(source)
    out = cleaning.clean_documents(stream).withColumn("level", labels.polarity_class(F.lit(0.5)))
    run = out.writeStream.format("memory").queryName("cleaned_stream").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.cleaned_text, r.word_count, r.level) for r in spark.table("cleaned_stream").collect()] == [("hello world", 2, "Very Positive")]


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert len(got) or name == "entries_filter"
    statement = contract.oracle_sql().get(name)
    if statement:
        assert difference(got, connect(SF).execute(statement).df()) is None


@needs_tables
def test_entry(spark):
    assert sum(r.n for r in contract.entry(spark).collect()) == 200


@needs_tables
def test_headerless_detect_verdicts(spark):
    got = {r.kind: r.headerless for r in contract.queries()["headerless_detect"](spark, SF).collect()}
    assert got == {"headed": False, "headerless": True}


@needs_tables
def test_files_are_told_by_encoding(spark):
    rows = contract.queries()["detect_encoding"](spark, SF).collect()
    assert {r.encoding for r in rows} == {"UTF-8", "ISO-8859-1"}
    latin = next(r for r in rows if r.encoding == "ISO-8859-1")
    assert latin.as_written


def test_counts_by_document_move_texts_and_no_words(spark, frame):
    cleaned = frame("doc_id long, cleaned_text string", (1, "a b a"), (2, "b"), (2, "b"), (None, "a"))
    langs = frame("doc_id long, lang string", (1, "x"), (2, "y"), (2, "y"))
    counted = tokens.doc_term_counts(tokens.tokens(tokens.by_document(cleaned)))
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan(counted.join(langs.hint("merge"), "doc_id")))
    assert shuffles and not [s for s in shuffles if "word" in s]
    assert sorted((r.doc_id or 0, r.word, r.n) for r in counted.collect()) == [(0, "a", 1), (1, "a", 2), (1, "b", 1), (2, "b", 2)]


@needs_tables
def test_terms_of_a_language_count_without_a_shuffle_of_words(spark):
    shown = plan(text_queries.top_terms_ties(spark, "/root/testdata/sf0.001"))
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, word#", shown)


def test_names_no_group_can_choose_are_not_sorted(spark, frame):
    names = frame(
        "g long, name string, pos int", (1, "a", 3), (1, "b", 4), (1, "Review text", 9), (2, "c", 0), (2, "x", 5), (2, "y", 6), (2, "date", 7),
        (None, None, 2), (None, "z", 8), (3, "w", None), (4, None, 1), (4, "body", 9), (4, None, 9),
    )
    found = csv_files.guess_columns(names, "g")
    assert {(r.g, r.text_column, r.date_column) for r in found.collect()} == {
        (1, "Review text", None), (2, "c", "date"), (None, None, None), (3, None, None), (4, "body", None)
    }
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[g.*\n.*Filter \(.*RLIKE.*scalar-subquery", shown), shown
    assert csv_files.guess_columns(names.filter("g = 1").drop("g")).first().text_column == "Review text"
    assert csv_files.guess_columns(names.limit(0)).collect()[0].text_column is None


def test_texts_are_cleaned_once_in_an_analysis(spark, frame):
    """All parts of a corpus result read the stored cleaned texts; none runs the cleaning patterns again."""
    docs = frame("doc_id long, raw_text string, label string", *[(i, f"thor er best w{i}", "pos") for i in range(20)])
    result = corpus.corpus_analysis(docs, base.lexicons(spark), key="doc_id", with_topics=False)
    for part in (result.cleaned, result.scored, result.top_words, result.document_emotions):
        assert "https?" not in plan(part)
    assert result.scored.count() == 20
    result.release()
