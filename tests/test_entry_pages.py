"""Entries stored as ranged files with a directory."""

import pytest
from pyspark.sql import functions as F

from feedback_spark.operators.entries import entries_page
from feedback_spark.sources import entry_pages


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "a store")
    rows = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("row_index"),
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "a:b %*[x]").alias("job_id"),
        F.concat(F.lit("text "), F.col("id")).alias("original_text"),
    )
    entry_pages.write_pages(rows, path, files=24)
    return path, rows


@pytest.mark.parametrize("job", ["big", "a:b %*[x]", None, "unknown"])
@pytest.mark.parametrize("page,limit", [(1, 20), (3, 7), (34, 100), (35, 100), (900, 100)])
def test_pages_equal_a_sort(spark, stored, job, page, limit):
    path, rows = stored
    own = rows.filter(F.col("job_id").eqNullSafe(F.lit(job)))
    made = entry_pages.stored_page(spark, path, job, page, limit)
    assert made.select(rows.columns).collect() == entries_page(own, page, limit).collect()
    assert entry_pages.stored_total(spark, path, job).first().total == own.count()


def test_a_deep_page_opens_few_files(spark, stored):
    path, _ = stored
    assert len(spark.read.parquet(path).inputFiles()) > 20
    assert len(entry_pages.stored_page(spark, path, "big", 30, 100).inputFiles()) <= 2
    assert len(entry_pages.stored_entry(spark, path, "big", 2222).inputFiles()) == 1


def test_entries_are_found_by_key(spark, stored):
    path, rows = stored
    for value in (0, 4999, 1234, 5000, -1):
        for job in ("big", None):
            own = rows.filter(F.col("job_id").eqNullSafe(F.lit(job)) & (F.col("row_index") == value))
            assert entry_pages.stored_entry(spark, path, job, value).select(rows.columns).collect() == own.collect()


def test_a_job_written_again_is_replaced_and_others_stay(spark, frame, tmp_path):
    path, schema = str(tmp_path / "s"), "row_index long, job_id string, v string"
    entry_pages.write_pages(frame(schema, (1, "a", "old"), (2, "a", "old"), (1, "b", "kept")), path)
    entry_pages.write_pages(frame(schema, (None, "a", "none"), (5, "a", "new"), (5, "a", "twin")), path)
    got = lambda job: [(r.row_index, r.v) for r in entry_pages.stored_page(spark, path, job).collect()]
    assert got("a")[0] == (None, "none") and sorted(got("a")[1:]) == [(5, "new"), (5, "twin")] and got("b") == [(1, "kept")]
    assert sorted(r.v for r in entry_pages.stored_entry(spark, path, "a", 5).collect()) == ["new", "twin"]
    assert entry_pages.stored_page(spark, path, "a", 2).count() == 0


def test_page_numbers_are_checked(spark, stored):
    for page, limit in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            entry_pages.stored_page(spark, stored[0], "big", page, limit)
