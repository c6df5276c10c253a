"""Summaries from stored partial counts."""

import pytest

from feedback_spark.functions import labels
from feedback_spark.operators import entries as rows_of, polarity, trend
from feedback_spark.plans import partials


@pytest.fixture
def entries(frame):
    levels, intents = [*labels.LEVELS, "odd", None], [*labels.INTENTS, None]
    rows = [
        (i, levels[i % len(levels)], intents[i % len(intents)], [True, False, None][i % 3], f"2025-{i % 4 + 1:02d}-03" if i % 5 else "x")
        for i in range(200)
    ]
    return frame("row_index long, polarity string, intent string, sarcasm_flag boolean, day string", *rows)


@pytest.mark.parametrize("include", [True, False])
def test_merged_partials_equal_the_entries(entries, include):
    parts = [partials.partial_counts(entries.filter(f"row_index % 3 = {k}"), timestamp_column="day") for k in range(3)]
    found = partials.counted(partials.merged(*parts), include)
    held = entries if include else entries.filter("NOT coalesce(sarcasm_flag, false)")

    def same(a, b):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

    same(partials.polarity_distribution(found), polarity.polarity_distribution(held))
    same(partials.intent_distribution(found), rows_of.intent_distribution(held))
    same(partials.monthly_trend(found), trend.monthly_trend(held, "day"))
    same(partials.sarcasm_summary(found), rows_of.sarcasm_summary(held))


def test_partials_of_nothing_and_of_narrow_entries(entries, frame):
    made = partials.summary(partials.partial_counts(entries.limit(0)), True).collect()
    assert {r.value for r in made} == {0.0} and len(made) == len(labels.LEVELS) + len(labels.INTENTS) + 1
    narrow = partials.partial_counts(frame("polarity string", ("Positive",), ("Positive",)))
    assert [(r.sarcasm_flag, r.intent, r.period, r.n) for r in narrow.collect()] == [(False, None, None, 2)]


def test_another_setting_reads_only_counts(spark, entries, tmp_path):
    path = str(tmp_path / "partials")
    partials.partial_counts(entries, timestamp_column="day").write.parquet(path)
    shown = partials.summary(spark.read.parquet(path), False)._jdf.queryExecution().toString()
    assert "original_text" not in shown and "FileScan parquet" in shown
