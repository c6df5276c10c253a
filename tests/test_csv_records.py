"""Quoted records across lines, chunks and splits."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from feedback_spark.sources import csv_files, csv_records


def written_rows(n, seed):
    """Rows whose cells hold commas, quotes and line breaks."""
    rng = random.Random(seed)
    pool = ["a", "bc", " ", ",", '"', "\n", "\r\n", '""', "é", "word word", "x" * 40]
    return [[str(i), *("".join(rng.choices(pool, k=rng.randrange(9))) for _ in range(2))] for i in range(n)]


def as_text(rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    return out.getvalue()


def trimmed(rows):
    return sorted((a.strip(), b.strip(), c.strip()) for a, b, c in rows)


@pytest.mark.parametrize("splits, chunk, ending", [(1, 4_000_000, "\n"), (7, 300, "\n"), (64, 1, "\r\n"), (23, 2_000, "\r\n")])
def test_records_do_not_depend_on_splits(spark, tmp_path, monkeypatch, splits, chunk, ending):
    rows = written_rows(400, splits)
    raw = ("id,one,two" + ending + as_text(rows, ending)).encode()
    (tmp_path / "data.csv").write_bytes(raw)
    (tmp_path / "more.csv").write_bytes(b'id,one,two\n-1,"open\n\nline, ""still""')
    monkeypatch.setattr(csv_records, "CHUNK_BYTES", chunk)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, len(raw) // splits)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = csv_files.read_csv(spark, str(tmp_path), keep_file=True)
        got = df.orderBy("source_file", "source_place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[:3] for r in got[:-1]] == [tuple(c.strip(" \t\r\n") for c in r) for r in rows]
    assert tuple(got[-1])[:3] == ("-1", 'open\n\nline, "still"', "")


def test_store_is_read_however_it_is_packed(spark, tmp_path, monkeypatch):
    """The stored lines carry their place, so a later scan may pack their files in any way."""
    rows = written_rows(300, 5)
    (tmp_path / "data.csv").write_text(as_text(rows))
    monkeypatch.setattr(csv_records, "CHUNK_BYTES", 200)
    stored = csv_records.stored_lines(spark, str(tmp_path / "data.csv"))
    found = []
    for parts in (1, 5, 50):
        spark.conf.set("spark.sql.files.minPartitionNum", str(parts))
        try:
            chunks = csv_records.with_states(stored.repartition(parts))
            found.append(sorted((tuple(r.place), r.record) for r in csv_records.cut(chunks).collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def plain_states(line, inside):
    """The state behind a line, character by character."""
    i, n, at_start = 0, len(line), not inside
    while i < n:
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
                    i += 1
                    while i < n and line[i] != ",":
                        i += 1
                    at_start = True
        elif at_start and c == '"':
            inside = True
        elif c != ",":
            while i < n and line[i] != ",":
                i += 1
            at_start = True
        i += 1
    return inside


def test_line_maps_equal_a_scan_by_character():
    rng = random.Random(1)
    lines = ["".join(rng.choices('ab,"" \r', k=rng.randrange(12))) for _ in range(4000)]
    outside, inside = csv_records.line_maps(pa.array([x.encode() for x in lines]))
    assert outside.tolist() == [plain_states(x, False) for x in lines]
    assert inside.tolist() == [plain_states(x, True) for x in lines]


def test_states_compose():
    rng = np.random.default_rng(2)
    for _ in range(200):
        outside, inside = rng.integers(0, 2, (2, 30)).astype(bool)
        for start in (False, True):
            state, want = start, []
            for a, b in zip(outside, inside):
                state = b if state else a
                want.append(bool(state))
            assert csv_records.states_after(outside, inside, start).tolist() == want


def test_long_line_with_many_quotes_is_read_in_proportion():
    line = b'"' + b'a""' * 400_000
    outside, inside = csv_records.line_maps(pa.array([line, line + b'"']))
    assert outside.tolist() == [True, False]


def test_a_record_is_cut_into_cells_once(spark, tmp_path):
    """Whatever the number of columns, the plan of the rows parses and decodes each record at one place."""
    (tmp_path / "data.csv").write_text("a,b,c,d,e\n1,2,3,4,5\n,,,,\n 6 ,,,,\n")
    rows = csv_files.read_csv(spark, str(tmp_path / "data.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "2", "3", "4", "5"), ("6", "", "", "", "")]
    shown = rows._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("from_csv(") == 1


def test_stored_chunks_are_cut_without_python(spark, tmp_path, monkeypatch):
    """Python workers would get as many chunks at a time as an Arrow batch takes; a record over several chunks is whole all the same."""
    text = 'a,b\n1,"x\n\ny\r\n""z"""\r\n\n2,\u00e9\n3,"open\n\n'
    (tmp_path / "data.csv").write_text(text, newline="")
    monkeypatch.setattr(csv_records, "CHUNK_BYTES", 9)
    rows = csv_files.read_csv(spark, str(tmp_path / "data.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", 'x\n\ny\r\n"z"'), ("2", "\u00e9"), ("3", "open")]
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
