"""Files, row numbers and stored results."""

import json

import pytest
from pyspark.sql import functions as F

from feedback_spark.session import shared_path
from feedback_spark.sources import csv_files, json_documents, lexicons, row_keys, store


@pytest.fixture
def written(tmp_path):
    def write(content, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(path)

    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_headed_file(spark, written):
    df = csv_files.read_csv(spark, written(
        ' id , comment ,,\n1, "hi" ,x,\n,,,\n2,"a, ""b""\nnext line",y,z\n3,only\n  , \t ,,\n\n4,four,q,w,extra\n'.replace(' "hi" ', '"hi "')
    ))
    assert df.columns == ["id", "comment"]
    assert sorted(rows(df)) == [("1", "hi"), ("2", 'a, "b"\nnext line'), ("3", "only"), ("4", "four")]


def test_byte_order_mark_and_repeated_names(spark, written):
    df = csv_files.read_csv(spark, written(b"\xef\xbb\xbftext,n,n\nhello,1,2\n"))
    assert df.columns == ["text", "n"] and rows(df) == [("hello", "2")]


def test_headerless_file(spark, written):
    content = 'The show was grand!,pos\n"Okay, nothing more.",neutral\nlonely\n , \nGood,\n'
    found = csv_files.file_layouts(spark, written(content)).first()
    assert not found.headed and found.names == ["raw_text", "label"]
    df = csv_files.read_csv(spark, written(content))
    assert sorted(rows(df)) == [("Good", ""), ("Okay, nothing more.", "neutral"), ("The show was grand!", "pos")]


@pytest.mark.parametrize("line, verdict", [
    ("nice,pos", True), ("nice, Negative ", True), ("text,pos", False), ("Raw_Text,label", False), ("nice,good", False),
    (",pos", False), ("a,b,pos", False), ("nice", False),
])
def test_headerless_verdict(spark, written, line, verdict):
    assert csv_files.file_layouts(spark, written(line + "\nx,y\n")).first().headed is not verdict


def test_encodings(spark, written):
    one = written("text,label\ncafé,a\n", "utf.csv")
    two = written("text,label\ncafé,b\n".encode("latin-1"), "latin.csv")
    found = {r.file.rsplit("/", 1)[1]: r.utf8 for r in csv_files.file_layouts(spark, [one, two]).collect()}
    assert found == {"utf.csv": True, "latin.csv": False}
    assert sorted(rows(csv_files.read_csv(spark, [one, two]))) == [("café", "a"), ("café", "b")]
    assert rows(csv_files.read_csv(spark, two)) == [("café", "b")]


def test_empty_files(spark, written):
    with pytest.raises(ValueError, match="empty"):
        csv_files.read_csv(spark, written(""))
    with pytest.raises(ValueError, match="no data"):
        csv_files.require_rows(csv_files.read_csv(spark, written("a,b\n")))
    with pytest.raises(ValueError, match="header"):
        csv_files.read_csv(spark, written(",\n1,2\n"))


def test_limit_and_cap(spark, written):
    df = csv_files.read_csv(spark, written("a,b\n" + "".join(f"{i},x\n" for i in range(20))), limit=7)
    assert df.count() == 7
    numbered = spark.range(20).withColumnRenamed("id", "row_index")
    assert csv_files.row_cap(numbered, None).count() == 20
    assert sorted(r.row_index for r in csv_files.row_cap(numbered, 3).collect()) == [0, 1, 2]


def test_guess_columns(spark, written):
    df = csv_files.read_csv(spark, written("id,Created_At,Comment,review\n1,2,3,4\n"))
    assert tuple(csv_files.guess_columns(csv_files.column_names(df)).first()) == ("Comment", "Created_At")
    plain = csv_files.read_csv(spark, written("a,b\n1,2\n", "p.csv"))
    assert tuple(csv_files.guess_columns(csv_files.column_names(plain)).first()) == ("a", None)


def test_profile_and_preview(spark):
    df = spark.range(9).withColumnRenamed("id", "row_index").repartition(3)
    made = csv_files.dataset_profile(df, "f.csv").first()
    assert (made.filename, made.row_count, made.columns) == ("f.csv", 9, ["row_index"]) and made.uploaded_at
    assert [r.row_index for r in csv_files.preview_rows(df).collect()] == [0, 1, 2, 3, 4]


def test_row_index_by_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("hot"), F.col("id").alias("k"))
    df = df.withColumn("hot", F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("hot"))).repartition(7)
    got = rows(row_keys.row_index(df, "hot", "k").orderBy("row_index"))
    assert [(h, k) for h, k, _ in got] == sorted((h, k) for h, k, _ in got)
    assert [i for _, _, i in got] == list(range(1000))


def test_row_index_of_a_file_keeps_line_order(spark, written):
    df = csv_files.read_csv(spark, written("a,b\n" + "".join(f"{i},x\n,\n" for i in range(300))), keep_file=True)
    got = rows(row_keys.file_row_index(df).orderBy("row_index").select("row_index", "a"))
    assert got == [(i, str(i)) for i in range(300)]
    many = spark.range(500).repartition(6).selectExpr("id", "'f' AS source_file", "id AS source_place")
    assert sorted(tuple(r) for r in row_keys.file_row_index(many).select("row_index", "id").collect()) == [(i, i) for i in range(500)]


def test_rows_of_several_files_follow_their_names(spark, written):
    small, large = written("a\nfirst\n", "a.csv"), written("a\n" + "".join(f"{i}\n" for i in range(7)), "b.csv")
    df = csv_files.read_csv(spark, [large, small], keep_file=True)
    assert [r.a for r in row_keys.file_row_index(df).orderBy("row_index").collect()] == ["first", *map(str, range(7))]


def test_files_of_one_folder_may_differ(spark, tmp_path):
    folder = tmp_path / "a folder" / "with spaces"
    folder.mkdir(parents=True)
    (folder / "a - Copy.csv").write_bytes("raw_text,label,extra\ncafé,pos,1\n".encode("utf-8"))
    (folder / "b.csv").write_bytes("très bien,pos\nfin,neg\n".encode("latin-1"))
    (folder / "c.csv").write_bytes(b"\xef\xbb\xbflabel,raw_text\nneg,\"two\nlines\"\n")
    df = csv_files.read_csv(spark, str(tmp_path / "a folder*" / "with spaces"))
    assert df.columns == ["raw_text", "label", "extra"]
    assert sorted(rows(df)) == [("café", "pos", "1"), ("fin", "neg", ""), ("très bien", "pos", ""), ("two\nlines", "neg", "")]


def test_lines_without_breaks_in_quotes_can_be_split(spark, written):
    df = csv_files.read_csv(spark, written("a,b\n" + "".join(f'{i},"x, y"\n' for i in range(50))), multi_line=False)
    assert sorted(rows(df)) == sorted((str(i), "x, y") for i in range(50))


def test_an_emptied_job_loses_its_rows(spark, tmp_path, frame):
    path = str(tmp_path / "store")
    store.upsert_aggregates(frame("job_id string, n int", ("a/b", 1), ("c", 2)), path)
    store.upsert_aggregates(frame("job_id string, n int", ("c", 3)), path, jobs=["a/b", "c"])
    assert rows(spark.read.parquet(path).select("job_id", "n")) == [("c", 3)]


def test_a_failed_upsert_keeps_the_old_rows(spark, tmp_path, frame):
    path = str(tmp_path / "store")
    store.upsert_aggregates(frame("job_id string, n int", ("a", 1), ("b", 2)), path)
    broken = frame("job_id string, n int", ("a", 5)).select("job_id", F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.upsert_aggregates(broken, path, jobs=["a", "b"])
    assert sorted(rows(spark.read.parquet(path).select("job_id", "n"))) == [("a", 1), ("b", 2)]
    # Rows made from the store's own.
    store.upsert_aggregates(spark.read.parquet(path).filter("job_id = 'a'").select("job_id", (F.col("n") + 1).alias("n")), path, jobs=["a"])
    assert sorted(rows(spark.read.parquet(path).select("job_id", "n"))) == [("a", 2), ("b", 2)]


def test_small_numbers_are_written_in_plain_digits(spark, tmp_path, frame):
    path = str(tmp_path / "out")
    store.write_annotated_csv(frame("row_index long, score double", (0, 0.0005), (1, 0.25), (2, None), (3, 1e25)), path)
    assert sorted(r.score for r in csv_files.read_csv(spark, path).collect()) == ["0.0005", "0.25", "1.0E25"]


def test_json_bodies(frame):
    body = json.dumps({"documents": [{"raw_text": "a", "label": "pos"}, {"raw_text": "b"}]})
    assert rows(json_documents.json_documents(frame("body string", (body,)))) == [(0, "a", "pos"), (1, "b", None)]
    with pytest.raises(Exception, match="documents"):
        json_documents.json_documents(frame("body string", ('{"x": 1}',))).collect()


def test_lexicons(spark, tmp_path):
    path = tmp_path / "lex.csv"
    path.write_text("word,sentiment\n Good ,positive\ngood,positive\nbad,negative\n,negative\n")
    df = lexicons.load_lexicon(spark, str(path))
    assert sorted(rows(df)) == [("bad", "negative"), ("good", "positive")]
    assert {tuple(r) for r in lexicons.lexicon_profile(df).collect()} == {("positive", 1), ("negative", 1)}
    seed = lexicons.Lexicons.seed(spark)
    assert seed.polarity.groupBy("word").count().filter("count > 1").count() == 0
    assert seed.stops.filter("word IN ('the', 'don', 't')").count() == 3
    assert len(lexicons.Shifters(tuple(map(str, range(5000))), (), ()).negators) == 5000


def test_store_round_trip(spark, frame):
    path = shared_path(spark, "t")
    one = frame("job_id string, row_index long", ("a", 0), ("b", 0))
    store.write_entries(one, path)
    store.write_entries(frame("job_id string, row_index long", ("a", 1)), path)
    assert sorted(r.row_index for r in store.read_entries(spark, path, "a").collect()) == [0, 1]
    assert "PartitionFilters: [isnotnull(job_id" in store.read_entries(spark, path, "a")._jdf.queryExecution().toString()


def test_upsert_replaces_only_its_jobs(spark, frame):
    path = shared_path(spark, "t")
    store.upsert_aggregates(frame("job_id string, n long", ("a", 1), ("b", 2)), path)
    store.upsert_aggregates(frame("job_id string, n long", ("b", 5)), path)
    assert sorted(rows(spark.read.parquet(path).select("job_id", "n"))) == [("a", 1), ("b", 5)]
    assert store.read_summary(spark, path, "b").first().n == 5


def test_annotated_csv_has_mark_and_header(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    store.write_annotated_csv(frame("row_index long, text string, label string", (1, ' b "q"', None), (0, "a,\nb", "x")), path)
    parts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert parts and all(p.startswith(b"\xef\xbb\xbftext,label\n") for p in parts)
    assert sorted(rows(csv_files.read_csv(spark, path))) == [("a,\nb", "x"), ('b "q"', "")]


def test_json_output(spark, frame, tmp_path):
    path = str(tmp_path / "j")
    store.write_json(frame("a int, b array<string>", (1, ["x"])), path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"a": 1, "b": ["x"]}]
