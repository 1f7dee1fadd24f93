"""The section store, stages, and the streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from folium.operators import runs, storage, store
from folium.schemas import SECTIONS, as_struct
from folium.streaming import ingest


def rows(spark, *items):
    return store.records(spark.createDataFrame(items, "book_title string, chapter string, title string, content string, section_index int"))


def test_upsert(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "s"), 4)
    assert s.upsert(rows(spark, ("a", "1", "x", "old", 0), ("b", "1", "x", "b", 0))) == {"sections_changed": 2, "sections_total": 2, "files": 1}
    assert s.upsert(rows(spark, ("a", "1", "x", "new", 0), ("b", "1", "x", "b", 0), ("a", "2", "x", "more", 1)))["sections_changed"] == 2
    assert sorted((r.book_title, r.chapter, r.content) for r in s.read().collect()) == [("a", "1", "new"), ("a", "2", "more"), ("b", "1", "b")]
    assert store.collisions(s.read()).count() == 0
    assert s.upsert(rows(spark, ("a", "1", "x", "new", 0)))["sections_changed"] == 0


def test_scan_and_latest(spark):
    df = spark.createDataFrame([("2", "b", None, None, "x" * 100), ("1", "b", "c", 3, "é" * 99), ("3", "a", "c", 3, None)], "id string, book_title string, chapter string, section_index int, content string")
    assert [tuple(r) for r in store.scan(df).collect()] == [("2", "b", "", 0, "x" * 100)]
    again = df.unionByName(df.selectExpr("'9' as id", "book_title", "chapter", "section_index", "'new' as content"))
    assert {r.id for r in store.latest(again, ["book_title", "chapter", "section_index"]).collect()} == {"9"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", "01_x.txt", "one\ntwo\n"), ("b", "02_y.txt", "")], "book string, file string, text string")
    assert store.export_texts(df, str(tmp_path / "t")) == 2
    assert next((tmp_path / "t/book=b/file=01_x.txt").glob("part*")).read_text() == "one\ntwo\n"


def test_stages(spark, tmp_path):
    df = spark.createDataFrame([("c", "p")], "concept string, prerequisite string")
    storage.save_stage(df, str(tmp_path), "edges", "book")
    assert storage.load_stage(spark, str(tmp_path), "edges", "book", df.schema).count() == 1
    with pytest.raises(ValueError):
        storage.load_stage(spark, str(tmp_path), "edges", "book", "concept int")
    with pytest.raises(ValueError):
        storage.stage_path("r", "other", "b")


def test_stream(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "s"), 2)
    for n in range(2):
        rows(spark, ("a", "1", "x", f"v{n}", 0), ("a", str(n + 5), "x", "c", 0)).select(*as_struct(SECTIONS).names).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.section_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.chapter, r.content) for r in s.read().collect()) == [("1", "v1"), ("5", "c"), ("6", "c")]


def test_last_write_of_a_batch_wins(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "s"), 2)
    batch = rows(spark, ("a", "1", "x", "one", 0), ("a", "1", "x", "two", 1), ("a", "1", "x", "two", 1), ("a", "1", "x", "a last", 3)).repartition(3)
    assert s.upsert(batch) == {"sections_changed": 3, "sections_total": 4, "files": 1}
    assert [(r.content, r.section_index) for r in s.read().collect()] == [("a last", 3)]
    ordered = store.records(spark.createDataFrame([("a", "1", "x", "z", 9, 1), ("a", "1", "x", "y", 0, 2)], "book_title string, chapter string, title string, content string, section_index int, at int"))
    by = ordered.withColumn("at", F.when(F.col("content") == "y", 2).otherwise(1))
    s.upsert(by, order="at")
    assert [r.content for r in s.read().collect()] == ["y"]


def test_scan_is_sorted(spark):
    text = "x" * 100
    df = spark.createDataFrame([(i, "b", "c", i % 3, text) for i in (10, 9, 2, 33, 1)], "id long, book_title string, chapter string, section_index int, content string").repartition(4)
    assert [r.id for r in store.scan(df, "b").collect()] == ["1", "2", "9", "10", "33"]
    assert store.count(df, "b").first().n == 5 and store.count(df, "none").first().n == 0


def test_json_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("b", "01_x", [("c", 3, 0, "introduction")])], "book string, chapter string, sections array<struct<content string, endline int, startline int, title string>>")
    store.export_json(df, str(tmp_path / "j"))
    text = next((tmp_path / "j/book=b/chapter=01_x").glob("part*")).read_text()
    assert json.loads(text) == [{"content": "c", "endline": 3, "startline": 0, "title": "introduction"}] and "\n  " in text


def test_ingest_directory(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "s"), 2)
    folder = tmp_path / "in"
    assert runs.ingest_directory(spark, str(folder), s, "B").code == runs.NO_FOLDER
    folder.mkdir()
    (folder / "note.txt").write_text("x")
    assert runs.ingest_directory(spark, str(folder), s, "B") == runs.Ingest(runs.NO_FILES)
    (folder / "03_Chapter_1__Welcome_Aboard.json").write_text('[{"title": "introduction", "content": "c", "startline": 0, "endline": 4}, {"title": "subsection1"}]')
    (folder / "04_bad.json").write_text('{"title": "t"}')
    assert runs.ingest_directory(spark, str(folder), s, "B", "metadata:title", "/b.pdf") == runs.Ingest(runs.DONE, 2, 2, 2)
    got = {r.title: r.asDict() for r in s.read().collect()}
    assert got["introduction"] | {"bucket": 0} == {
        "book_title": "B", "book_title_src": "metadata:title", "book_path": "/b.pdf", "chapter_file": "03_Chapter_1__Welcome_Aboard.json", "chapter": "03_Chapter_1__Welcome_Aboard",
        "chapter_title": "welcome aboard", "section_index": 0, "title": "introduction", "startline": 0, "endline": 4, "content": "c", "bucket": 0,
    }
    assert got["subsection1"]["section_index"] == 1 and got["subsection1"]["content"] == ""
    assert runs.ingest_directory(spark, str(folder), s, "B", "metadata:title", "/b.pdf").sections_changed == 0


def test_defaults_of_a_stage(spark, tmp_path):
    storage.save_stage(spark.createDataFrame([("c", None), ("d", True)], "concept string, noisy boolean"), str(tmp_path), "prerequisites", "book")
    got = storage.load_stage(spark, str(tmp_path), "prerequisites", "book", "concept string, noisy boolean, count int", {"noisy": False, "count": 0})
    assert sorted(map(tuple, got.collect())) == [("c", False, 0), ("d", True, 0)]


def test_checkpoint_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())
