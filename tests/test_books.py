"""Chapters, tables of contents, sections and sources against hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from folium.operators import chapters, runs, segment, toc
from folium.sources import books


def test_page_ranges(spark):
    outline = spark.createDataFrame([("b", 0, 0, " Intro ", 0), ("b", 1, 0, "A", 5), ("b", 2, 0, "B", 5), ("b", 3, 0, "C", 9), ("b", 4, 1, "deep", 6), ("b", 5, 0, None, 7), ("b", 6, 0, "off", -1)], "book string, pos int, depth int, title string, page_index int")
    totals = spark.createDataFrame([("b", 12)], "book string, pages int")
    got = [tuple(r)[2:] for r in chapters.page_ranges(chapters.outline_entries(outline), totals).orderBy("chapter_no").collect()]
    assert got == [("Intro", 1, 5, 5), ("A", 6, 6, 1), ("B", 6, 9, 4), ("C", 10, 12, 3)]
    assert chapters.outline_entries(outline, top_only=False).count() == 5


def test_chapter_texts(spark):
    c = spark.createDataFrame([("b", 1, "One!", 1, 2, 2), ("b", 100, "Two", 2, 3, 2), ("b", 3, "None", 9, 9, 1)], "book string, chapter_no int, title string, page_start int, page_end int, page_count int")
    p = spark.createDataFrame([("b", 0, "p0"), ("b", 1, "p1"), ("b", 2, None)], "book string, page_index int, text string")
    got = {r.chapter_no: (r.file, r.text) for r in chapters.with_text(c, p).collect()}
    assert got == {1: ("01_One_.txt", "p0\np1\n"), 100: ("100_Two.txt", "p1\n"), 3: ("03_None.txt", "")}


LINES = ["contents", "", "1introduction1", "whyread2", "abouttheauthor3", "x4", "y5", "2theobserver9", "subject10", "12", "z13", "q14", "3adapters20"]


@pytest.mark.parametrize(
    "keys, want, cut",
    [(["introduction", "theobserver", "adapters"], [2, 7, 12], [(2, 7), (7, 12)]), (["introduction", "missing", "adapters"], [2, -1, 12], []), (["thesubject"], [8], []), ([""], [0], [])],
)
def test_toc(spark, keys, want, cut):
    assert toc.find_in_order(LINES, keys) == want
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(LINES)], "book string, line_no int, line string")
    names = spark.createDataFrame([("b", f"{i}.txt", k) for i, k in enumerate(keys)], "book string, file string, key string")
    placed = toc.positions(names, lines)
    assert [r.pos for r in placed.orderBy("file").collect()] == want
    assert [(r.start, r.end) for r in toc.slices(placed).orderBy("file").collect()] == cut
    kept = toc.slice_lines(toc.slices(placed), lines).orderBy("file").collect()
    if cut:
        assert kept[1].lines == ["2theobserver9", "subject10", "z13", "q14"]


def test_slices_left_empty_stay(spark):
    lines = spark.createDataFrame([("b", i, "12" if i else "first") for i in range(6)] + [("b", 6, "second")], "book string, line_no int, line string")
    cut = spark.createDataFrame([("b", "f", 1, 6)], "book string, file string, start int, end int")
    assert toc.slice_lines(cut, lines).first().lines == []


MATCHES = [([(4, 0), (6, 1), (12, 2)], 20, [(0, 3, "introduction"), (4, 11, "subsection1"), (12, 19, "subsection2")]), ([(0, 0), (0, 1), (5, 2)], 8, [(0, 4, "subsection1"), (5, 7, "subsection2")]), ([], 20, [(0, 19, "introduction")]), ([], 0, [(0, -1, "introduction")])]


@pytest.mark.parametrize("matches, total, want", MATCHES)
def test_sections(spark, matches, total, want):
    df = spark.createDataFrame([(matches, ["x"] * total)], "m array<struct<line int, toc int>>, l array<string>")
    df = df.withColumn("b", segment.bounds(segment.pick_starts(F.col("m")), F.size("l"))).select(segment.rows(F.col("b"), F.col("l")).alias("r"))
    got = df.first().r
    assert [(r.startline, r.endline, r.title) for r in got] == want
    assert [r.content for r in got] == ["\n".join("x" * max(0, b - a + 1)) for a, b, _ in want]


def test_minimum_gap(spark):
    df = spark.createDataFrame([([(x, 0) for x in (3, 5, 9, 10, 14, 40)],)], "m array<struct<line int, toc int>>")
    assert [s.line for s in df.select(segment.pick_starts(F.col("m")).alias("s")).first().s] == [3, 9, 14, 40]


def test_segment_a_chapter(spark):
    text = "\n".join(["preface", "", "The  Observer defined", *"abcd", "call foo()", "Adapters here", "end"])
    df = spark.createDataFrame([(1, "x y z", ["The Observer defined", "call foo()", "Adapters here", "not there"], text)], "id int, title string, toc_lines array<string>, text string")
    got = [tuple(r) for r in segment.explode_sections(segment.segment(df), "id").collect()]
    assert got == [(1, 0, "introduction", 0, 1, "preface"), (1, 1, "subsection1", 2, 7, "The  Observer defined\na\nb\nc\nd\ncall foo()"), (1, 2, "subsection2", 8, 9, "Adapters here\nend")]


class FakeBook:
    def __init__(self, data):
        self.pages = data.decode().split("|")

    def page_count(self):
        return len(self.pages)

    def metadata(self, key):
        if key == "Title":
            raise ValueError
        return "T" if key == "title" else ""

    def outline(self):
        return [(0, "One", 0), (1, None, 1)]

    def page_text(self, page):
        if self.pages[page] == "bad":
            raise ValueError
        return self.pages[page].encode() + b"\xff"


class FakeBackend:
    def open(self, data):
        if data == b"broken":
            raise ValueError
        return FakeBook(data)


def test_book_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"p|bad")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    files = books.book_files(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in books.scan_metadata(files, FakeBackend).orderBy("book").collect()] == [(True, 2, "", "T", ""), (False, 0, "", "", "")]
    assert [tuple(r)[1:] for r in books.scan_outline(files, FakeBackend).orderBy("pos").collect()] == [(0, 0, "One", 0), (1, 1, None, 1)]
    assert [tuple(r)[1:] for r in books.scan_pages(files, FakeBackend).orderBy("page_index").collect()] == [(0, "p�"), (1, None)]


def test_json_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"title": "t", "startline": 1},\n  {"content": "c", "endline": 2}\n]\n')
    (tmp_path / "b.json").write_text('{"title": "t"}')
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "none.json").write_text("[]")
    found, skipped = books.chapter_json(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in found.orderBy("section_index").collect()] == [(0, "t", 1, 0, ""), (1, "", 0, 2, "c")]
    assert sorted(r.chapter_file.rsplit("/", 1)[1] for r in skipped.collect()) == ["b.json", "blank.json"]
    assert books.text_files(spark, str(tmp_path), "*.json").count() == 4


@pytest.mark.parametrize("after", [" ", "\n\n", "x", " 5", "]", "}", ", []", ", 1", ', "b": 1', "], [1", '}, {"items": []', "] x", "[]"])
def test_nothing_follows_an_array(spark, tmp_path, after):
    (tmp_path / "a.json").write_text('[{"title": "t", "startline": 1, "endline": 2, "content": "c"}]' + after)
    found, skipped = books.chapter_json(spark, str(tmp_path))
    assert (found.count(), skipped.count()) == ((1, 0) if not after.strip() else (0, 1))


def test_folders(spark, tmp_path):
    for name in ("b.txt", "a.txt", "10.txt", "9.txt", "c.json"):
        (tmp_path / name).write_text(f" {name} \n\nlast")
    assert [r.file.rsplit("/", 1)[1] for r in books.list_files(spark, str(tmp_path)).collect()] == ["10.txt", "9.txt", "a.txt", "b.txt"]
    assert books.list_files(spark, str(tmp_path / "none")).count() == 0 and books.text_files(spark, str(tmp_path / "none")).count() == 0
    assert [tuple(r) for r in books.contents_lines(spark, str(tmp_path / "a.txt"), "B").orderBy("line_no").collect()] == [("B", 0, "a.txt"), ("B", 1, ""), ("B", 2, "last")]
    assert books.contents_lines(spark, str(tmp_path / "none.txt"), "B").count() == 0


def test_catalog_is_sorted(spark):
    files = spark.createDataFrame([("b", f) for f in ("11_B.txt", "100_C.txt", "02_A.txt", "01_Table_of_Contents.txt", "x.pdf")] + [("a", "09_Z.txt")], "book string, file string").repartition(3)
    assert [(r.book, r.file) for r in toc.catalog(files).collect()] == [("a", "09_Z.txt"), ("b", "02_A.txt"), ("b", "100_C.txt"), ("b", "11_B.txt")]


def test_outline_view(spark):
    outline = spark.createDataFrame([("b", 0, "Intro", 0), ("b", 1, "A", 5), ("b", 2, "B", 5), ("b", 3, "C", 9)], "book string, pos int, title string, page_index int")
    got = [r.line for r in chapters.outline_view(outline, spark.createDataFrame([("b", 12)], "book string, pages int")).orderBy("pos").collect()]
    assert got == ["'Intro': pages 1-5 (5 pages)", "'A': pages 6-6 (1 pages)", "'B': pages 6-9 (4 pages)", "'C': pages 10-12 (3 pages)"]


def test_run_book(spark, tmp_path):
    outline = spark.createDataFrame([("b", 0, 0, "Start", 0), ("b", 1, 0, "End", 1), ("b", 2, 0, "Index", 2)], "book string, pos int, depth int, title string, page_index int")
    totals = spark.createDataFrame([("b", 3), ("none", 9)], "book string, pages int")
    pages = spark.createDataFrame([("b", 0, "Start\nwords\nThe Alpha part\n1\n2\n3\n4\nBeta part\nlast"), ("b", 1, "End"), ("b", 2, "Index")], "book string, page_index int, text string")
    contents = ["start", "The Alpha part", "12", "Beta part", "", "more", "end", "a", "b", "c", "d", "index"]
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(contents)], "book string, line_no int, line string")
    texts = runs.extract_chapters(outline, totals, pages)
    cut = runs.slice_contents(texts, lines)
    assert [(r.file, r.start, r.end, r.lines) for r in cut.orderBy("file").collect()] == [("01_Start.txt", 0, 6, ["start", "The Alpha part", "Beta part", "more"]), ("02_End.txt", 6, 11, ["end", "a", "b"])]
    got = [(r.file, r.section_index, r.name, r.startline, r.endline) for r in runs.run_book(outline, totals, pages, lines).orderBy("file", "section_index").collect()]
    assert got == [("01_Start.txt", 0, "introduction", 0, 1), ("01_Start.txt", 1, "subsection1", 2, 6), ("01_Start.txt", 2, "subsection2", 7, 8), ("02_End.txt", 0, "introduction", 0, 0)]
    assert [r.file for r in runs.with_slices(texts.select("book", "file"), cut, "left_anti").collect()] == ["03_Index.txt"]
    assert runs.run_book(outline.limit(0), totals, pages, lines).count() == 0
    assert toc.write_slices(cut, str(tmp_path / "slices")) == 2


def test_last_lines_and_positions_of_many_keys(spark):
    """Against a search of every line; keys of all lengths, cut out of lines, with and without a match."""
    import random

    from folium.operators.substrings import last_lines

    r = random.Random(5)
    lines = [(b, i, "".join(r.choice("abthe1") for _ in range(r.choice((0, 1, 5, 40, 200))))) for b in ("x", "y", None) for i in range(150)]
    keys = {(b, "") for b in ("x", "none")}
    for n in (*range(1, 20), 31, 32, 33, 63, 64, 65, 150):
        for _ in range(6):
            b, _, s = r.choice([x for x in lines if len(x[2]) >= n])
            at = r.randrange(len(s) - n + 1)
            keys |= {(b, s[at : at + n]), (b, s[at : at + n - 1] + "z"), (b, "the" + s[at : at + n])}
    want = {(b, k): max(hits) for b, k in keys if (hits := [i for c, i, s in lines if c == b and s and k in s])}
    table = spark.createDataFrame(lines, "book string, no long, s string")
    got = last_lines(spark.createDataFrame(sorted(keys, key=str), "book string, s string"), table)
    assert {(x.book, x.s): x.last for x in got.collect()} == want
    files = [(b, f"{i:03d}.txt", k) for i, (b, k) in enumerate(sorted(keys, key=str))]
    placed = toc.positions(spark.createDataFrame([*files, ("x", "null.txt", None)], "book string, file string, key string"), table.select("book", table.no.alias("line_no"), table.s.alias("line")))
    found = {(x.book, x.file): x.pos for x in placed.collect()}
    for book in ("x", "y", None, "none"):
        mine = [(f, k) for b, f, k in files if b == book]
        assert [found[book, f] for f, _ in mine] == toc.find_in_order([s for b, _, s in lines if b == book], [k for _, k in mine])
    assert found["x", "null.txt"] == -1


def test_positions_do_not_search_for_missing_keys(spark):
    """20,000 keys that stand nowhere, over 20,000 lines: 400 million tests if each were searched for."""
    import time

    lines = spark.range(20000).selectExpr("'b' book", "cast(id as int) line_no", "concat('line ', id, ' words ', sha2(string(id), 512)) line")
    keys = spark.range(20000).selectExpr("'b' book", "format_string('%06d.txt', id) file", "if(id = 0, 'line777words', md5(concat(id, 'missing'))) key")
    begin = time.monotonic()
    got = toc.positions(keys, lines).where("pos >= 0").collect()
    assert [(x.file, x.pos) for x in got] == [("000000.txt", 777)]
    assert time.monotonic() - begin < 60
