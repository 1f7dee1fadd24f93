"""Books as files: PDF through a pluggable backend, and text files.

No PDF library comes with this package. A backend is any object with
``open(bytes)`` that gives a book, or None if it can't be opened; it is made
once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as X

METADATA = ("info:Title", "title", "Title")


class Book(Protocol):
    def page_count(self) -> int: ...
    def metadata(self, key: str) -> str: ...
    def outline(self) -> Iterable[tuple[int, str | None, int]]:
        """(depth, title, page from 0) in reading order."""
        ...

    def page_text(self, page: int) -> str: ...


class Backend(Protocol):
    def open(self, data: bytes) -> Book | None: ...


def book_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of files. Spark passes over files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def _each(files: DataFrame, make: Callable[[], Backend], spec: str, rows: Callable[[str, Book | None], Iterator[tuple]], kinds: list[pa.DataType]) -> DataFrame:
    names = [f.split(" ")[0] for f in spec.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                try:
                    book = backend.open(data.as_py())
                except Exception:  # noqa: BLE001 - a book that can't be opened is a row of its own
                    book = None
                if found := list(rows(path.as_py(), book)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    return files.select("path", "content").mapInArrow(run, spec)


def scan_metadata(files: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """(book, ok, pages, info_title, title_lc, title_uc), a row per file; one that can't be opened isn't ok."""

    def rows(path: str, book: Book | None) -> Iterator[tuple]:
        def told(key: str) -> str:
            try:
                return book.metadata(key) or ""
            except Exception:  # noqa: BLE001 - metadata that fails counts as none
                return ""

        yield (path, False, 0, "", "", "") if book is None else (path, True, book.page_count(), *map(told, METADATA))

    return _each(files, make, "book string, ok boolean, pages int, info_title string, title_lc string, title_uc string", rows, [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string()])


def scan_outline(files: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """outline(book, pos, depth, title, page_index) of all entries."""

    def rows(path: str, book: Book | None) -> Iterator[tuple]:
        for pos, (depth, title, page) in enumerate(book.outline() if book else ()):
            yield path, pos, depth, title, page

    return _each(files, make, "book string, pos int, depth int, title string, page_index int", rows, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()])


def scan_pages(files: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """pages(book, page_index, text); a page that fails has a null text, and bytes that aren't UTF-8 are replaced."""

    def rows(path: str, book: Book | None) -> Iterator[tuple]:
        for page in range(book.page_count() if book else 0):
            try:
                text = book.page_text(page)
                text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
            except Exception:  # noqa: BLE001 - the other pages go on
                text = None
            yield path, page, text

    return _each(files, make, "book string, page_index int, text string", rows, [pa.string(), pa.int32(), pa.string()])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path that Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def list_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, length) of the files of a folder, sorted by file; a folder that is missing has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, length long")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "length").orderBy("file")


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text) of text files, whole; none if the folder is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, text string")
    read = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def contents_lines(spark: SparkSession, path: str, book: str) -> DataFrame:
    """toc_lines(book, line_no, line) of a file with a table of contents: its lines, trimmed, empty ones included. A missing file has none."""
    lines = text_files(spark, path, "*").select(F.posexplode(X.lines("text")).alias("line_no", "line"))
    return lines.select(F.lit(book).alias("book"), "line_no", X.trim("line").alias("line"))


def chapter_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sections, skipped): items of JSON arrays by file and place, and the files that hold none, or something after it."""
    item = "array<struct<content string, endline int, startline int, title string>>"
    # The parser stops where a value ends. Inside an array and inside an object there has to be nothing but that value.
    alone = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<{item}>")
    field = F.from_json(F.concat(F.lit('{"items": '), "text", F.lit("}")), f"items {item}")
    read = text_files(spark, path, "*.json").withColumns({"items": F.get(alone, 0), "n": F.size(alone), "field": field["items"]})
    good = F.col("items").isNotNull() & (F.col("n") == 1) & F.col("field").isNotNull() & F.ltrim("text").startswith("[")
    sections = read.where(good).select(F.col("file").alias("chapter_file"), F.posexplode("items").alias("section_index", "x"))
    blank = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0)).alias(c)
    return sections.select("chapter_file", "section_index", blank("title"), zero("startline"), zero("endline"), blank("content")), read.where(~good).select(F.col("file").alias("chapter_file"))
