"""The section store: upsert by key, scans, checks, exports."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.schemas import SECTIONS, as_struct

KEY = ["book_title", "chapter", "title"]
MIN_CHARS = 100


class SectionStore(Protocol):
    def ensure_ready(self) -> None: ...
    def upsert(self, incoming: DataFrame) -> dict[str, int]: ...


def merge(existing: DataFrame, incoming: DataFrame, key: list[str] = KEY, order: str | None = None) -> DataFrame:
    """All keys; a row of ``incoming`` replaces that of ``existing``, the last by ``order`` if several share a key."""
    cols = [c for c in existing.columns if c not in key]
    new = incoming.select(*key, F.struct(*cols).alias("new"), (F.col(order) if order else F.lit(0)).alias("o"))
    new = new.groupBy(*key).agg(F.max_by("new", F.struct("o", "new")).alias("new"))
    both = existing.select(*key, F.struct(*cols).alias("old")).join(new, key, "full")
    row = F.coalesce("new", "old")
    return both.select(*key, *(row[c].alias(c) for c in cols)).select(*existing.columns)


def changed(existing: DataFrame, incoming: DataFrame, key: list[str] = KEY, order: str | None = None) -> DataFrame:
    """Keys of ``incoming`` that are new or differ in any other column, a row each time.

    With ``order``, rows that share a key are written one after the other: each
    is compared with the one before it, the first with what is there.
    """
    cols = [c for c in existing.columns if c not in key]
    old = existing.select(*key, F.struct(*cols).alias("old"), F.lit(True).alias("there"))
    new = incoming.select(*key, F.struct(*cols).alias("new"), *([F.col(order).alias("_order")] if order else []))
    if not order:
        both = new.join(old, key, "left")
        return both.where(F.col("there").isNull() | ~F.col("new").eqNullSafe(F.col("old"))).select(*key)
    before = F.lag("new").over(Window.partitionBy(*key).orderBy("_order"))  # as many rows as share a key
    both = new.withColumn("before", before).join(old, key, "left").withColumn("old", F.coalesce("before", "old"))
    return both.where(F.col("old").isNull() | ~F.col("new").eqNullSafe(F.col("old"))).select(*key)


def collisions(sections: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys that more than one row has, with their number: empty for a sound store."""
    return sections.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def latest(sections: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """Of rows that share a key, the one with the largest ``order``."""
    cols = [c for c in sections.columns if c not in key]
    return sections.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*key, *(F.col("r")[c].alias(c) for c in cols)).select(*sections.columns)


def long_enough(content, least: int = MIN_CHARS) -> Column:
    return F.length(F.coalesce(F.col(content), F.lit(""))) >= least


def _eligible(sections: DataFrame, book: str | None, least: int) -> DataFrame:
    some = sections.where(long_enough("content", least))
    return some.where(F.col("book_title") == book) if book is not None else some


def scan(sections: DataFrame, book: str | None = None, least: int = MIN_CHARS) -> DataFrame:
    """Sections of a book that are long enough, with defaults for nulls, sorted by id."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return _eligible(sections, book, least).orderBy("id").select(blank("id"), blank("book_title"), blank("chapter"), F.coalesce(F.col("section_index").cast("int"), F.lit(0)).alias("section_index"), blank("content"))


def count(sections: DataFrame, book: str | None = None, least: int = MIN_CHARS) -> DataFrame:
    """One row (n): how many sections ``scan`` gives, without sorting them."""
    return _eligible(sections, book, least).agg(F.count("*").alias("n"))


def ingest_totals(records: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """One row: sections_changed, sections_total, files."""
    total = records.agg(F.count("*").alias("sections_total"), F.count_distinct("chapter_file").alias("files"))
    return changed_keys.agg(F.count("*").alias("sections_changed")).join(F.broadcast(total))  # a row each


def records(segmented: DataFrame) -> DataFrame:
    """Stored sections from exploded ones that carry book, title_source, path, file and chapter columns; nulls get defaults."""
    have = {f.name for f in segmented.schema}
    out = []
    for f in as_struct(SECTIONS):
        default = F.lit(0) if f.dataType.simpleString() == "int" else F.lit("")
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in have else default.cast(f.dataType)).alias(f.name))
    return segmented.select(*out)


class ParquetStore:
    """Sections in Parquet, partitioned by a hash of the book so that an upsert rewrites only buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def ensure_ready(self) -> None:
        try:
            self.read()
        except Exception as e:  # noqa: BLE001 - only a table that isn't there yet is made
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            self._write(self.spark.createDataFrame([], as_struct(SECTIONS)))

    def read(self) -> DataFrame:
        return self.spark.read.schema(as_struct(f"{SECTIONS}, bucket int")).parquet(self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("book_title"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def upsert(self, incoming: DataFrame, order: str | None = None) -> dict[str, int]:
        """Counts of changed and of all incoming sections and of their files.

        Of rows that share a key the last one stays: by ``order``, or else by
        the file's name, the section's number and the place in ``incoming``.
        """
        from folium.operators.storage import written

        self.ensure_ready()
        names = as_struct(SECTIONS).names
        last = F.col(order) if order else F.struct("chapter_file", "section_index", F.monotonically_increasing_id())
        incoming = written(incoming.select(*names, last.alias("_order")), "incoming")
        touched = [r["b"] for r in incoming.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
        old = self.read().where(F.col("bucket").isin(touched)).select(*names)
        totals = ingest_totals(incoming, changed(old, incoming, order="_order")).first().asDict()
        self._write(written(merge(old, incoming, order="_order"), "merged"))
        return totals


def export_texts(chapters: DataFrame, path: str) -> int:
    """Chapter texts as text files, a folder for each file name; returns their number. A text without a line end at its end gets one."""
    out = chapters.select("book", "file", F.regexp_replace("text", r"\n\z", "").alias("value"))
    out.write.partitionBy("book", "file").mode("overwrite").text(path)
    return out.count()


def export_json(segmented: DataFrame, path: str) -> None:
    """The sections of each chapter (book, chapter, sections) as an indented JSON array in a text file, a folder for each chapter."""
    out = segmented.select("book", "chapter", F.to_json("sections", {"pretty": "true"}).alias("value"))
    out.write.partitionBy("book", "chapter").mode("overwrite").text(path)
