"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.operators.storage import shared_folder

#: Characters with the Unicode property White_Space, for use inside a class.
WHITE = "\t-\r \x85\xa0  -     　"
#: Where white space begins: tokenizers' chunks and words never reach across.
EDGE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Arrow batches of written tables hold about so many bytes, or one row: 10,000 rows of long texts don't stand in memory at once.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: list = []


def held(name: str, make):
    """A worker's large table, such as a vocabulary with what was looked up: made once, kept until another is asked for.

    Workers are used again by later stages, so what was held goes back to the
    system before the next is made.
    """
    if not _HELD or _HELD[0] != name:
        if _HELD:
            _HELD[:] = ()
            release()
        _HELD[:] = (name, make())
    return _HELD[1]


def release() -> None:
    """Gives memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def grouped(texts: list[str], chars: int = 1 << 21, most: int = 2048) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters together, or one text that has more."""
    some, total = [], 0
    for t in texts:
        if some and (total + len(t) > chars or len(some) >= most):
            yield some
            some, total = [], 0
        some.append(t)
        total += len(t)
    if some:
        yield some


def slices(text: str, chars: int = 1 << 21) -> Iterator[str]:
    """A text in parts of at least ``chars`` characters (but for the last), each cut where white space begins."""
    at = 0
    while len(text) - at > chars:
        edge = EDGE.search(text, at + chars)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


_SCOPES: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary():
    """Deletes, at its end, the scratch tables that were made inside it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.clear()


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``keep`` writes and rereads; ``drop`` deletes what later steps no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folium-{label}-{uuid.uuid4().hex}"
        if _SCOPES:
            _SCOPES[-1].append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf, limit = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(limit, None)
        conf.set(limit, BATCH_BYTES)
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            conf.unset(limit) if before is None else conf.set(limit, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Deletes all its tables."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)
