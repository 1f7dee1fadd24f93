"""WARC archives with revisits, and a sequential reader (operator 8).

Archives are bytes in rows (archive, data): each ``data`` is one complete
.warc.gz file, a gzip member per record. Spark writes and commits them, so a
lost executor leaves no half-written archive; ``export`` puts them as files,
and the reader takes any DataFrame with a binary column, such as that of
``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import base64
import hashlib
import pathlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, schema, table, text_or_empty

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(key) -> str:
    return f"<urn:x-page:{'' if key is None else quote(str(key))}>"


def record(key, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """One record. A revisit names the response and keeps the payload's length and digest, but not the payload."""
    block = HTTP if revisit else HTTP + payload
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else _urn(key)[1:-1]
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(key), "WARC-Date": date, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    """An archive that is cut short, framed wrongly or fails a digest."""


def read(chunks: Iterable[bytes], at_once: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, in order.

    Decompresses ``at_once`` bytes at a time and holds one record. Every member
    has to hold exactly one record: header, Content-Length bytes of block, two
    line ends. Lengths and digests are checked as bytes come in, so a member
    that is longer than its record says is given up at its first byte too many.
    """
    z, one = None, None
    for chunk in chunks:
        while chunk:
            if z is None:
                z, one = zlib.decompressobj(31), _Record()
            try:
                one.add(z.decompress(chunk, at_once))
            except zlib.error as e:
                raise Damaged(str(e)) from e
            chunk = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                yield one.done()
                z = None
    # What a bounded call has kept back comes out once the input has ended.
    while z is not None and not z.eof and (more := z.decompress(z.unconsumed_tail, at_once)):
        one.add(more)
    if z is not None:
        if not z.eof:
            raise Damaged("the last member is cut short")
        yield one.done()


class _Record:
    """A record while its bytes come in: header, then block, then its end."""

    def __init__(self):
        self.held, self.head, self.size, self.sum = bytearray(), None, 0, hashlib.sha1()

    def add(self, data: bytes) -> None:
        self.held += data
        if self.head is None:
            if not b"WARC/".startswith(self.held[:5]):
                raise Damaged("no WARC header")
            cut = self.held.find(END)
            if cut < 0:
                return
            self.head = _header(self.held[:cut])
            length = self.head.get("content-length", "")
            if not length.isdecimal():
                raise Damaged("no length")
            self.size = int(length)
            del self.held[: cut + 4]
            data = self.held
        before = len(self.held) - len(data)
        self.sum.update(memoryview(data)[: max(0, self.size - before)])
        if len(self.held) > self.size and not END.startswith(self.held[self.size :]):
            raise Damaged("the member is longer than its record")

    def done(self) -> tuple[dict[str, str], bytes]:
        if self.head is None or self.held[self.size :] != END:
            raise Damaged("the member isn't one record of the length stated")
        want = self.head.get("warc-block-digest")
        if want and want != f"sha1:{base64.b32encode(self.sum.digest()).decode()}":
            raise Damaged("block digest")
        return self.head, bytes(self.held[: self.size])


def _header(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def payload_of(head: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and digest of a record's full payload, verified where the record has it."""
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        return int(head["x-payload-length"]), said
    payload = block[block.find(END) + 4 :]
    if digest(payload) != said:
        raise Damaged("payload digest")
    return len(payload), said


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = 8 << 20, key: str = "page_id", url: str = "url", html: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Rows (archive, data). Of equal payloads of ``least`` bytes or more the largest key is the response.

    Null keys count as smallest; rows that share the largest key of a payload
    are all responses. A null page is an empty payload.
    """
    body = text_or_empty(html).cast("binary")
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u") if url in pages.columns else F.lit(None).cast("string").alias("u"), body.alias("b"), F.unhex(F.sha1(body)).alias("d"))
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    # Only payloads that come more than once are looked up; copies are counted before the shuffle. The counts are
    # written before they are joined: so the pages of a hot payload can be split among tasks.
    first = rows.where(F.octet_length("b") >= least).groupBy("d").agg(F.max("k").alias("to"), F.count("*").alias("n")).where("n > 1").select("d", "to")
    first = scratch.keep(first, "repeated")
    marked = rows.join(first, "d", "left").select("k", "u", "b", "to", F.expr("to is not null and not (k <=> to)").alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{made:04d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

        for b in batches:
            for k, u, payload, to, again in zip(*(c.to_pylist() for c in b.columns)):
                held.append(member(record(k, u, payload, to, again)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    archives = marked.mapInArrow(run, schema("archive string, data binary"))
    return scratch.keep(archives, "archives")


def read_archives(archives: DataFrame, data: str = "data", key_type: str = "long") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda urn: (urn or "").removeprefix("<urn:x-page:").removesuffix(">") or None
        for b in batches:
            for whole in b.column(0):
                view = whole.as_buffer()
                rows = []
                for head, block in read(view.slice(k, min(1 << 16, view.size - k)).to_pybytes() for k in range(0, view.size, 1 << 16)):
                    rows.append((of(head["warc-record-id"]), *payload_of(head, block), head["warc-type"], of(head.get("warc-refers-to"))))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = archives.select(data).mapInArrow(run, schema("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"))
    return out.withColumns({"page_id": F.col("page_id").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def export(archives: DataFrame, folder: str) -> int:
    """Put archives as .warc.gz files into a folder that all executors can write, such as a mounted one; returns their number.

    Each task writes its own archives, under other names until they are whole, so a task that runs again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = pathlib.Path(folder, f".{name}.{uuid.uuid4().hex}")
                part.write_bytes(data.as_buffer())
                part.replace(pathlib.Path(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return archives.select("archive", "data").mapInArrow(run, schema("n long")).agg(F.sum("n")).first()[0] or 0


def op8_sequential_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


_HEX = "strpos('0123456789abcdef', substr(h || '0', {at}, 1)) - 1"
_A, _B = _HEX.format(at="(5 * i) // 4 + 1"), _HEX.format(at="(5 * i) // 4 + 2")
ORACLE_SQL = {
    "op8_sequential_reader": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((((({_A}) * 16 + ({_B})) >> (3 - (5 * i) % 4)) & 31)) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN m USING (h)"""
}
QUERIES = {"op8_sequential_reader": op8_sequential_reader}
