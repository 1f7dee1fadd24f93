"""Archives: what is written is what is read, and damage is found."""

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import warc


def test_query(spark, tmp_path):
    pages = [(1, "u", "same"), (2, None, "same"), (5, "http://x/ä b", "same"), (3, "v", None), (4, "w", ""), (6, "x", "é\r\n\r\nWARC/1.1\r\n"), (7, "y", "z" * 300_000)]
    spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, k string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op8_sequential_reader(spark, str(tmp_path)).collect()}
    last = {h or "": max(k for k, _, x in pages if (x or "") == (h or "")) for _, _, h in pages}
    for k, _, h in pages:
        raw, top = (h or "").encode(), last[h or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if k == top else "revisit", None if k == top else top)
        assert got[k] == want
    assert len(got) == len(pages)


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "p" * k) for k in range(50)], "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, archive_bytes=2000)
    assert warc.export(archives, str(tmp_path)) > 3
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r.page_id for r in warc.read_archives(files, "content").collect()) == list(range(50))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=200), st.integers(0, 5000).map(lambda n: b"a" * n)), max_size=6), st.integers(1, 97), st.integers(1, 300))
def test_reader_in_any_chunks(payloads, size, at_once):
    whole = b"".join(warc.member(warc.record(k, f"http://x/{k}", p)) for k, p in enumerate(payloads))
    got = list(warc.read((whole[i : i + size] for i in range(0, len(whole), size)), at_once))
    assert [warc.payload_of(*r) for r in got] == [(len(p), warc.digest(p)) for p in payloads]


def test_damage_is_found():
    good = warc.record(1, "u", b"payload")
    for bad in (warc.member(good)[:-5], warc.member(good + b"x"), warc.member(good[:-4]), warc.member(good.replace(b"payload\r", b"paylord\r")), warc.member(b"none"), b"no gzip at all"):
        with pytest.raises(warc.Damaged):
            list(warc.read([bad]))


def test_a_member_that_is_too_long_is_given_up_early():
    """Its lengths are checked as it is read, not once it is whole."""
    bomb, read = warc.member(warc.record(1, "u", b"p") + b"x" * 50_000_000), 0

    def chunks():
        nonlocal read
        for i in range(0, len(bomb), 100):
            read += 1
            yield bomb[i : i + 100]

    with pytest.raises(warc.Damaged):
        list(warc.read(chunks()))
    assert read < 0.1 * len(bomb) / 100


def test_a_hot_payload(spark, tmp_path):
    """Nine of ten pages have one payload."""
    rows = [(k, "u", "hot" if k % 10 else f"page {k}") for k in range(2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op8_sequential_reader(spark, str(tmp_path)).collect()}
    assert got == {k: ("revisit", 1999) if k % 10 and k < 1999 else ("response", None) for k, _, _ in rows}
