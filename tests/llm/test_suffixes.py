"""Suffix-array deduplication against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folium.llm import suffixes


def brute(texts: list[bytes], width: int) -> list[tuple[int, int, str]]:
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(seed: int, alphabet: str) -> list[str]:
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [some(rng.randrange(60, 200)) for _ in range(4)]
    texts = [some(rng.randrange(0, 300)) for _ in range(20)]
    for _ in range(25):
        part = rng.choice(shared)
        a = rng.randrange(0, 30)
        texts.append(some(rng.randrange(80)) + part[a:] + some(rng.randrange(80)) + (part if rng.random() < 0.2 else ""))
    return [*texts, texts[0], texts[25], "", "a" * 500, "ab" * 150]


@pytest.mark.parametrize("seed, alphabet, options", [(1, "abcd", {}), (2, "aé\n漢", {}), (3, "ab", {"shard_bytes": 4096}), (4, "abcdefgh ", {"most": 1}), (5, "ab", {"most": 2}), (6, "aé\n漢", {"most": 4, "shard_bytes": 4096})])
def test_brute_force(spark, seed, alphabet, options):
    texts = corpus(seed, alphabet)
    want = brute([t.encode() for t in texts], 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(df, width=60, **options).collect()}
    assert got == dict(enumerate(want))


def test_suffix_array():
    rng = np.random.default_rng(1)
    for size, symbols in ((50, 3), (400, 2), (400, 200), (300, 1)):
        text = np.append(rng.integers(1, 1 + symbols, size), 0)
        order = suffixes.suffix_array(text, 400)
        rest = [tuple(text[i:]) for i in order]
        # Ordered by 400 symbols at least; the one zero ends every comparison.
        assert rest == sorted(rest)
        assert sorted(order.tolist()) == list(range(len(text)))


def test_query_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(d.text or "").encode() for d in docs], 400)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op4_two_stage_suffix_sort(spark, sf).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, want)}
    assert any(w[0] for w in want)


@pytest.mark.parametrize("chunk", [37, 100])
def test_texts_longer_than_a_chunk(spark, monkeypatch, chunk):
    """Segments end where a chunk of a text does, at other places in every text; what repeats across the border is found."""
    texts = corpus(7, "ab")
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    cut = [suffixes.segments(t.encode(), 60) for t in texts]
    monkeypatch.undo()
    whole = [suffixes.segments(t.encode(), 60) for t in texts]
    windows = lambda got: [i for a, n in zip(got[2].tolist(), got[3].tolist()) for i in range(a, a + n)]
    assert [windows(g) for g in cut] == [windows(g) for g in whole] and any(len(a[0]) > len(b[0]) for a, b in zip(cut, whole))


def test_beyond_a_chunk(spark):
    """A passage across the end of the first chunk stands in a short text too."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij ", k=suffixes.CHUNK + 3000))
    at = suffixes.CHUNK - 250
    texts = [long, "".join(rng.choices("xyz", k=70)) + long[at : at + 900]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.suffix_dedup(df).collect()}
    assert got == {0: (900, 1), 1: (900, 1)}


def test_hot_copies(spark):
    """Nine of ten rows are copies of one text, in every task."""
    rng = random.Random(9)
    hot = "".join(rng.choices("abcdefgh ", k=150))
    texts = [hot] * 900 + ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(90)] + ["z" * 9 + hot[:80]] * 10
    rng.shuffle(texts)
    want = brute([t.encode() for t in texts], 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(df, width=60).collect()}
    assert got == dict(enumerate(want))


def test_hot_anchor(spark):
    """One passage in unlike surroundings, longer and shorter than a window, in more texts than a shard may hold pieces of."""
    rng = random.Random(10)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    long, short, edge = some(75), some(58), "".join(rng.choices("xy", k=3))
    texts = [some(rng.randrange(70)) + rng.choice((long, short, edge[:k] + short)) + some(rng.randrange(70)) for _ in range(120) for k in (rng.randrange(4),)]
    want = brute([t.encode() for t in texts], 60)
    assert 20 < sum(w[0] > 0 for w in want)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (8, 1024):
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(df, width=60, most=most).collect()}
        assert got == dict(enumerate(want)), most


def test_cut_texts(spark):
    df = spark.createDataFrame([(1, "x" + "é" * 300, 5), (2, "é" * 300 + "y", 6), (3, None, 7), (3, "short", 8)], "doc_id long, text string, t int")
    got = sorted(suffixes.without_repeats(df, width=400).collect(), key=lambda r: r.t)
    assert [r.text for r in got] == ["x", "y", None, "short"]
    assert got[0].asDict().keys() == {"doc_id", "text", "t"}
