"""Language mixtures: held-out accuracy, mixtures of two languages, texts that can't be told."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from folium.llm import language_id as li


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return li.train(docs.where(li.fold() != 0))


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()}
    rows = li.op6_mixture_inference(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in d.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and d.lang:
            total, right = total + 1, right + (r.lang_pred == d.lang)
    assert right / total > 0.95


def test_mixtures(spark, sf, model):
    by = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").select("lang", "text").collect():
        by.setdefault(r.lang, r.text)
    langs = sorted(by)[:2]
    both = by[langs[0]][:400] + " " + by[langs[1]][:400]
    got = dict(model.infer(both))
    assert {*langs} <= {*got} and abs(sum(got.values()) - 1) < 1e-6 and all(0.3 < got[x] < 0.7 for x in langs)


def test_untold(model):
    assert [model.infer(t) for t in (None, "", "123 !? \n", "²³ _")] == [[]] * 4
    assert len(model.infer("x")) >= 1
    assert model.infer("the " * 100_000)


def test_no_teachers(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    empty = li.train(df)
    assert empty.langs == []
    assert [r.lang_pred for r in li.identify(df, empty).collect()] == ["und"] * 3
    assert {r.doc_id for r in li.accepted(df, empty).collect()} == {1}


def test_many_languages(spark):
    df = spark.createDataFrame([(f"text of {chr(97 + i)} kind", f"l{i}") for i in range(9)], "text string, lang string")
    with pytest.raises(ValueError):
        li.train(df, numbers=8 << 8)
    few = li.train(df, numbers=9 << 8)
    assert len(few.langs) == 9 and few.prob.shape == (9, 256) and few.infer("text of c kind")
    assert [li.bits_for(n) for n in (0, 1, 512, 513, 1024, 65536, 65537)] == [15, 15, 15, 14, 14, 8, 8]


def mixture(p, c, rounds):
    """Plain expectation-maximisation over single n-grams: shares and log-likelihood."""
    share = [1 / len(p)] * len(p)
    for _ in range(rounds):
        new = [0.0] * len(p)
        for g, n in c.items():
            whole = sum(s * q[g] for s, q in zip(share, p))
            for k, q in enumerate(p):
                new[k] += n * share[k] * q[g] / whole
        share = [x / sum(c.values()) for x in new]
    return share, sum(n * math.log(sum(s * q[g] for s, q in zip(share, p))) for g, n in c.items())


def best_set(model, text):
    """The language set with the best penalised likelihood of all sets, with its shares."""
    c = Counter(li.grams(text, model.bits).tolist())
    best = None
    for size in range(1, len(model.langs) + 1):
        for some in itertools.combinations(range(len(model.langs)), size):
            share, like = mixture([model.prob[k] for k in some], c, model.rounds)
            score = 2 * like - model.penalty * math.log(sum(c.values())) * (size - 1)
            if best is None or score > best[0] + 1e-9:
                best = (score, {model.langs[k]: s for k, s in zip(some, share)})
    return best[1]


def test_counts_are_those_of_all_texts(spark, sf, model):
    """The model against n-grams counted text by text."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text]
    for k, lang in enumerate(model.langs):
        count = np.full(1 << model.bits, 0.5)
        for d in docs:
            if d.lang == lang:
                for g in li.grams(d.text, model.bits).tolist():
                    count[g] += 1
        assert np.allclose(model.prob[k], count / count.sum())


def test_against_all_language_sets(spark, sf, model):
    by = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 300").select("lang", "text").collect():
        by.setdefault(r.lang, []).append(r.text[:260])
    texts = [t for some in by.values() for t in some[:3]]
    texts += [a[0] + " " + b[0] for a, b in itertools.combinations(by.values(), 2)]
    for text in texts:
        got, want = dict(model.infer(text)), best_set(model, text)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
