"""Packing: every id in exactly one piece, sequences filled."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folium.llm import packing


@pytest.fixture(scope="module")
def both():
    path = packing.vocabulary_path()
    return packing.WordIds(path), Tokenizer.from_file(path)


def ids_of(tok, text):
    return np.append(np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
@example("İstanbul ſ K <|endoftext|>x <|startoftext|>")
@example("it's WE'LL 12³½ a_b ª º µ \x85\xa0 naïve Ǆ")
@example("漢字かな עברית é")
def test_same_ids_as_library(both, text):
    mine, tok = both
    assert next(mine.ids([text])).tolist() == tok.encode(text, add_special_tokens=False).ids


def verify(rows, docs, tok, capacity=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for k, text in docs.items():
        ids, at = ids_of(tok, text), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows), len(sequences)


def test_query(spark, sf, both):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    total, sequences = verify(packing.op7_cost_balanced_packing(spark, sf).collect(), docs, both[1])
    assert sequences == -(-total // 4096)


@pytest.mark.parametrize("parts", [1, 7])
def test_parts(spark, both, parts):
    docs = {k: "word and other words " * (k * 37 % 400) for k in range(60)} | {60: "", 61: None, 62: "x " * 20000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)
    rows = packing.pack_documents(df, packing.vocabulary_path(), capacity=512, group=3).collect()
    total, sequences = verify(rows, docs, both[1], 512)
    assert sequences <= -(-total // 512) + -(-parts // 3)


def test_fill_balances_costs():
    lengths = np.array([50, 40, 30, 30, 20, 20, 10], np.int64)
    pieces, rest = packing.fill(lengths, 2, 100, 1.0, 1 / 100)
    assert not rest
    sums = [sum(n for _, _, n, at, _ in pieces if at == s) for s in (0, 1)]
    costs = [sum(n + n * n / 100 for _, _, n, at, _ in pieces if at == s) for s in (0, 1)]
    assert sums == [100, 100] and abs(costs[0] - costs[1]) < 20
