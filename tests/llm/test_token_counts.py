"""Token counts against the tokenizers library."""

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folium.llm import token_counts as tc


@pytest.fixture(scope="module")
def both():
    path = tc.vocabulary_path()
    return tc.RankMerger(path), Tokenizer.from_file(path)


def count(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
@example("a<|endoftext|><|endoftext|> b")
@example("\x1c\x1d\x85\xa0 ​᠎ \t\n  x")
@example("I'll we'VE 's''s 12³½ ーー Ⅷ")
@example("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa \n\n  \n a")
def test_same_as_library(both, text):
    merger, tok = both
    assert merger.counts([text]) == [count(tok, text)]


def test_every_space_like_character(both):
    merger, tok = both
    for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]:
        for text in (f"a{chr(c)}b", f"a {chr(c)} b", f"a{chr(c)}{chr(c)}b", f"{chr(c)} "):
            assert merger.counts([text]) == [count(tok, text)], hex(c)


def test_query(spark, sf, both):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in tc.op2_token_counts(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        n = count(both[1], text)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(text.encode()), n, n > 512)
