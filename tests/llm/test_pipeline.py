"""The pipeline against the same steps in plain Python."""

from test_minhash import components, shingles
from test_packing import verify
from tokenizers import Tokenizer

import corpus_pipeline
from folium.llm import decontamination as dc
from folium.llm import packing, suffixes


def left_of(texts: list[bytes], width: int = 400) -> list[str]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert suffixes.WIDTH == 400


def test_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(k, t) for k, t in docs if any(c.isalpha() for c in t or "")]
    comp = components([shingles(t) for _, t in docs], corpus_pipeline.SIMILARITY)
    docs = [d for i, d in enumerate(docs) if comp[i] == i]
    docs = list(zip((k for k, _ in docs), left_of([t.encode() for _, t in docs], corpus_pipeline.REPEAT_BYTES)))
    items = [dc.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stands = lambda t: any(dc.best_match(i, dc.words_of(t))[0] <= int(0.2 * len(i) + 1e-9) for i in items)
    before = len(docs)
    docs = {k: t for k, t in docs if not stands(t)}
    assert len(docs) < before
    rows = corpus_pipeline.run(spark, sf).collect()
    verify(rows, docs, Tokenizer.from_file(packing.vocabulary_path()))


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
