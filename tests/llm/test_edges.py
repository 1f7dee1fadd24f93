"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names: for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import decontamination, embeddings, language_id, licenses, minhash, packing, registry, sharding, suffixes, token_counts, warc

CLASHES = ("k", "t", "n", "h", "c", "g", "d", "s", "a", "b", "p", "keys", "x", "task", "shard", "size", "slot", "label", "start", "score_", "_size", "_old", "ranges", "component_id", "kept", "item", "first", "text_sha256")
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
ROWS = [
    (1, "A plain text that stands alone here.", "en", "s1", 36), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \t\r\n", "de", "s1", 4), (5, "same words stand in both of these rows", "en", "s2", 38),
    (5, "same words stand in both of these rows", "en", "s2", 38), (6, "same words stand in both of these rows", "en", None, 38), (None, "a text without a key", "fr", "s1", 20), (None, None, None, None, None), (None, "a text without a key", "fr", "s1", 20),
    (7, LONG, "en", "s1", len(LONG)), (8, LONG, "en", "s1", len(LONG)), (9, "x" * 5000, "en", "s1", 5000), (10, "漢字 émoji 😀 \x00 \x85", "zh", "s1", 15), (11, "<|endoftext|>", "en", "s1", 13),
]
BENCH = [(1, "same words stand in both of these rows"), (2, None), (None, "a text without a key"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHES)).repartition(3, "doc_id", "text").persist()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").withColumn("k", F.lit(1))


def per_row(docs):
    """Operators that give a row for every row."""
    model = language_id.train(docs)
    return {
        "licenses": licenses.scan_licenses(docs), "token_counts": token_counts.token_counts(docs, token_counts.vocabulary_path()), "suffixes": suffixes.suffix_dedup(docs),
        "sharding": sharding.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)), 4), "language_id": language_id.identify(docs, model), "minhash": minhash.near_duplicates(docs),
    }


def test_a_row_for_every_row(docs):
    for name, df in per_row(docs).items():
        rows = df.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS), name


def test_defined_results(docs):
    got = {n: {r.doc_id: r.asDict() for r in df.where("doc_id is not null").collect()} for n, df in per_row(docs).items()}
    assert [got["minhash"][k]["component_id"] for k in range(1, 12)] == [1, 2, 3, 4, 5, 5, 7, 7, 9, 10, 11]
    assert [got["minhash"][k]["n_shingles"] for k in (2, 3, 4)] == [0, 0, 0]
    assert [got["token_counts"][k]["n_tokens"] for k in (2, 3, 11)] == [0, 0, 1]
    assert [got["suffixes"][k]["n_removed"] for k in (1, 2, 5, 7, 8, 9)] == [0, 0, 0, len(LONG), len(LONG), 5000]
    assert [got["language_id"][k]["lang_pred"] for k in (2, 3, 4)] == ["und"] * 3
    assert [got["licenses"][k]["n_words"] for k in (2, 3, 4)] == [0, 0, 0]
    assert len({(r["shard"], r["slot"]) for r in got["sharding"].values()}) == 11


def test_packing_covers_all(docs):
    rows = packing.pack_documents(docs, packing.vocabulary_path()).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert sum(r.length for r in rows if r.doc_id is None) == 1 + 2 * rows_tokens(rows, None)
    assert [r.length for r in rows if r.doc_id == 2] == [1]


def rows_tokens(rows, key):
    return max(r.doc_tokens for r in rows if r.doc_id == key)


def test_decontamination(docs, bench):
    rows = decontamination.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in rows) == [("5", "1"), ("5", "1"), ("6", "1"), ("None", "None"), ("None", "None")]
    assert decontamination.clean(docs, bench).columns == docs.columns


def test_warc(spark):
    rows = [(1, None, None), (None, "u", "p"), (None, "u", "p"), (2, "u", "p"), (3, "", LONG), (3, "u", "q"), (3, "u", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k", F.lit("clash"))
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", 0, "response", "None"), ("None", 1, "revisit", "2"), ("None", 1, "revisit", "2"), ("2", 1, "response", "None"), ("3", len(LONG), "response", "None"), ("3", 1, "response", "None"), ("3", 1, "response", "None")]
    )


def test_embeddings(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, None), (3, [1.0, 0.0], None), (3, [0.0, 1.0], 2), (4, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("k", "l", "x", "h", "c", "n")})
    got = sorted(str(tuple(r)) for r in embeddings.near_vectors(df).collect())
    assert got == sorted(map(str, [(None, 1, 1, False), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False)]))


def test_stages(spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, docs, str(tmp_path))
        assert own.columns == docs.columns and own.count() > 0, name
        assert own.where("k = 'clash k' and text_sha256 = 'clash text_sha256'").count() == own.count()
        kept = stage(spark, kept, str(tmp_path))
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    none = "/root/testdata/sf0.001"
    for name in ("documents", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{none}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
