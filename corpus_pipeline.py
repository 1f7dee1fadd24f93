"""The training-data operators as one pipeline over documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontamination, language_id, minhash, packing, suffixes
from folium.llm.common import Scratch, table, temporary

#: Percent of shared shingles of five words from which documents are near duplicates.
SIMILARITY = 80
#: A passage of over 50 words has more bytes than this, unless its words are shorter than four letters on average.
REPEAT_BYTES = 256


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null, empty, without a letter) go. An empty table gives no rows."""
    model = language_id.train(docs.where(language_id.fold() != 0))
    return language_id.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Null, empty and blank texts are duplicates of nothing, so all of them stay;
    of rows that are equal in all one stays. An empty table gives no rows.
    """
    return minhash.one_of_each(docs, least=SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES bytes that stand at two places or more go from every text; n_chars is counted anew. Documents stay.

    Null and shorter texts stay as they are; an empty table gives no rows.
    """
    out = suffixes.without_repeats(docs, width=REPEAT_BYTES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go. Null and empty texts stay, and all documents do if there is no item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. A null or empty text is its end id alone; an empty table gives no rows."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage made on its way goes when it is written, what it returned when the next one is."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
