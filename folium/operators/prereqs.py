"""Prerequisites of concepts in two passes, the second with context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import answers, provider
from folium.functions import text as X
from folium.operators.concepts import KEYS, ask, frequency

SHAPE = "noisy boolean, prerequisites array<string>"
CONTEXT_CHARS = 2000


def _shape(answer: object, row: dict) -> dict:
    noisy, found = answers.prerequisites_of(answer, row["concept"])
    return {"noisy": noisy, "prerequisites": found}


def _prompt(template: str):
    return F.replace(F.replace(F.lit(template), F.lit("{book}"), F.col("book_title")), F.lit("{chapter}"), F.col("chapter"))


def _asked(rows: DataFrame, make: Callable[[], provider.Provider]) -> DataFrame:
    return ask(rows, make, _shape, SHAPE).withColumnRenamed("request", "concept")


def first_pass(canon: DataFrame, counts: DataFrame, make: Callable[[], provider.Provider] = provider.Offline) -> DataFrame:
    """(concept, noisy, prerequisites, error). A concept that came more than once isn't noisy; a failed request gives an empty record."""
    known = frequency(canon, counts, "canon")
    system = F.when(F.col("count") > 1, F.lit(provider.BASICS)).otherwise(_prompt(provider.JUDGE))
    asked = known.select(F.col("canon").alias("request"), F.col("canon").alias("concept"), system.alias("system"), F.concat(F.lit("CONCEPT: "), F.col("canon")).alias("user"))
    got = _asked(asked, make).join(known.select(F.col("canon").alias("concept"), "count"), "concept")
    noisy = F.when(F.col("count") > 1, F.lit(False)).otherwise(F.coalesce("noisy", F.lit(False)))
    return got.select("concept", noisy.alias("noisy"), F.coalesce("prerequisites", F.array().cast("array<string>")).alias("prerequisites"), "error")


def contexts(noisy: DataFrame, canon: DataFrame, sections: DataFrame) -> DataFrame:
    """(concept, book_title, chapter, context) of noisy concepts: the first 2000 characters of where each stands first, if there are any."""
    placed = noisy.select("concept").join(canon.select(F.col("canon").alias("concept"), *KEYS), "concept")
    text = F.left(X.strip(F.coalesce("content", F.lit(""))), F.lit(CONTEXT_CHARS)).alias("context")
    return placed.join(sections.select(*KEYS, text), KEYS).where("context <> ''").select("concept", "book_title", "chapter", "context")


def second_pass(noisy: DataFrame, canon: DataFrame, sections: DataFrame, make: Callable[[], provider.Provider] = provider.Offline) -> DataFrame:
    """(concept, noisy, prerequisites, error) of the noisy concepts that have a context."""
    user = F.concat(F.lit("CONCEPT: "), F.col("concept"), F.lit("\n\nCONTEXT:\n"), F.col("context"))
    return _asked(contexts(noisy, canon, sections).select(F.col("concept").alias("request"), "concept", _prompt(provider.JUDGE_IN_CONTEXT).alias("system"), user.alias("user")), make)


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """(concept, noisy, prerequisites, rechecked): answers of the second pass replace those of the first; failed ones don't."""
    better = second.where("error is null").select("concept", F.struct("noisy", "prerequisites").alias("b"))
    both = first.join(better, "concept", "left")
    pick = lambda c: F.when(F.col("b").isNotNull(), F.col("b")[c]).otherwise(F.col(c)).alias(c)
    return both.select("concept", pick("noisy"), pick("prerequisites"), F.coalesce(~F.col("b")["noisy"], F.lit(False)).alias("rechecked"))


def assess(canon: DataFrame, counts: DataFrame, sections: DataFrame, make: Callable[[], provider.Provider] = provider.Offline) -> tuple[DataFrame, DataFrame]:
    """(records, metrics) of both passes. metrics, a row: concepts, errors, noisy (in the end), rechecked (no longer noisy)."""
    first = first_pass(canon, counts, make)
    second = second_pass(first.where("noisy"), canon, sections, make)
    records = combine(first, second)
    errors = first.select("error").unionByName(second.select("error")).agg(F.count("error").alias("errors"))
    totals = records.agg(F.count("*").alias("concepts"), F.count_if("noisy").alias("noisy"), F.count_if("rechecked").alias("rechecked"))
    return records, totals.join(F.broadcast(errors)).select("concepts", "errors", "noisy", "rechecked")  # a row each
