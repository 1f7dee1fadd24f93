"""Concepts of sections: extraction through a provider, counts, canonical forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import answers, provider
from folium.operators.storage import written
from folium.operators.store import long_enough
from folium.schemas import as_struct

KEYS = ["book_title", "chapter", "section_index"]
#: Rows of a batch whose prompts and answers stand in a worker at once.
AT_ONCE = 64


def ask(rows: DataFrame, make: Callable[[], provider.Provider], shape: Callable[[object, dict], dict], columns: str) -> DataFrame:
    """A provider's answers to rows (request string, system, user): request, the shaped columns, and error.

    Each Python worker makes its provider once, and holds a batch of 4 MB and the
    answers to ``AT_ONCE`` rows, whatever the input. The result is a written
    table, so that no later recomputation asks again.
    """
    fields = as_struct(columns)
    spec = as_struct(f"request string, {columns}, error string")
    kinds = [pa.string(), *[_arrow(f.dataType.simpleString()) for f in fields], pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            out = []
            for row in b.to_pylist():
                try:
                    got, error = shape(model.generate(row["system"], row["user"]), row), None
                except (provider.Failed, ValueError, TypeError) as e:
                    got, error = {}, str(e)
                out.append((row["request"], *(got.get(f) for f in fields.names), error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], spec.names)

    return written(rows.select("request", "system", "user", *[c for c in ("concept",) if c in rows.columns]).mapInArrow(run, spec), "answers")


def _arrow(name: str) -> pa.DataType:
    return {"array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "string": pa.string()}[name]


def extract(sections: DataFrame, make: Callable[[], provider.Provider] = provider.Offline) -> tuple[DataFrame, DataFrame]:
    """(section_concepts, metrics) of sections (id, book_title, chapter, section_index, content) of 100 characters or more.

    section_concepts: id, book_title, chapter, section_index, pos, concept. A
    section whose request failed has no concepts and counts as an error.
    """
    eligible = sections.where(long_enough("content"))
    asked = eligible.select(F.col("id").cast("string").alias("request"), F.lit(provider.FIND_CONCEPTS).alias("system"), F.col("content").alias("user"))
    got = ask(asked, make, lambda answer, _: {"concepts": answers.concepts_of(answer)}, "concepts array<string>")
    keyed = eligible.select("id", *KEYS).join(got, F.col("id").cast("string") == F.col("request"))
    found = keyed.select("id", *KEYS, F.posexplode("concepts").alias("pos", "concept"))
    metrics = got.agg(F.count("*").alias("sections_parsed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return found, metrics


def counts(found: DataFrame) -> DataFrame:
    """(lower, count) over all sections."""
    return found.groupBy(F.lower("concept").alias("lower")).agg(F.count("*").alias("count"))


def frequency(names: DataFrame, counted: DataFrame, name: str = "concept") -> DataFrame:
    """``names`` with count: how often each stands in all sections, whatever its case; 0 where it doesn't."""
    by = counted.select(F.col("lower").alias("_folium_lower"), "count")
    return names.join(by, F.lower(name) == F.col("_folium_lower"), "left").drop("_folium_lower").withColumn("count", F.coalesce("count", F.lit(0)))


def surface_forms(found: DataFrame, order: str = "id") -> DataFrame:
    """(lower, concept): the form that was seen first, in the order in which sections were processed."""
    return found.groupBy(F.lower("concept").alias("lower")).agg(F.min_by("concept", F.struct(order, "pos")).alias("concept"))


def index(found: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(lower, canon, book_title, chapter, section_index, occurrences): the form and place that come first by key.

    ``allowed`` (lower): concepts to keep; an empty table keeps all.
    """
    some = found
    if allowed is not None and not allowed.isEmpty():
        some = found.join(allowed.select(F.col("lower").alias("_l")), F.lower("concept") == F.col("_l"), "left_semi")
    first = F.min(F.struct(*KEYS, "pos", "concept")).alias("f")
    return some.groupBy(F.lower("concept").alias("lower")).agg(first, F.count("*").alias("occurrences")).select("lower", F.col("f.concept").alias("canon"), *(f"f.{k}" for k in KEYS), "occurrences")


def occurrences(found: DataFrame, canon: DataFrame) -> DataFrame:
    """(canon, book_title, chapter, section_index, pos): where each concept stands, a row a place.

    Places stay rows: a concept may stand in a third of all sections, and a list of them would be one value.
    """
    return found.join(canon.select("lower", "canon"), F.lower("concept") == F.col("lower")).select("canon", *KEYS, "pos")
