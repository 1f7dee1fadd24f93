"""Multilingual mixture inference (operator 6).

Training counts hashed character n-grams of every labelled training document by
language, in one pass: tasks add up packed counts, two rounds of sums over
bounded groups follow, and the model (languages x buckets) is what reaches the
driver. A document is then read as a mixture: expectation-maximisation gives
the proportions of the languages, in whose order nested language sets are tried
as long as twice the gain in log-likelihood exceeds ``penalty * log(n-grams)``
per language added.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import held, schema, table

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BLOCKS = 16  # blocks of buckets in which counts are summed
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(text: str, bits: int) -> np.ndarray:
    """Buckets of the 2- and 3-grams of a text, lower-cased, with each run of other characters than letters as one space. Empty if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[code]
    if not known.any():
        return np.zeros(0, np.int64)
    code = np.where(known, code, np.uint32(32))
    first = np.empty(len(code), bool)
    first[0] = True
    np.logical_or(known[1:], known[:-1], out=first[1:])
    code = np.concatenate(([np.uint32(32)], code[first], [np.uint32(32)])).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    key = np.concatenate((two, three))
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class Mixture:
    """Languages and the probability of each bucket in each of them."""

    langs: list[str]
    prob: np.ndarray
    bits: int
    penalty: float = 4.0
    rounds: int = 10

    def _em(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions, and the log-likelihood, of buckets with probabilities p (languages x buckets) and counts c."""
        share = np.full(len(p), 1 / len(p), np.float64)
        total = c.sum()
        for _ in range(self.rounds):
            mixed = share @ p
            share = share * (p @ (c / mixed)) / total
        return share, float(c @ np.log(share @ p))

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of a text with their proportions, the largest first; empty if there is nothing to tell from."""
        key = grams(text, self.bits) if text and self.langs and LETTER.search(text) else ()
        if not len(key):
            return []
        count = np.bincount(key, minlength=1 << self.bits)
        at = np.flatnonzero(count)
        c, p = count[at].astype(np.float64), self.prob[:, at]
        share, _ = self._em(p, c)
        order = np.argsort(-share, kind="stable")
        best = self._em(p[order[:1]], c)
        chosen = 1
        # The single language with the highest likelihood may not be the one with the largest share.
        single = int(np.argmax(np.log(p) @ c))
        if single != order[0]:
            order = np.concatenate(([single], order[order != single]))
            best = self._em(p[order[:1]], c)
        while chosen < len(order):
            more = self._em(p[order[: chosen + 1]], c)
            if 2 * (more[1] - best[1]) <= self.penalty * np.log(c.sum()):
                break
            best, chosen = more, chosen + 1
        got = sorted(zip((self.langs[k] for k in order[:chosen]), best[0].tolist()), key=lambda x: (-x[1], x[0]))
        return [(lang, min(1.0, max(0.0, x))) for lang, x in got]


def bits_for(langs: int, bits: int = 15, numbers: int = 1 << 24) -> int:
    """How many bits a bucket's number may have so that languages x buckets are at most ``numbers``; 8 at least."""
    return max(8, min(bits, (numbers // max(1, langs)).bit_length() - 1))


def train(docs: DataFrame, bits: int = 15, numbers: int = 1 << 24, text: str = "text", lang: str = "lang") -> Mixture:
    """The model of all given documents that have a language.

    Null languages and null texts teach nothing; with no teaching rows the
    model knows no language. The model has ``numbers`` numbers at most: from 513
    languages on there are fewer buckets, and over ``numbers`` / 256 languages
    are refused.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    many = rows.select("lang").distinct().count()
    bits = bits_for(many, bits, numbers)
    if many << bits > numbers:
        raise ValueError(f"{many} languages make a model of more than {numbers} numbers")
    n, step = 1 << bits, (1 << bits) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sums = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            rows = [(name, k, task, v[k * step : (k + 1) * step].tobytes()) for name, v in sums.items() for k in range(BLOCKS)]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["lang", "block", "task", "counts"])

        for b in batches:
            for name, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name not in sums:
                    if len(sums) >= 64:
                        yield out()
                        sums.clear()
                    sums[name] = np.zeros(n, np.int64)
                sums[name] += np.bincount(grams(whole, bits), minlength=n)
        if sums:
            yield out()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for x in part["counts"]:
            total += np.frombuffer(x, np.int64)
        return part.iloc[:1].assign(task=part["task"].iloc[0] // 512, counts=[total.tobytes()])

    spec = schema("lang string, block int, task long, counts binary")
    sums = rows.mapInArrow(run, spec)
    sums = sums.groupBy("lang", "block", F.expr("task div 512").alias("g")).applyInPandas(add, spec)
    sums = sums.groupBy("lang", "block").applyInPandas(add, spec)
    counts: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(n))[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    langs = sorted(k for k, v in counts.items() if v.sum() and k != UNKNOWN)
    if not langs:
        return Mixture([], np.zeros((0, n)), bits)
    prob = np.stack([counts[k] for k in langs]) + 0.5
    return Mixture(langs, prob / prob.sum(1, keepdims=True), bits)


def _inferred(docs: DataFrame, model: Mixture, text: str):
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of numbers: see train
    name = f"mixture {uuid.uuid4().hex}"

    @F.pandas_udf(schema("langs array<struct<lang string, share double>>, lang_pred string, score double"))
    def infer(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held(name, lambda: sent.value)
        for s in texts:
            got = [m.infer(t) for t in s]
            yield pd.DataFrame({"langs": [[{"lang": a, "share": x} for a, x in g] for g in got], "lang_pred": [g[0][0] if g else UNKNOWN for g in got], "score": [g[0][1] if g else 0.0 for g in got]})

    return infer(F.col(text).cast("string"))


def identify(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """The documents with langs (an array of structs: lang, share), lang_pred and score.

    No text, or one without a letter, is ``und`` with score 0 and no languages.
    Columns of these three names in ``docs`` are replaced.
    """
    docs = docs.drop("langs", "lang_pred", "score")
    out = docs.withColumn("_folium_lang", _inferred(docs, model, text))
    return out.select(*docs.columns, *(F.col("_folium_lang")[n].alias(n) for n in ("langs", "lang_pred", "score")))


def accepted(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """The documents, as they are, whose language could be told; ``und`` is rejected.

    Where the model knows no language, all that have a letter stay.
    """
    if not model.langs:
        return docs.where(F.col(text).cast("string").rlike(r"\p{L}"))
    return docs.withColumn("_folium_lang", _inferred(docs, model, text)["lang_pred"]).where(F.col("_folium_lang") != UNKNOWN).drop("_folium_lang")


def fold(key: str = "doc_id"):
    """The contract's fold of a row: crc32 of the key as text, mod 5. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def op6_mixture_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 0))
    out = identify(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.array_join(F.transform("langs", lambda x: x["lang"]), ",").alias("langs"))


QUERIES = {"op6_mixture_inference": op6_mixture_inference}
ORACLE_SQL: dict[str, str] = {}
