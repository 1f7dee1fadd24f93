"""Benchmark decontamination by embedding edit distance (operator 9).

Texts are sequences of words. A benchmark item stands in a document if some run
of the document's words is within ``floor((1 - similarity) * n)`` word edits of
the item's n words. Candidates come from windows of the item's size at every
word of every document: the CGK random walk maps a window to a longer string
(each step writes the word at the pointer and moves on by a random bit of step
and word), on which few edits are few Hamming differences, and each of several
repetitions samples some steps of a walk of its own as a hash key. Windows that
lack the words which any item of a size class needs are passed over (this loses
nothing). Candidates are verified exactly with a bit-parallel edit distance.

The walks diverge with the square of the edits, so an item of more than
``piece`` words is looked up by pieces of equal size: of m pieces, one has at
most an m-th of the item's edits. Whole items are verified.

Items are taken in blocks of a bounded number of pieces, each against all documents; a block is one scan of them.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, grouped, held, schema, table, text_or_empty

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: ASCII in lower case, runs of letters, digits and all that isn't ASCII."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def best_match(item: list, text: list) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to a run of ``text``, and the end of the first such run."""
    n = len(item)
    place: dict = defaultdict(int)
    for k, w in enumerate(item):
        place[w] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(text, 1):
        eq = place.get(w, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best:
            best, end = score, k
    return best, end


def cuts_of(n: int, piece: int) -> int:
    """Into how many pieces an item of n words is cut."""
    return max(1, -(-n // piece))


class Walks:
    """The tables of a block of items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], similarity: float, repetitions: int, samples: int, seed: int = 7, ratio: float = 1.15, piece: int = 30):
        rng = np.random.default_rng(seed)
        self.items = [(key, words) for key, words in items if words]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in self.items]
        self.coded = coded
        self.edits = [math.floor((1 - similarity) * len(c) + 1e-9) for c in coded]
        self.other = len(self.ids)  # any word that no item has
        self.bits = rng.integers(0, 1 << 64, (repetitions, self.other + 1), np.uint64)
        # Pieces: item, place in it, words, edits that one of the item's pieces doesn't exceed.
        self.pieces = []
        for k, c in enumerate(coded):
            m = cuts_of(len(c), piece)
            at = [len(c) * x // m for x in range(m + 1)]
            self.pieces += [(k, a, c[a:b], self.edits[k] // m) for a, b in zip(at, at[1:])]
        size = [len(c) for _, _, c, _ in self.pieces]
        order = sorted(range(len(size)), key=size.__getitem__)
        self.classes = []
        while order:
            low = size[order[0]]
            mine = [x for x in order if size[x] <= max(low, int(low * ratio))]
            order = order[len(mine) :]
            high, most = size[mine[-1]], max(self.pieces[x][3] for x in mine)
            known = np.zeros(self.other + 1, bool)
            for x in mine:
                known[self.pieces[x][2]] = True
            need = min(size[x] - self.pieces[x][3] for x in mine)
            span = max(1, int(1.6 * low))
            tables = []
            for r in range(repetitions):
                steps = np.sort(rng.choice(span, min(samples, span), replace=False))
                tables.append((r, steps.tolist(), self._index(mine, r, steps.tolist(), high)))
            self.classes.append((known, need, high + most, tables))

    def _index(self, mine: list[int], r: int, steps: list[int], high: int) -> tuple[list[np.ndarray], dict[int, list[int]]]:
        """Prefix keys that some piece has after each sampled step, and pieces by whole key."""
        pad = np.full((len(mine), high + 2 + len(steps) + max(steps)), self.other, np.int64)
        for row, x in enumerate(mine):
            pad[row, : len(self.pieces[x][2])] = self.pieces[x][2]
        flat = pad.ravel()
        prefixes: list[np.ndarray] = []
        keys, _ = self._walk(flat, np.arange(len(mine)) * pad.shape[1], r, steps, prefixes, None)
        found: dict[int, list[int]] = defaultdict(list)
        for x, key in zip(mine, keys.tolist()):
            found[key].append(x)
        return prefixes, dict(found)

    def _walk(self, text: np.ndarray, start: np.ndarray, r: int, steps: list[int], grow: list | None, keep: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows from ``start``. With ``keep``, windows leave as soon as no item has their prefix."""
        at, key, left = start.copy(), np.zeros(len(start), np.uint64), np.arange(len(start))
        sampled, bits = set(steps), self.bits[r]
        for t in range(steps[-1] + 1):
            word = text[at]
            if t in sampled:
                key = (key ^ word.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
                if grow is not None:
                    grow.append(np.unique(key))
                if keep is not None:
                    some = keep[steps.index(t)]
                    good = some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key
                    at, key, left, word = at[good], key[good], left[good], word[good]
                    if not len(at):
                        break
            at = at + ((bits[word] >> np.uint64((t * 5 + 3) % 64)) & np.uint64(1)).astype(np.int64)
        return key, left

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) of the best match of each item in each text."""
        found = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if not self.items or not sizes.sum():
            return []
        get, begin = self.ids.get, np.concatenate(([0], np.cumsum(sizes)))
        tail = max(c[2] for c in self.classes) * 4 + 8
        text = np.full(int(begin[-1]) + tail, self.other, np.int64)
        for k, words in enumerate(found):
            text[begin[k] : begin[k + 1]] = np.fromiter(map(get, words, repeat(self.other)), np.int64, len(words))
        owner_of = lambda p: np.searchsorted(begin, p, side="right") - 1
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)  # where the whole item would begin
        total = int(begin[-1])
        for known, need, reach, tables in self.classes:
            sums = np.concatenate(([0], np.cumsum(known[text], dtype=np.int32)))
            dense = np.flatnonzero(sums[reach : total + reach] - sums[:total] >= need)
            if not len(dense):
                continue
            for r, steps, (prefixes, pieces) in tables:
                keys, left = self._walk(text, dense, r, steps, None, prefixes)
                for p, d, key in zip(dense[left].tolist(), owner_of(dense[left]).tolist(), keys.tolist()):
                    for x in pieces.get(key, ()):
                        item, at = self.pieces[x][:2]
                        pairs[d, item].append(p - at)
        out = []
        for (d, item), places in pairs.items():
            code, edits, low = self.coded[item], self.edits[item], int(begin[d])
            words, best = set(code), None
            for a, b in _merge(places, len(code) + edits + 1, edits + 1, low, int(begin[d + 1])):
                part = text[a:b].tolist()
                if sum(w in words for w in part) < len(code) - edits:
                    continue
                distance, end = best_match(code, part)
                if distance <= edits and (best is None or distance < best[0]):
                    _, back = best_match(code[::-1], part[:end][::-1])
                    best = (distance, a + end - back - low, back)
            if best:
                out.append((d, item, *best))
        return out


def _merge(places: list[int], after: int, before: int, low: int, high: int) -> list[tuple[int, int]]:
    """The stretches of a document around candidate starts, united where they overlap."""
    out: list[list[int]] = []
    for p in sorted(set(places)):
        a, b = max(low, p - before), min(high, p + after)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, size: int, piece: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of ``size`` pieces, or of one item that has more."""
    some, total = [], 0
    for key, text in items.toLocalIterator():  # one partition at a time
        words = words_of(text)
        cuts = cuts_of(len(words), piece)
        if some and total + cuts > size:
            yield some
            some, total = [], 0
        some.append((key, words))
        total += cuts
    if some:
        yield some


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, repetitions: int = 24, samples: int = 3, block: int = 16384, piece: int = 30,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` and item in it: key, item_id, edits, item_words, similarity, first_word, words.

    Null or empty texts and items match nothing; rows and items that repeat
    match each for itself. Empty tables give no rows. Of runs of words that are
    equally near an item the first one counts. The key keeps its name, so it
    can't be called like one of the results.
    """
    if key in ("item_id", "edits", "item_words", "similarity", "first_word", "words"):
        raise ValueError(f"a key can't be called {key}")
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    spec = f"k {kind}, item {item_kind}, edits long, item_words long, first_word long, words long"
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    found = [docs.sparkSession.createDataFrame([], schema(spec))]
    names = [f.split(" ")[0] for f in spec.split(", ")]
    for items in _blocks(benchmark.select(item_key, text_or_empty(item_text)), block, piece):
        sent = docs.sparkSession.sparkContext.broadcast(items)  # at most ``block`` pieces, or one item
        name = f"walks {uuid.uuid4().hex}"

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            walks = held(name, lambda: Walks(sent.value, similarity, repetitions, samples, piece=piece))
            for b in batches:
                hits, begin = [], 0
                for part in grouped(b.column(1).to_pylist(), 1 << 22):
                    hits += [(begin + d, *rest) for d, *rest in walks.find(part)]
                    begin += len(part)
                if hits:
                    doc, item, edits, first, words = zip(*hits)
                    big = lambda x: pa.array(x, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(big(doc)), pa.array([walks.items[i][0] for i in item]), big(edits), big([len(walks.coded[i]) for i in item]), big(first), big(words)], names)

        found.append(rows.mapInArrow(run, schema(spec)))
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("k").alias(key), F.col("item").alias("item_id"), "edits", "item_words", (1 - F.col("edits") / F.col("item_words")).alias("similarity"), "first_word", "words")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, as they are, in which no benchmark item stands. Judged by text, so keys may be null or repeat."""
    marked = docs.withColumn("_folium_h", F.unhex(F.sha2(text_or_empty(text), 256)))
    hits = contaminated(marked, benchmark, key="_folium_h", text=text, **options)
    dirty = Scratch(docs.sparkSession, "decontamination").keep(hits.select("_folium_h").distinct(), "dirty")
    return marked.join(dirty, "_folium_h", "left_anti").select(*docs.columns)


def op9_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_edit_embedding": op9_edit_embedding}
ORACLE_SQL: dict[str, str] = {}
