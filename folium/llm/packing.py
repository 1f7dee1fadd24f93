"""Cost-balanced packing (operator 7).

Attention cost of a piece of n tokens is estimated as ``linear * n + quadratic
* n * n``. Every task tokenizes the documents it reads. Full stretches of a long
document are sequences by themselves; what remains is put, in descending order
of length, into the sequence with the lowest cost so far that has room for it,
and is cut over the roomiest sequences when none has. The task opens only as
many sequences as its tokens fill, so all of those end full; the few tokens
left over (less than one sequence per task) go through one small shuffle and
are packed again with those of ``group`` other tasks. Only a last sequence per
such group has padding.

Nothing is shuffled but these left-overs, so neither hot keys nor copies skew
the work, and a task holds just the ids of the documents' remainders.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import WHITE, Scratch, grouped, held, schema, slices, table, text_or_empty

WORD = re.compile(f"[^{WHITE}]+")
END_ID = 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Below U+0250 the normalizer is lower() alone, and the pre-tokenizer's classes are these.
LATIN = re.compile("[^\x00-\u024f]")
NUMBER = "\\d²³¹¼½¾"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W_{NUMBER}]+|[{NUMBER}]|(?:[^\\w\t-\r \x85\xa0]|_)+")


class WordIds:
    """Ids of texts.

    White space is dropped and pre-tokens are merged one by one, so equal pieces
    of text have equal ids wherever they stand. Pieces are the pre-tokens where
    a text has Latin letters only and no special string, else the words between
    white space.
    """

    def __init__(self, path: str, cache_entries: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        names = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[k for name, k in names.items() if name.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def cut(self, text: str) -> list[str]:
        if LATIN.search(text) or self.special and self.special.search(text):
            return WORD.findall(text)
        return PIECE.findall(text.lower())

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        if self.ends is not None and all(map(PIECE.fullmatch, pieces)):  # single pre-tokens: one call, cut after each word end
            ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(cuts) == len(pieces):
                raw, cuts = ids.tobytes(), cuts.tolist()
                return {w: raw[a:b] for w, a, b in zip(pieces, [0, *cuts], cuts)}
        code = "HI"[self.kind.itemsize == 4]
        return {w: struct.pack(f"<{len(e)}{code}", *e.ids) for w, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))}

    def _joined(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        cache = self.cache
        unseen = list(set(chain.from_iterable(cut)).difference(cache))
        for some in grouped(unseen, 1 << 14):
            cache.update(self._learn(some))
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """A text of many characters is cut into pieces part by part."""
        for some in grouped(texts):
            if len(some) == 1:
                raw = [b"".join(self._joined([part])[0] for part in slices(some[0]))]
            else:
                raw = self._joined(some)
            yield from (np.frombuffer(x, self.kind) for x in raw)


def word_ids(path: str) -> WordIds:
    return held(f"words {path}", lambda: WordIds(path))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def fill(lengths: np.ndarray, sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pack items given in descending order.

    Returns pieces (item, start, length, sequence, offset) and the parts
    (item, start, length) that found no room. While parts are left, every
    sequence is full.
    """
    room = np.full(sequences, capacity, np.int64)
    cost = np.zeros(sequences)
    pieces, rest = [], []

    def put(item: int, start: int, n: int, at: int) -> None:
        pieces.append((item, start, n, at, int(capacity - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    for item, n in enumerate(lengths.tolist()):
        start = 0
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                put(item, start, n, int(fits[np.argmin(cost[fits])]))
                break
            at = int(np.argmax(room)) if sequences else 0
            if not sequences or not room[at]:
                rest.append((item, start, n))
                break
            k = int(room[at])
            put(item, start, k, at)
            start, n = start + k, n - k
    return pieces, rest


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 1024, group: int = 256,
    end_id: int = END_ID, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed each for
    itself, also where their keys are null or equal; ties in length fall by key,
    then content. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[key].dataType.simpleString()
    spec = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, sequence long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tok = word_ids(path)
        names = [f.split(" ")[0] for f in spec.split(", ")]
        # A task's documents are packed in groups of bounded size.
        waiting, tokens, sequence = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tokens, sequence
            waiting.sort(key=lambda x: (-len(x[2]), str(x[0]), x[2].tobytes()))
            lengths = np.array([len(x[2]) for x in waiting], np.int64)
            count = int(lengths.sum()) // capacity
            pieces, rest = fill(lengths, count, capacity, linear, quadratic)
            rows = []
            for item, start, n, at, offset in pieces:
                k, before, ids, total = waiting[item]
                rows.append((k, before + start, n, crc(ids[start : start + n]), total, task, sequence + at, offset, None))
            for item, start, n in rest:
                k, before, ids, total = waiting[item]
                part = ids[start : start + n]
                rows.append((k, before + start, n, crc(part), total, task, None, None, part.astype("<u4").tobytes()))
            sequence += count
            waiting, tokens = [], 0
            yield from emit(rows)

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                out = schema_arrow
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], names)

        schema_arrow = None
        for b in batches:
            if schema_arrow is None:
                big = pa.int64()
                schema_arrow = pa.schema([("k", b.schema.field(0).type), *((n, big) for n in names[1:-1]), ("ids", pa.binary())])
            full = []
            for k, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist())):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                total, start = len(ids), 0
                while total - start >= capacity:
                    full.append((k, start, capacity, crc(ids[start : start + capacity]), total, task, sequence, 0, None))
                    sequence, start = sequence + 1, start + capacity
                if start < total:
                    waiting.append((k, start, ids[start:].copy(), total))
                    tokens += total - start
            yield from emit(full)
            if tokens > 1024 * capacity:
                yield from flush()
        if waiting:
            yield from flush()

    packed = scratch.keep(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(run, schema(spec)), "tasks")
    settled = packed.where("sequence is not null").select("k", "start", "length", "ids_crc32", "doc_tokens", F.concat_ws("-", F.lit("t"), "task", "sequence").alias("label"), "offset")

    def again(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "task", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = part["length"].to_numpy(np.int64)
        need = -(-int(lengths.sum()) // capacity)
        pieces, _ = fill(lengths, need, capacity, linear, quadratic)
        g = int(part["task"].iloc[0]) // group
        rows = []
        for item, start, n, at, offset in pieces:
            r = part.iloc[item]
            ids = np.frombuffer(r["ids"], "<u4")[start : start + n]
            rows.append((r["k"], int(r["start"]) + start, n, crc(ids), int(r["doc_tokens"]), f"g-{g}-{at}", offset))
        return pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "label", "offset"])

    loose = packed.where("sequence is null").groupBy(F.expr(f"task div {group}").alias("g"))
    rest = loose.applyInPandas(again, schema(f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, label string, offset long"))
    pieces = settled.unionByName(rest)
    # Two ranges of numbers: a task's sequences, and those of the left-overs.
    nth = F.element_at(F.split("label", "-"), 3).cast("long")
    owner = F.element_at(F.split("label", "-"), 2).cast("long")
    loose_id = F.when(F.col("label").startswith("g"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    sequence_id = (owner * F.lit(2) + loose_id) * F.lit(1 << 32) + nth
    return pieces.select(F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens", sequence_id.alias("sequence_id"), "offset")


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op7_cost_balanced_packing": op7_cost_balanced_packing}
ORACLE_SQL: dict[str, str] = {}
