"""Token counts by rank-synchronous array merging (operator 2).

A text is cut into chunks (a run of non-space characters with the one space
before it, or a run of white space); the byte-level pre-tokenizer never looks
across such a cut, so equal chunks have equal counts and a worker keeps them in
a bounded table. Pre-tokens of unseen chunks are held together as one ragged
numpy array of symbols. In each round every sequence applies its own
lowest-rank pair, all sequences at once, until no pair of any sequence is in
the merge list; the symbols that survive are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import WHITE, grouped, held, schema, slices, table, text_or_empty

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NONE = np.int64(1) << 40


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, as byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankMerger:
    """Counts the tokens of many pre-tokens at once."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in _byte_alphabet().items():
            self.byte_id[byte] = vocab[char]
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        rank = np.arange(len(key), dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], rank[order], np.array(made, np.int64)
        # A merge is unsafe to apply at several places of a sequence at once if
        # its product takes part in a pair of lower rank.
        first = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(first, np.array(left), rank)
        np.minimum.at(first, np.array(right), rank)
        self.unsafe = first[self.made] < rank
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, int] = {}
        self.cache_entries = cache_entries

    def _ranks(self, sym: np.ndarray, same: np.ndarray) -> np.ndarray:
        key = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same, self.ranks[at], NONE)

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string when no pair can merge."""
        out = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if not len(out):
            return out
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), out)
        while len(sym) > 1:
            rank = np.append(self._ranks(sym, seq[:-1] == seq[1:]), NONE)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(seq)))
            ended = low == NONE
            out[seq[starts[ended]]] = lengths[ended]
            if ended.all():
                return out
            best = np.repeat(low, lengths)
            go = np.repeat(~ended, lengths)
            hit = (rank == best) & go
            at = np.flatnonzero(hit)
            new_run = np.append(True, np.diff(at) > 1)
            run = np.flatnonzero(new_run)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            take = nth % 2 == 0  # a pair of equal symbols overlaps itself: every second place, from the left
            odd = self.unsafe[rank[at]]
            if odd.any():
                take &= ~odd | np.append(True, seq[at[1:]] != seq[at[:-1]])
            at = at[take]
            sym[at] = self.made[rank[at]]
            go[at + 1] = False
            sym, seq = sym[go], seq[go]
        out[seq] = 1
        return out

    def _learn(self, chunks: list[str]) -> None:
        tokens: dict[str, int] = {}
        owners, refs = [], []
        for k, chunk in enumerate(chunks):
            for piece in self.split.findall(chunk):
                owners.append(k)
                refs.append(tokens.setdefault(piece, len(tokens)))
        each = self.survivors([t.encode("utf-8", "surrogatepass") for t in tokens])
        total = np.bincount(np.array(owners, np.int64), weights=each[refs], minlength=len(chunks)).astype(int)
        self.cache.update(zip(chunks, total.tolist()))

    def counts(self, texts: list[str], at_once: int = 50_000) -> list[int]:
        """Token counts of texts."""
        out = []
        for some in grouped(texts, 1 << 20):
            if len(some) == 1:  # maybe very long: part by part
                pieces = self._pieces(some[0])
                out.append(len(pieces) - 1 + sum(self._counted([[part]], at_once)[0] for p in pieces for part in slices(p, 1 << 20)))
            else:
                pieces = [self._pieces(t) for t in some]
                out += [len(p) - 1 + n for p, n in zip(pieces, self._counted(pieces, at_once))]
        return out

    def _pieces(self, text: str) -> list[str]:
        """A text without its special strings, each of which is one token."""
        return self.special.split(text) if self.special and self.special.search(text) else [text]

    def _counted(self, pieces: list[list[str]], at_once: int) -> list[int]:
        cut = [[c for p in mine for c in CHUNK.findall(p)] for mine in pieces]
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        cache = self.cache
        unseen = list({c for chunks in cut for c in chunks if c not in cache})
        for k in range(0, len(unseen), at_once):
            self._learn(unseen[k : k + at_once])
        return [sum(map(cache.__getitem__, chunks)) for chunks in cut]


def merger(path: str) -> RankMerger:
    return held(f"ranks {path}", lambda: RankMerger(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens; repeated rows and null keys
    come out as they went in. No shuffle: rows are counted where they are read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            n = pa.array(m.counts(b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["k", "n_bytes", "n_tokens"])

    whole = text_or_empty(text)
    rows = docs.select(F.col(key).alias("k"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("t"))
    counted = rows.mapInArrow(run, schema(f"k {kind}, n_bytes long, n_tokens long"))
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
