"""Suffix-array deduplication by two-stage sorting (operator 4).

What repeats is a string of ``width`` bytes that starts at two places or more.

1. Every window of ``width`` bytes has an anchor: of the short grams in it the
   one with the smallest hash, the leftmost of equals. Equal windows have equal
   anchors at equal distances, so a window can repeat only if its anchor's gram
   does. Consecutive windows with one anchor are a segment (about width / 2
   bytes on from the last). Texts are read once; anchors come as
   (gram hash, segment hash) and are counted, copies within a task first; as it
   only matters whether a segment comes once, a task passes over a third copy
   of a text.
2. Segments that occur more than once whole are covered. Those that share an
   anchor's gram with a different segment are contested, and only their bytes
   are looked at, one representative of each.
3. Contested segments are dealt by anchor to shards of bounded size. A shard's
   suffix array is made in two stages: suffixes smaller than their successors
   are sorted directly, the rest are induced by scans over the buckets of their
   first symbols; then common prefixes of neighbours say which windows repeat.
   An anchor with more different segments than a shard may hold is narrowed
   first: its windows are taken by their distance from the anchor, and only
   pieces with the same core, the bytes that all windows of a block of
   distances hold, go to one shard.
4. Covered ranges are united per distinct text, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, held, schema, table, text_or_empty

WIDTH, GRAM, BLOCK = 400, 32, 28
CHUNK = 1 << 21  # window starts looked at together; a place in a chunk has to fit 24 bits
SEEN = 1 << 17  # digests of texts that a task remembers
BLOCK_OF_DISTANCES = 32  # from its anchor, that windows are taken together by where an anchor is frequent


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the grams of 32 bytes at every place."""
    g = data.astype(np.uint64)
    for step in (1, 2, 4):
        g = g[:-step] | g[step:] << np.uint64(8 * step)
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + g[k : k + n])
    return h


def segments(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, segment hash, first window and number of windows of the segments of a text."""
    out: list[list] = [[], [], [], []]
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, max(0, len(data) - width + 1), CHUNK):
        part = whole[begin : begin + CHUNK + width - 1]
        h = gram_hashes(part)
        span = width - GRAM + 1
        windows = len(h) - span + 1
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        # Minima over sliding spans from running minima of blocks, forwards and backwards.
        full = np.full(-(-len(key) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        full[: len(key)] = key
        blocks = full.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, windows))
        raw = memoryview(data)[begin : begin + len(part)]
        out[0].append(h[anchor[first]])
        out[1].append(np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n + width - 1]) for a, n in zip(first.tolist(), count.tolist())), np.uint64, len(first)))
        out[2].append(first + begin)
        out[3].append(count)
    if not out[0]:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in out)


def block_names(text: np.ndarray) -> np.ndarray:
    """For each place an integer that orders the BLOCK symbols from there; beyond the end come zeros."""
    n = len(text)
    wide = np.zeros(n + BLOCK, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(7):  # 7 symbols of 9 bits
        key = key << 9 | wide[k : k + n]
    for step in (7, 14):
        name = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        key = name << 32
        key[: n - step] |= name[step:]
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_array(text: np.ndarray, depth: int = WIDTH, names: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (symbols 0 to 511, the last one 0) ordered by ``depth`` symbols at least.

    Stage one: type B, suffixes smaller than their successors, sorted directly
    by names of blocks; only ties are compared further. Stage two: type A, the
    rest, placed by scans: going through the buckets in order, each suffix puts
    its predecessor, if that is type A, next in the predecessor's bucket.
    """
    n = len(text)
    text = text.astype(np.int64)
    names = block_names(text) if names is None else names
    # The last symbol counts as smaller than what would follow; runs of equal symbols take the type of their end.
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(text[1:] - text[:-1])
    less[-1] = 1
    decided = np.where(less != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(decided[::-1])[::-1]
    is_b = less[ahead] > 0

    order = np.flatnonzero(is_b)
    group = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    reach = 0
    while len(tied) and reach < depth:
        at = order[tied] + reach
        key = np.where(at < n, names[np.minimum(at, n - 1)], 0)
        both = group[tied] << 32 | key  # ties of a group stand together
        sort = np.argsort(both, kind="stable")
        both = both[sort]
        order[tied] = order[tied[sort]]
        new = np.append(True, both[1:] != both[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        last = np.append(new[1:], True)
        tied = tied[~(new & last)]
        reach += BLOCK
    b_start = np.searchsorted(text[order], np.arange(513))

    sizes = np.bincount(text, minlength=512)
    start = np.concatenate(([0], np.cumsum(sizes)))
    filled = np.zeros(512, np.int64)
    out = np.empty(n, np.int64)
    for c in np.flatnonzero(sizes):
        low = start[c]
        # What smaller buckets put here, then what that puts here itself (runs of c), layer by layer.
        begin, end = 0, filled[c]
        while end > begin:
            before = out[low + begin : low + end] - 1
            before = before[before >= 0]
            more = before[(text[before] == c) & ~is_b[before]]
            out[low + end : low + end + len(more)] = more
            begin, end = end, end + len(more)
        direct = order[b_start[c] : b_start[c + 1]]
        out[low + end : low + end + len(direct)] = direct
        # Predecessors in larger buckets, in the order of this bucket.
        before = out[low : start[c + 1]] - 1
        before = before[before >= 0]
        before = before[text[before] > c]
        to = text[before]
        sort = np.argsort(to, kind="stable")
        before, to = before[sort], to[sort]
        which, first, count = np.unique(to, return_index=True, return_counts=True)
        for d, f, k in zip(which.tolist(), first.tolist(), count.tolist()):
            out[start[d] + filled[d] : start[d] + filled[d] + k] = before[f : f + k]
            filled[d] += k
    return out


def repeated_windows(parts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each byte string which of its windows stand at another place too, in it or in another one."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1)
    text = np.zeros(int(ends[-1]), np.uint16)
    text[np.delete(np.arange(len(text)), ends - 1)] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    left = np.repeat(ends - 1, lengths + 1) - np.arange(len(text))
    names = block_names(text)
    order = suffix_array(text, width, names)
    order = order[left[order] >= width]
    # Neighbours agree in ``width`` bytes if they do in the blocks from 0, 28, ... and in the last one.
    same = np.arange(len(order) - 1)
    for k in [*range(0, width - BLOCK, BLOCK), width - BLOCK]:
        same = same[names[order[same] + k] == names[order[same + 1] + k]]
    again = np.zeros(len(text), bool)
    again[order[same]] = again[order[same + 1]] = True
    return [again[e - 1 - n : e - 1 - n + max(0, n - width + 1)] for e, n in zip(ends.tolist(), lengths.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def covered_ranges(docs: DataFrame, width: int = WIDTH, shard_bytes: int = 1 << 20, most: int = 1024, text: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables (h, t) of the distinct texts that may hold repeats, and (h, ranges) of what is covered; h: SHA-256 of the text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    whole = text_or_empty(text)
    source = docs.select(F.unhex(F.sha2(whole, 256)).alias("h"), whole.cast("binary").alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("suffixes", lambda: None)  # makes room
        seen: dict[bytes, int] = {}
        for b in batches:
            rows, owners = [], []
            for k, (d, t) in enumerate(zip(b.column(0), b.column(1))):
                digest = d.as_py()
                times = seen[digest] = seen.get(digest, 0) + 1
                if len(seen) > SEEN:  # what is forgotten is only looked at again
                    seen.clear()
                if times > 2:
                    continue
                got = segments(t.as_py(), width)
                rows.append(got)
                owners.append(np.full(len(got[0]), k))
            if not rows:
                continue
            gram, seg, first, count = (np.concatenate(x) for x in zip(*rows))
            h = b.column(0).take(pa.array(np.concatenate(owners)))
            yield pa.RecordBatch.from_arrays([h, pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(first), pa.array(count)], ["h", "gram", "seg", "first", "n"])

    spec = schema("h binary, gram long, seg long, first long, n long")
    sketched = scratch.keep(source.where(F.octet_length("t") >= width).mapInArrow(sketch, spec), "sketch")
    # Counts by gram are written before they are joined: so a hot gram's rows can be split among tasks.
    twice = scratch.keep(sketched.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "twice")
    alive = scratch.keep(sketched.join(twice, "gram"), "alive")
    scratch.drop("sketch", "twice")
    each = scratch.keep(alive.groupBy("gram", "seg").agg(F.count("*").alias("times"), F.min("h").alias("rep")), "each")
    variety = scratch.keep(each.groupBy("gram").agg(F.count("*").alias("kinds")), "variety")
    kinds = scratch.keep(each.join(variety, "gram").where("times > 1 or kinds > 1"), "kinds")
    scratch.drop("each", "variety")
    judged = alive.join(kinds, ["gram", "seg"])
    whole_ones = judged.where("times > 1").select("h", F.col("first").alias("a"), (F.col("first") + F.col("n") + (width - 1)).alias("b")).distinct()
    whole_ones = scratch.keep(whole_ones, "whole")
    contested = judged.where("kinds > 1").where(F.col("h") == F.col("rep"))
    # A text may hold its own segment several times; one of them is the witness.
    contested = contested.groupBy("gram", "seg").agg(F.min(F.struct("h", "first", "n")).alias("x"), F.first("times").alias("times"), F.first("kinds").alias("kinds"))
    contested = scratch.keep(contested.select("gram", "x.h", "x.first", "x.n", "times", "kinds").withColumn("id", F.monotonically_increasing_id()), "contested")
    scratch.drop("alive", "kinds")

    touched = whole_ones.select("h").union(contested.select("h")).distinct()
    # One text of each digest, copies within a task first: so the copies of a hot text don't meet in one task.
    texts = scratch.keep(source.groupBy("h").agg(F.first("t").alias("t")).join(touched, "h", "left_semi"), "texts")

    wanted = contested.groupBy("h").agg(F.collect_list(F.struct("id", "gram", "first", "n", "times", "kinds")).alias("w"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for h, t, w in zip(b.column(0), b.column(1), b.column(2)):
                data = t.as_buffer()
                for x in w.as_py():
                    part = data.slice(x["first"], x["n"] + width - 1).to_pybytes()
                    for c, v in zip(cols, (h.as_py(), x["id"], x["gram"], x["first"], x["times"], x["kinds"], part)):
                        c.append(v)
            kinds_ = (pa.binary(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], ["h", "id", "gram", "first", "times", "kinds", "bytes"])

    fetched = texts.join(wanted, "h").select("h", "t", "w").mapInArrow(fetch, schema("h binary, id long, gram long, first long, times long, kinds long, bytes binary"))
    fetched = scratch.keep(fetched, "fetched")
    few = fetched.where(F.col("kinds") <= most).select("h", "first", "times", "bytes", F.col("gram").alias("key"))
    many = fetched.where(F.col("kinds") > most)
    if not many.isEmpty():
        more, pieces = _by_cores(many, width, most, scratch)
        whole_ones, few = whole_ones.unionByName(more), few.unionByName(pieces)
    total = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def by_suffixes(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, flags in enumerate(repeated_windows(list(part["bytes"]), width)):
            if part["times"].iloc[k] == 1 and flags.any():
                at = int(part["first"].iloc[k])
                rows += [(part["h"].iloc[k], at + a, at + b + width - 1) for a, b in _runs(flags)]
        return pd.DataFrame(rows, columns=["h", "a", "b"])

    dealt = few.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    from_suffixes = dealt.groupBy("shard").applyInPandas(by_suffixes, schema("h binary, a long, b long"))
    cover = scratch.keep(whole_ones.unionByName(from_suffixes), "cover")
    scratch.drop("fetched", "whole", "contested", "cores")
    return texts, cover.groupBy("h").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # as many as a text has segments


def _anchor(data: np.ndarray, width: int) -> int:
    """Where the anchor of a segment's windows stands in its bytes."""
    return int(np.argmin(gram_hashes(data[:width]) & ~np.uint64(0xFFFFFF)))


def _pieces(data: bytes, ranges: list[tuple[int, int]], size: int, width: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """A segment's windows whose distance from the anchor lies in one of the ranges, by blocks of ``size`` distances: first and last window, anchor, hashes of core and piece, range of each."""
    anchor = _anchor(np.frombuffer(data, np.uint8), width)
    for k, (low, high) in enumerate(ranges):
        low, high = max(low, anchor - (len(data) - width)), min(high, anchor)
        for block in range(low // size, high // size + 1) if low <= high else ():
            near = block * size
            a, b = anchor - min(high, near + size - 1), anchor - max(low, near)
            core = data[anchor - near : anchor - near - size + 1 + width]
            yield a, b, anchor, xxhash.xxh3_64_intdigest(core, near << 8 | size), xxhash.xxh3_64_intdigest(data[a : b + width]), k


def _by_cores(many: DataFrame, width: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Segments of anchors that too many have: what is covered (h, a, b), and contested pieces (h, first, times, bytes, key).

    Windows that are equal have equal distances from their anchor. All windows
    of a block of distances hold the same bytes around it, their core: pieces of
    different cores share none. A core that more than ``most`` different pieces
    have is cut again, by half the distances; in a block of one distance core,
    piece and window are the same.
    """
    spec = schema("id long, a int, b int, anchor int, core long, piece long, times long")

    def by(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, times, found = [], [], []
                for i, data, todo in zip(*(batch.column(k) for k in range(3))):
                    wanted = todo.as_py()
                    got = list(_pieces(data.as_py(), [(x["low"], x["high"]) for x in wanted], size, width))
                    ids += [i.as_py()] * len(got)
                    times += [wanted[g[5]]["times"] for g in got]
                    found += got
                if found:
                    *places, core, piece, _ = zip(*found)
                    hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (core, piece)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in places), *hashes, pa.array(times, pa.int64())], spec.names)

        return run

    todo = many.select("id", F.array(F.struct(F.lit(0).alias("low"), F.lit(width - GRAM).alias("high"), "times")).alias("todo"))
    covered, contested, size = [], [], BLOCK_OF_DISTANCES
    while True:
        here = f"cores/{size}"
        found = scratch.keep(many.select("id", "bytes").join(todo, "id").select("id", "bytes", "todo").mapInArrow(by(size), spec), f"{here}/found")
        each = scratch.keep(found.groupBy("core", "piece").agg(F.sum("times").alias("times"), F.min(F.struct("id", "a", "b", "anchor")).alias("x")), f"{here}/each")
        again = scratch.keep(each.where("times > 1").select("core", "piece"), f"{here}/again")
        covered.append(scratch.keep(found.where("times = 1").join(again, ["core", "piece"]).select("id", "a", "b"), f"{here}/covered"))
        variety = scratch.keep(each.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), f"{here}/variety")
        kinds = scratch.keep(each.join(variety, "core").select("core", "x.*", "times", "kinds"), f"{here}/kinds")
        scratch.drop(*(f"{here}/{name}" for name in ("found", "each", "again", "variety")))
        hot = kinds.where((F.col("kinds") > most) & F.lit(size > 1))
        contested.append(kinds.where((F.col("kinds") <= most) | F.lit(size == 1)))
        if hot.isEmpty():
            break
        ranges = F.struct((F.col("anchor") - F.col("b")).alias("low"), (F.col("anchor") - F.col("a")).alias("high"), "times")
        todo = hot.groupBy("id").agg(F.collect_list(ranges).alias("todo"))  # as many as a segment has distances
        size //= 2
    named = many.select("id", "h", "first")
    whole = reduce(DataFrame.unionByName, covered).join(named, "id").select("h", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + width).alias("b"))
    rows = reduce(DataFrame.unionByName, contested).join(many.select("id", "h", "first", "bytes"), "id")
    pieces = rows.select("h", (F.col("first") + F.col("a")).alias("first"), "times", F.expr(f"substring(bytes, a + 1, b - a + {width})").alias("bytes"), F.col("core").alias("key"))
    return whole, scratch.keep(pieces, "cores/pieces")


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the ranges, the bytes removed and the number of maximal runs removed."""
    kept, at, removed, spans = [], 0, 0, 0
    for a, b in sorted(ranges):
        if a > at or not spans:
            kept.append(data[at:a])
            spans, removed, at = spans + 1, removed + b - a, b
        elif b > at:
            removed, at = removed + b - at, b
    kept.append(data[at:])
    return b"".join(kept), removed, spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """One row per distinct text with something removed: h (its SHA-256), n_removed, n_spans, kept_sha256, and kept, the text that is left, if asked for. What a cut leaves of a character isn't in kept."""
    texts, ranges = covered_ranges(docs, width, text=text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cut(t.as_py(), [(x["a"], x["b"]) for x in r.as_py()]) for t, r in zip(b.column(1), b.column(2))]
            arrays = [b.column(0), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done]), pa.array([d[0].decode("utf-8", "ignore") if keep_text else None for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(ranges, "h").select("h", "t", "ranges").mapInArrow(run, schema("h binary, n_removed long, n_spans long, kept_sha256 string, kept string"))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row: key, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts shorter than ``width`` lose nothing; a row that
    repeats loses all if it is long enough, as each copy holds the other's
    strings. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    changed = scratch.keep(remove_repeats(docs, width, text, **options).drop("kept"), "changed")
    whole = text_or_empty(text)
    rows = docs.select(F.col(key), F.octet_length(whole).cast("long").alias("n_bytes"), F.unhex(F.sha2(whole, 256)).alias("h"))
    zero = F.lit(0).cast("long")
    return rows.join(changed, "h", "left").select(
        key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("h"))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", **options) -> DataFrame:
    """The documents with repeats cut out of their texts; what a cut leaves of a character goes too. Other texts stay as they are, null ones too."""
    changed = remove_repeats(docs, width, text, keep_text=True, **options)
    left = Scratch(docs.sparkSession, "cut-texts").keep(changed.select(F.col("h").alias("_folium_h"), F.col("kept").alias("_folium_text")), "left")
    marked = docs.withColumn("_folium_t", F.unhex(F.sha2(text_or_empty(text), 256))).join(left, F.col("_folium_t") == F.col("_folium_h"), "left")
    return marked.withColumn(text, F.coalesce("_folium_text", text)).select(*docs.columns)


def op4_two_stage_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and changed: whether the document loses anything."""
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumn("changed", F.col("n_removed") > 0)


QUERIES = {"op4_two_stage_suffix_sort": op4_two_stage_suffix_sort}
ORACLE_SQL: dict[str, str] = {}
