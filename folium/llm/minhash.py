"""MinHash near-duplicates with tensored banding (operator 10).

Two collections of ``side`` short minhash keys each are computed per document;
a table key is a pair of one key from either, so ``side ** 2`` tables cost
``2 * side`` keys. A pair of documents meets in some table if it agrees in one
key of both collections; with 18 keys of 4 minhashes a side, that fails for a
pair at the threshold with probability 4e-6, and holds for a pair with a
similarity of 0.2 with probability 8e-4, so that unlike documents seldom chain.

Documents with equal shingle sets are one class. Keys that no other class has
are dropped before pairs are formed, so a document without look-alikes costs
``2 * side`` rows. Table keys join classes into groups (connected components),
in which links are verified on full sets by counting shared shingles. A group
too large for one task is cut into parts of bounded size. Every part is
verified within, together with a few pivots of its group; near copies of one
text are one component after that. What is left are links of classes outside a
group's largest component. Two similar sets share one of their first shingles
in any common order (as many as the threshold lets them differ in, and one
more), so classes meet in postings of their rarest shingles: within short
postings that hold several components pairs are verified; only classes in a
long one meet the classes of its group's long postings, part by part. A task
returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, held, schema, table, text_or_empty
from folium.llm.components import connected, roots

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 0x9E3779B97F4A7C15
BITS = 16  # shingles are counted in so many buckets, as a power of 2, to tell rare ones


class Shingler:
    """Sets of 64-bit shingle hashes of texts."""

    def __init__(self, words: int = 5, cache_entries: int = 400_000):
        self.words = words
        self.cache: dict[bytes, int] = {}
        self.cache_entries = cache_entries

    def set_of(self, text: str) -> np.ndarray:
        """Distinct shingles of a text, ascending. A text with fewer words is one shingle; without words it has none."""
        found = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        if not found:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > self.cache_entries:
            cache.clear()
        for w in set(found).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def keys_of(shingles: np.ndarray, side: int, rows: int) -> np.ndarray:
    """The 2 * side short keys of a set, each of ``rows`` minhashes."""
    m = 2 * side * rows
    k = np.arange(1, m + 1, dtype=np.uint64)
    mul = (k * np.uint64(SEED)) | np.uint64(1)
    add = k * np.uint64(0xD1B54A32D192ED03)
    low = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    for begin in range(0, len(shingles), 4096):
        x = shingles[None, begin : begin + 4096] * mul[:, None] + add[:, None]
        x ^= x >> np.uint64(32)
        low = np.minimum(low, (x * np.uint64(0x94D049BB133111EB)).min(1))
    low = low.reshape(2 * side, rows)
    key = np.full(2 * side, SEED, np.uint64)
    for r in range(rows):
        key = (key ^ low[:, r]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(31)
    return key


def similar(sets: list[np.ndarray], least: int, other: list[np.ndarray] | None = None) -> np.ndarray:
    """Symmetric matrix of the pairs with 100 * intersection >= least * union. With ``other``, only pairs across the two lists."""
    every = sets + (other or [])
    n = len(every)
    size = np.fromiter(map(len, every), np.int64, n)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    shingle = np.concatenate(every)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    count = np.diff(np.append(start, len(shingle)))
    both = np.zeros((n, n), np.int64)
    # Frequent shingles: a product of dense columns. Rare ones: their pairs, by distance in the list of owners.
    often = count > 48
    keep = np.repeat(~often & (count > 1), count)
    s, o = shingle[keep], owner[keep]
    d = 1
    while d < len(s):
        at = np.flatnonzero(s[d:] == s[:-d])
        if not len(at):
            break
        both += np.bincount(o[at] * n + o[at + d], minlength=n * n).reshape(n, n) if n * n < 4 * len(at) + 65536 else _add(n, o[at], o[at + d])
        d += 1
    both += both.T
    columns = np.flatnonzero(often)
    for k in range(0, len(columns), 1024):
        some = columns[k : k + 1024]
        dense = np.zeros((n, len(some)), np.float32)
        for c, col in enumerate(some):
            dense[owner[start[col] : start[col] + count[col]], c] = 1
        both += np.rint(dense @ dense.T).astype(np.int64)
    link = 100 * both >= least * (size[:, None] + size - both)
    np.fill_diagonal(link, False)
    if other is not None:
        link[: len(sets), : len(sets)] = False
        link[len(sets) :, len(sets) :] = False
    return link


def _add(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros((n, n), np.int64)
    np.add.at(out, (i, j), 1)
    return out


def prefix_of(shingles: np.ndarray, least: int, seen: np.ndarray) -> np.ndarray:
    """The shingles of which one is shared with every set that is similar enough: the rarest ones by ``seen``, counts by hash bucket."""
    n = len(shingles)
    rare = np.lexsort((shingles, seen[_bucket(shingles)]))
    return shingles[rare[: n + (-least * n) // 100 + 1]]


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BITS)).astype(np.int64)


def _forest(ids: np.ndarray, link: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(link.any(1))
    root = roots(link[np.ix_(at, at)])
    return pd.DataFrame({"a": ids[at], "b": ids[at[root]]}).query("a != b")


def near_duplicates(
    docs: DataFrame, least: int = 85, words: int = 5, side: int = 18, rows: int = 4, block: int = 1 << 20, most: int = 1024, pivots: int = 4, posting: int = 256,
    key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept; with ``digest``, text_sha256 too.

    Links documents whose sets have a Jaccard similarity of ``least`` percent or
    more. Null, empty and blank texts have no shingles and link with nothing;
    rows that repeat are linked with each other; a component's id is the
    smallest key in it (null if all are). A part of a group has ``block``
    shingles or ``most`` classes, about; a short posting has ``posting`` classes
    at most.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    kind = docs.schema[key].dataType.simpleString()
    whole_text = text_or_empty(text)
    source = docs.select(F.col(key).alias("k"), whole_text.alias("t"), F.unhex(F.sha2(whole_text, 256)).alias("d"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held(f"shingles {words}", lambda: Shingler(words))
        for b in batches:
            n, h, keys = [], [], []
            for t in b.column(1):
                s = shingler.set_of(t.as_py())
                n.append(len(s))
                h.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(keys_of(s, side, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(keys, pa.list_(pa.int64())), b.column(2)], ["k", "n", "h", "keys", "d"])

    signed = scratch.keep(source.mapInArrow(sign, schema(f"k {kind}, n long, h binary, keys array<long>, d binary")), "signed")
    first = F.min(F.struct(F.col("k").isNull().alias("no"), "k", "d")).alias("x")  # null keys last
    classes = signed.where("h is not null").groupBy("h").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys")).select("h", "x.k", "x.d", "n", "keys")
    classes = scratch.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    # Short keys that more than one class has, and the tables they form. What is counted by a key is written
    # before it is joined: so the rows of a hot key can be split among tasks.
    short = classes.select("c", F.posexplode("keys").alias("p", "s"))
    shared = scratch.keep(short.groupBy("p", "s").agg(F.count("*").alias("m")).where("m > 1").select("p", "s"), "shared")
    left = short.join(shared, ["p", "s"]).groupBy("c").agg(F.collect_list(F.struct("p", "s")).alias("e"))  # 2 * side entries at most
    pick = lambda cond: F.filter("e", cond)
    halves = left.select("c", pick(lambda x: x["p"] < side).alias("l"), pick(lambda x: x["p"] >= side).alias("r")).where("size(l) > 0 and size(r) > 0")
    tables = halves.select("c", F.explode("l").alias("l"), "r").select("c", "l", F.explode("r").alias("r"))
    tables = tables.select("c", F.col("l.p").alias("i"), F.col("r.p").alias("j"), F.xxhash64("l.s", "r.s").alias("key"))
    tables = scratch.keep(tables, "tables")
    heads = scratch.keep(tables.groupBy("i", "j", "key").agg(F.min("c").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m"), "heads")
    meet = tables.join(heads, ["i", "j", "key"]).select(F.col("c").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    groups = scratch.keep(connected(meet, scratch, "meet"), "groups")
    scratch.drop("shared", "tables", "heads")

    # Full sets of the classes that met others.
    members = scratch.keep(groups.select(F.col("node").alias("c"), F.col("component").alias("g")).join(classes.select("c", "k", "d", "n", "h"), "c"), "members")
    weights = scratch.keep(members.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / most)).cast("int").alias("cuts")), "weights")
    members = members.join(weights, "g").select(F.col("k").alias("rep"), F.col("d").alias("rep_d"), "h", "c", "g", "cuts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held(f"shingles {words}", lambda: Shingler(words))
        for b in batches:
            found = [shingler.set_of(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.binary())], ["c", "g", "cuts", "s"])

    texts = source.join(members, F.col("k").eqNullSafe(F.col("rep")) & (F.col("d") == F.col("rep_d"))).select("t", "c", "g", "cuts")
    full = texts.mapInArrow(sets, schema("c long, g long, cuts int, s binary")).withColumn("part", F.pmod(F.xxhash64("c"), "cuts").cast("int"))
    full = scratch.keep(full, "sets")

    edge = schema("a long, b long")
    read = lambda part: [np.frombuffer(x, np.uint64) for x in part["s"]]

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("c").sort_values("c")
        return _forest(part["c"].to_numpy(np.int64), similar(read(part), least))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["apart", "c"], ascending=[False, True]).drop_duplicates("c")
        a, b = part[part["apart"]], part[~part["apart"]]
        link = similar(read(a), least, read(b)) if len(a) and len(b) else similar(read(part), least)
        return _forest(part["c"].to_numpy(np.int64), link)

    small = full.where("cuts <= 1").groupBy("g").applyInPandas(within, edge)
    large = full.where("cuts > 1")
    chosen = large.groupBy("g", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(pivots))).agg(F.min("c").alias("c")).select("c")
    spread = large.join(chosen, "c", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    parts = large.unionByName(spread).groupBy("g", "part").applyInPandas(within, edge)
    links = scratch.keep(small.unionByName(parts), "links")
    found = scratch.keep(connected(links, scratch, "links-cc"), "found")

    # What isn't in the largest component of a large group.
    shape = large.select("c", "g", "cuts").distinct().join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    shape = scratch.keep(shape, "shape")
    largest = scratch.keep(shape.groupBy("g", "component").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("components")), "largest")
    shape = scratch.keep(shape.join(largest.where("components > 1"), "g").select("c", "g", "component", (F.col("component") != F.col("main")).alias("apart")), "split")
    if not shape.isEmpty():
        more = _across(scratch, scratch.keep(large.join(shape, ["c", "g"]), "split-sets"), least, most, posting, across)
        if not more.isEmpty():
            found = scratch.keep(connected(links.unionByName(more), scratch, "all-cc"), "found-all")
    scratch.drop("sets")

    named = found.withColumnRenamed("node", "c").join(classes.select("c", "k"), "c")
    smallest = scratch.keep(named.groupBy("component").agg(F.min("k").alias("component_id")), "smallest")
    ids = found.join(smallest, "component").select(F.col("node").alias("c"), "component_id")  # before classes without a component come in
    of = classes.select("h", "c", F.col("k").alias("own")).join(ids, "c", "left")
    of = scratch.keep(of.select("h", F.coalesce("component_id", "own").alias("component_id")), "result")
    out = signed.select("k", "n", "h", "d").join(of, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"), *([F.col("d").alias("text_sha256")] if digest else []))


def _across(scratch: Scratch, sets: DataFrame, least: int, most: int, posting: int, blocks) -> DataFrame:
    """Links between components of large groups, as (a, b). ``sets``: c, g, cuts, part, s, component, apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for x in b.column(0):
                seen += np.bincount(_bucket(np.frombuffer(x.as_py(), np.uint64)), minlength=1 << BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    counted = sets.select("s").mapInArrow(count, schema("bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))
    seen = np.zeros(1 << BITS, np.int64)
    for r in counted.collect():  # 2 ** BITS rows at most
        seen[r["bucket"]] = r["n"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix_of(np.frombuffer(x.as_py(), np.uint64), least, seen) for x in b.column(4)]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *(b.column(i).take(at) for i in range(4))], ["x", "g", "c", "component", "apart"])

    postings = sets.select("g", "c", "component", "apart", "s").mapInArrow(first, schema("x long, g long, c long, component long, apart boolean"))
    postings = scratch.keep(postings, "postings")
    sizes = postings.groupBy("g", "x").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    postings = scratch.keep(postings.join(scratch.keep(sizes.select("g", "x", "m"), "sizes"), ["g", "x"]), "useful")
    short = postings.where(F.col("m") <= posting)
    other = short.select("g", "x", F.col("c").alias("b"), F.col("component").alias("of"))
    pairs = short.where("apart").join(other, ["g", "x"]).where("component <> of").select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = ([np.frombuffer(x.as_py(), np.uint64) for x in b.column(i)] for i in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
            good = [100 * n >= least * (len(x) + len(y) - n) for n, x, y in zip(both, one, two)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["a", "b"])

    set_of = lambda c, s: sets.select(F.col("c").alias(c), F.col("s").alias(s))
    linked = pairs.join(set_of("a", "s"), "a").join(set_of("b", "s2"), "b").select("a", "b", "s", "s2").mapInArrow(verify, schema("a long, b long"))

    hot = scratch.keep(postings.where(F.col("m") > posting).select("c", "g", "apart").distinct(), "hot")
    rests = scratch.keep(hot.where("apart").groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("rests")), "rests")
    columns = ["g", "i", "part", "c", "s", "apart"]
    met = sets.join(hot.select("c"), "c", "left_semi").join(rests, "g")
    rest = met.where("apart").drop("part").withColumn("i", F.pmod(F.xxhash64("c", F.lit(2)), "rests").cast("int"))
    # Part -1 holds nothing else: there the classes apart meet each other, and in the other parts only what isn't among them.
    rest = rest.withColumns({"part": F.explode(F.sequence(F.lit(-1), F.col("cuts") - 1)), "apart": F.lit(True)}).select(columns)
    every = met.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "apart": F.lit(False)}).select(columns)
    return scratch.keep(linked.unionByName(rest.unionByName(every).groupBy("g", "i", "part").applyInPandas(blocks, schema("a long, b long"))), "more")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, as they are, without those that have a near duplicate with a smaller key.

    One row of each group stays: the one with the smallest key; of rows that
    share key and group the one with the smallest digest of its text, and one
    of those that are equal in both. Rows without shingles all stay.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    judged = scratch.keep(near_duplicates(docs, key=key, text=text, digest=True, **options), "judged")
    kept = judged.where("kept and n_shingles > 0").select(F.col(key).alias("_folium_k"), F.col("component_id").alias("c"), F.col("text_sha256").alias("_folium_d"))
    # Null keys name no group: their rows go by text.
    group = F.struct(F.col("c"), F.when(F.col("c").isNull(), F.col("_folium_d")))
    kept = kept.groupBy(group.alias("g")).agg(F.min(F.struct("_folium_k", "_folium_d")).alias("x")).select("x.*")
    copies = judged.join(kept, F.col(key).eqNullSafe(F.col("_folium_k")) & (F.col("text_sha256") == F.col("_folium_d")), "left_semi").groupBy(key, "text_sha256").count().where("count > 1")
    blank = judged.where("n_shingles = 0").select(F.col(key).alias("_folium_k"), F.col("text_sha256").alias("_folium_d")).distinct()
    marked = docs.withColumn("_folium_t", F.unhex(F.sha2(text_or_empty(text), 256)))
    stay = lambda some: marked.join(some, F.col(key).eqNullSafe(F.col("_folium_k")) & (F.col("_folium_t") == F.col("_folium_d")), "left_semi")
    if copies.isEmpty():  # as always where keys are unique
        return stay(kept.unionByName(blank)).drop("_folium_t")
    return stay(kept).dropDuplicates([key, "_folium_t"]).unionByName(stay(blank)).drop("_folium_t")


def op10_tensored_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_tensored_banding": op10_tensored_banding}
ORACLE_SQL = {
    "op10_tensored_banding": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
link AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM link UNION SELECT r.node, k.b FROM reach r JOIN link k ON k.a = r.other),
c AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.node = s.doc_id"""
}
