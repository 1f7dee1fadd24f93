"""Near-duplicate embeddings by int8 tile products (operator 3).

Equal vectors of a label are one class; what follows works on classes. Classes
of a label go into blocks of bounded size, near ones together: cells are the
nearest of the first k pivots, k by the label's size, and large cells are cut
by the nearest of the last m pivots, m by the cell's size; only what is too
large even then is cut by a hash. A block that holds clusters is cut into them. Two cells, and then two blocks, are compared
unless their centres are so far apart that no pair can reach the threshold
(angles obey the triangle inequality); blocks that remain meet in a tile. There
both sides are quantised to int8; with x = s q + e for a unit vector,

    |x.y - s t (q.r)| <= |e| + (1 + |e|) |f|,

so the products of the int8 codes, which are exact, decide all pairs but those
whose interval holds the threshold; these are computed in double precision. A
tile returns each vector's number of links and the root of its component in the
tile, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, schema, table
from folium.llm.components import connected, roots

EPS = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the rows of x."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(x - code * scale[:, None], axis=1) + EPS


def links(x: np.ndarray, y: np.ndarray, least: float, at_once: int = 1 << 16) -> np.ndarray:
    """Which rows of x (unit vectors) have a cosine of ``least`` or more with which rows of y."""
    (q, s, e), (r, t, f) = quantise(x), quantise(y)
    exact = np.float32 if x.shape[1] <= 1024 else np.float64  # 127 * 127 * 1024 < 2 ** 24
    near = (q.astype(exact) @ r.astype(exact).T).astype(np.float64) * s[:, None] * t
    slack = e[:, None] + (1 + e[:, None]) * f
    out = near - slack >= least
    i, j = np.nonzero((near + slack >= least) & ~out)
    for k in range(0, len(i), at_once):
        a, b = i[k : k + at_once], j[k : k + at_once]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else tiny and huge components lose their squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(u: np.ndarray, tight: float, few: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Rows of unit vectors, centre and widest angle to it of parts that are far apart.

    A part that is wider than ``tight`` is halved between two of its outermost
    vectors, as long as no half has fewer rows than ``few`` and a half gets much
    narrower; where there are no clusters all rows stay one part.
    """

    def shape(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        mean = u[at].mean(0)
        size = np.linalg.norm(mean)
        centre = mean / size if size > 1e-6 else u[at[0]]
        return at, centre, float(np.arccos(np.clip(u[at] @ centre, -1, 1)).max()) + 1e-6

    out, todo = [], [shape(np.arange(len(u)))]
    while todo:
        at, centre, wide = part = todo.pop()
        halves = []
        if wide > tight and len(at) >= 2 * few:
            one = u[at[np.argmin(u[at] @ centre)]]
            two = u[at[np.argmin(u[at] @ one)]]
            side = u[at] @ one >= u[at] @ two
            if min(side.sum(), (~side).sum()) >= few:
                halves = [shape(at[side]), shape(at[~side])]
        if halves and min(h[2] for h in halves) < 0.75 * wide:
            todo += halves
        else:
            out.append(part)
    return out


def near_vectors(vectors: DataFrame, least: float = 0.93, block: int = 1024, pivots: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """One row per row: key, n_links, component_id, kept.

    Rows with a null label, and vectors that are null, empty, zero or hold a null
    or a non-finite component, link with nothing; vectors of unlike lengths
    neither. Rows that repeat count as vectors of their own. A component's id is
    its smallest key; rows whose key is null are kept only if that is null too.
    ``pivots`` bounds the sample that cells are taken from, and the cells of a
    label; it changes what is skipped, never what is linked. A cosine is compared
    with ``least`` in double precision, so one that is equal to it links.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    as_double = F.col(vector).cast("array<double>")
    good = F.col("l").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), as_double.alias("x"))
    rows = rows.withColumn("h", F.when(F.coalesce(good, F.lit(False)), F.unhex(F.sha2(F.concat_ws("|", F.col("l"), F.array_join("x", ",")), 256))))
    groups = rows.where("h is not null").groupBy("h").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.first("l").alias("l"), F.first("x").alias("x"))
    classes = scratch.keep(groups.withColumn("dim", F.size("x")).withColumn("c", F.monotonically_increasing_id()), "classes")

    first = [(r["dim"], r["x"]) for r in classes.orderBy(F.xxhash64("h")).select("dim", "x").limit(pivots).collect()]
    held = {d: unit(np.array([x for dim, x in first if dim == d])) for d in {d for d, _ in first}}
    sizes = scratch.keep(classes.groupBy("l", "dim").agg(F.least(F.lit(pivots), F.ceil(F.count("*") / block)).cast("int").alias("cells")), "sizes")

    def nearest(dim: int, u: np.ndarray, many: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each row of u the nearest of as many pivots from the first on, or from the ``last`` on backwards: its number, and the angle to it."""
        number, angle = np.zeros(len(u), np.int32), np.full(len(u), np.pi)
        if dim in held:
            many = np.clip(many, 1, len(held[dim]))
            some = (held[dim][::-1] if last else held[dim])[: many.max()]
            for k in range(0, len(u), 1024):
                dot = u[k : k + 1024] @ some.T
                dot[np.arange(len(some)) >= many[k : k + 1024, None]] = -2
                number[k : k + 1024], angle[k : k + 1024] = dot.argmax(1), np.arccos(np.clip(dot.max(1), -1, 1)) + 1e-6
        return number, angle

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, l, dim, cells, x = b.columns
            flat, d, n = x.flatten().to_numpy(zero_copy_only=False), dim.to_numpy(), cells.to_numpy()
            start = np.concatenate(([0], np.cumsum(d)))
            cell, far = np.zeros(len(d), np.int32), np.zeros(len(d))
            vecs: list = [b""] * len(d)
            for k in np.unique(d):
                at = np.flatnonzero(d == k)
                u = unit(flat[start[at][:, None] + np.arange(k)])
                cell[at], far[at] = nearest(k, u, n[at])
                for i, v in zip(at, u):
                    vecs[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([c, l, dim, pa.array(cell), pa.array(far), pa.array(vecs, pa.binary())], ["c", "l", "dim", "cell", "far", "u"])

    def to_sub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, l, dim, cell, u, cuts = b.columns
            d, m, sub = dim.to_numpy(), cuts.to_numpy(), np.zeros(b.num_rows, np.int32)
            for k in np.unique(d[m > 1]):
                at = np.flatnonzero((d == k) & (m > 1))
                sub[at] = nearest(k, np.frombuffer(b"".join(u.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1), m[at], last=True)[0]
            yield pa.RecordBatch.from_arrays([c, l, dim, cell, pa.array(sub), u], ["c", "l", "dim", "cell", "sub", "u"])

    # What is counted by cell is written before it is joined: so a hot cell's rows can be split among tasks.
    celled = classes.join(sizes, ["l", "dim"]).select("c", "l", "dim", "cells", "x").mapInArrow(to_cell, schema("c long, l string, dim int, cell int, far double, u binary"))
    celled = scratch.keep(celled, "cells")
    shape = scratch.keep(celled.groupBy("l", "dim", "cell").agg(F.least(F.lit(pivots), F.ceil(F.count("*") / block)).cast("int").alias("cuts"), F.max("far").alias("wide")), "shape")
    placed = celled.join(shape, ["l", "dim", "cell"]).select("c", "l", "dim", "cell", "u", "cuts").mapInArrow(to_sub, schema("c long, l string, dim int, cell int, sub int, u binary"))
    placed = scratch.keep(placed.join(classes.select("c", "n"), "c"), "placed")
    cuts = scratch.keep(placed.groupBy("l", "dim", "cell", "sub").agg(F.ceil(F.count("*") / block).alias("cuts")), "cuts")
    blocks = placed.join(cuts, ["l", "dim", "cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("cuts")))

    widest = float(np.arccos(least)) + 1e-6

    def to_block(part: pd.DataFrame) -> pd.DataFrame:
        u, row, rows = np.frombuffer(b"".join(part["u"]), np.float64).reshape(len(part), -1), part.iloc[0], []
        c, n = part["c"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        for k, (at, centre, wide) in enumerate(clusters(u, widest, max(1, block // 64))):
            name = f"{row['cell']}-{row['sub']}-{row['part']}-{k}"
            rows.append((row["l"], row["dim"], row["cell"], name, centre.tolist(), wide, c[at].tobytes(), n[at].tobytes(), u[at].tobytes()))
        return pd.DataFrame(rows, columns=["l", "dim", "cell", "at", "centre", "wide", "c", "n", "u"])

    spec = schema("l string, dim int, cell int, at string, centre array<double>, wide double, c binary, n binary, u binary")
    packed = scratch.keep(blocks.groupBy("l", "dim", "cell", "sub", "part").applyInPandas(to_block, spec), "blocks")
    scratch.drop("cells", "placed", "cuts", "sizes")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, dim, cell, wide, cell2, wide2 = b.columns
            d, i, j = dim.to_numpy(), cell.to_numpy(), cell2.to_numpy()
            angle = np.zeros(b.num_rows)
            for k in np.unique(d):
                if k in held:
                    at = np.flatnonzero(d == k)
                    angle[at] = np.arccos(np.clip((held[k][i[at]] * held[k][j[at]]).sum(1), -1, 1))
            good = pa.array(angle - wide.to_numpy() - wide2.to_numpy() <= widest)
            yield pa.RecordBatch.from_arrays([x.filter(good) for x in (l, dim, cell, cell2)], ["l", "dim", "cell", "cell2"])

    # Cells are compared first, as many as pivots at most a label, then blocks of cells that are near enough.
    theirs = shape.select("l", "dim", F.col("cell").alias("cell2"), F.col("wide").alias("wide2"))
    pairs = shape.select("l", "dim", "cell", "wide").join(theirs, ["l", "dim"]).where("cell <= cell2").select("l", "dim", "cell", "wide", "cell2", "wide2")
    pairs = scratch.keep(pairs.mapInArrow(near, schema("l string, dim int, cell int, cell2 int")), "cell-pairs")
    meta = packed.select("l", "dim", "cell", "at", "centre", "wide")
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    other = meta.select("l", "dim", F.col("cell").alias("cell2"), F.col("at").alias("at2"), F.col("centre").alias("centre2"), F.col("wide").alias("wide2"))
    tiles = meta.join(pairs, ["l", "dim", "cell"]).join(other, ["l", "dim", "cell2"]).where((F.col("cell") < F.col("cell2")) | (F.col("at") <= F.col("at2")))
    tiles = scratch.keep(tiles.where(angle - F.col("wide") - F.col("wide2") <= widest).select("l", "dim", "at", "at2"), "tiles")
    right = packed.select("l", "dim", F.col("at").alias("at2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("u").alias("u2"))
    loaded = tiles.join(packed.select("l", "dim", "at", "c", "n", "u"), ["l", "dim", "at"]).join(right, ["l", "dim", "at2"])
    loaded = loaded.select("dim", (F.col("at") == F.col("at2")).alias("same"), "c", "n", "u", "c2", "n2", "u2")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                dim, same, c, n, u, c2, n2, u2 = (col[k].as_py() for col in b.columns)
                c, n, c2, n2 = (np.frombuffer(v, np.int64) for v in (c, n, c2, n2))
                x = np.frombuffer(u, np.float64).reshape(-1, dim)
                y = x if same else np.frombuffer(u2, np.float64).reshape(-1, dim)
                link = links(x, y, least)
                if same:
                    link |= link.T
                    np.fill_diagonal(link, False)
                    ids, many, whole = c, link @ n, link
                else:
                    size = len(x) + len(y)
                    whole = np.zeros((size, size), bool)
                    whole[: len(x), len(x) :] = link
                    whole[len(x) :, : len(x)] = link.T
                    ids, many = np.concatenate((c, c2)), np.concatenate((link @ n2, n @ link))
                at = np.flatnonzero(many)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(many[at].astype(np.int64)), pa.array(ids[at[roots(whole[np.ix_(at, at)])]])], ["c", "links", "root"])

    found = scratch.keep(loaded.mapInArrow(tile, schema("c long, links long, root long")), "found")
    scratch.drop("blocks", "tiles", "cell-pairs", "shape")
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = scratch.keep(connected(found.select(F.col("c").alias("a"), F.col("root").alias("b")), scratch), "groups")
    named = groups.withColumnRenamed("node", "c").join(classes.select("c", "k"), "c")
    smallest = scratch.keep(named.groupBy("component").agg(F.min("k").alias("component_id")), "smallest")
    of = groups.join(smallest, "component").select(F.col("node").alias("c"), "component_id")  # before classes without a component come in
    result = classes.select("h", "c", "n", F.col("k").alias("own")).join(counts, "c", "left").join(of, "c", "left")
    result = scratch.keep(result.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id")), "result")
    out = rows.select("k", "h").join(result, "h", "left")
    component = F.when(F.col("n_links").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))


def op3_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_int8_tiles": op3_int8_tiles}
ORACLE_SQL = {
    "op3_int8_tiles": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT a AS node, a AS other FROM link
  UNION
  SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
  coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN comp ON comp.node = e.vec_id"""
}
