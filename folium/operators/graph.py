"""The concept graph: edges (concept, prerequisite), nodes, closure, chains, statistics.

Loops are driven from here a round at a time, each round a written table, and
stop when a round finds nothing new. Nothing is collected but counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as X
from folium.operators.storage import written

SPAN = 1 << 20


def build_edges(records: DataFrame) -> DataFrame:
    """(concept, prerequisite) of records that aren't noisy."""
    return records.where(~F.coalesce("noisy", F.lit(False))).select("concept", F.explode("prerequisites").alias("prerequisite"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: nodes (distinct endpoints, as spelt) and edges (repeats included)."""
    ends = edges.select(F.explode(F.array("concept", "prerequisite")).alias("n"))
    return ends.agg(F.count_distinct("n").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))


def ranks(df: DataFrame, order: str, name: str = "id", group: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """Ranks from 0, in each group, by a column of distinct longs from 0 up.

    Ranks are taken in spans of the order, and the spans' sizes summed up, so
    that no task sorts all rows, or all rows of a large group.
    """
    spanned = df.withColumn("_span", F.expr(f"{order} div {span}"))
    sizes = spanned.groupBy(*group, "_span").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*group, "_span", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))  # a row a span and group
    rank = F.row_number().over(Window.partitionBy(*group, "_span").orderBy(order)) - 1
    placed = spanned.withColumn("_rank", rank).alias("l").join(base.select(*[F.col(c).alias(f"_b_{c}") for c in (*group, "_span")], "_base"), [F.col(f"l.{c}").eqNullSafe(F.col(f"_b_{c}")) for c in (*group, "_span")])
    return placed.withColumn(name, (F.col("_base") + F.col("_rank")).cast("long")).drop("_span", "_base", "_rank", *[f"_b_{c}" for c in (*group, "_span")])


def nodes(edges: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(id, name): names in lower case, numbered as first seen, a concept ahead of its prerequisite.

    ``edges``: pos, concept, prerequisite. Edges with a blank end name no node;
    an edge from a name to itself does. ``alone`` (name): further nodes.
    """
    clean = normalized(edges)
    side = lambda c, k: F.struct(F.col(c).alias("name"), (F.col("pos") * 2 + k).alias("at"))
    seen = clean.select(F.explode(F.array(side("concept", 0), side("prerequisite", 1))).alias("x")).select("x.name", "x.at")
    first = seen.groupBy("name").agg(F.min("at").alias("at"))
    out = ranks(first, "at").select("id", "name")
    if alone is None:
        return out
    more = alone.select(X.node_name("name").alias("name")).where("name <> ''").distinct().join(out, "name", "left_anti")
    count = out.count()
    return out.unionByName(more.select((F.row_number().over(Window.orderBy("name")) - 1 + count).cast("long").alias("id"), "name"))


def normalized(edges: DataFrame) -> DataFrame:
    """(pos, concept, prerequisite) in lower case, stripped, without blank ends."""
    keep = [c for c in edges.columns if c not in ("concept", "prerequisite")]
    out = edges.select(*keep, X.node_name("concept").alias("concept"), X.node_name("prerequisite").alias("prerequisite"))
    return out.where("concept <> '' and prerequisite <> ''")


def proper(edges: DataFrame) -> DataFrame:
    """Normalized edges without those from a name to itself, the first of equal ones."""
    keys = [c for c in edges.columns if c not in ("pos", "concept", "prerequisite")]
    return normalized(edges).where("concept <> prerequisite").groupBy(*keys, "concept", "prerequisite").agg(F.min("pos").alias("pos"))


def _rounds(edges: DataFrame) -> tuple[int, DataFrame | None]:
    """Rounds, and (n) of the nodes from which a cycle can be reached, or None if there is no cycle.

    Round k keeps the concepts that start a chain of k edges. In an acyclic
    graph every round loses some; one that loses none has a cycle.
    """
    graph = written(edges.select("concept", "prerequisite").distinct(), "graph")
    alive, rounds = written(graph.select(F.col("concept").alias("n")).distinct(), "chain"), 0
    size = alive.count()
    while size:
        rounds += 1
        left = written(graph.join(alive, F.col("prerequisite") == F.col("n"), "left_semi").select(F.col("concept").alias("n")).distinct(), "chain")
        now = left.count()
        if now == size:
            return rounds, left
        alive, size = left, now
    return rounds, None


def peel(edges: DataFrame) -> tuple[int, bool]:
    """(edges in the longest chain, whether the graph is acyclic) of (concept, prerequisite)."""
    rounds, cyclic = _rounds(edges)
    return rounds, cyclic is None


def longest_chain(edges: DataFrame) -> int:
    length, acyclic = peel(edges)
    if not acyclic:
        raise ValueError("the graph has a cycle")
    return length


def is_acyclic(edges: DataFrame) -> bool:
    return peel(edges)[1]


class Insertion:
    """A graph that stays acyclic, with its nodes in a topological order that each edge kept may change (Pearce and Kelly).

    Only the nodes that stand between an edge's ends in that order are searched.
    """

    def __init__(self):
        self.place: dict[str, int] = {}
        self.out: dict[str, list[str]] = {}
        self.into: dict[str, list[str]] = {}
        self.low, self.high = 0, 0

    def add(self, c: str, p: str) -> bool:
        """Keeps the edge from c to p, unless c is reached from p."""
        place = self.place
        if p not in place:
            self.high += 1
            place[p], self.out[p], self.into[p] = self.high, [], []
        if c not in place:
            self.low -= 1
            place[c], self.out[c], self.into[c] = self.low, [], []
        first, last = place[p], place[c]
        if first < last:
            after, todo = {p}, [p]
            while todo:
                for n in self.out[todo.pop()]:
                    if n == c:
                        return False
                    if n not in after and place[n] < last:
                        after.add(n)
                        todo.append(n)
            ahead, todo = {c}, [c]
            while todo:
                for n in self.into[todo.pop()]:
                    if n not in ahead and place[n] > first:
                        ahead.add(n)
                        todo.append(n)
            moved = sorted(ahead, key=place.__getitem__) + sorted(after, key=place.__getitem__)
            for n, at in zip(moved, sorted(place[n] for n in moved)):
                place[n] = at
        self.out[c].append(p)
        self.into[p].append(c)
        return True


def insert_acyclic(edges: DataFrame, graph: str | None = None) -> DataFrame:
    """Edges kept by insertion in the order of pos: one that would close a cycle is refused.

    Each graph (a column's value) is inserted for itself, in parallel with
    others. Only edges that may lie on a cycle can be refused or be the reason
    for it: those between nodes that reach a cycle and are reached from one.
    All others stay without being looked at in order.
    """
    first = written(proper(edges), "proper")
    _, ahead = _rounds(first)
    if ahead is None:
        return first.select(*edges.columns)
    core = first
    for side in ("concept", "prerequisite"):
        core = core.join(ahead, F.col(side) == F.col("n"), "left_semi")
    _, behind = _rounds(core.select(F.col("prerequisite").alias("concept"), F.col("concept").alias("prerequisite")))
    for side in ("concept", "prerequisite"):
        core = core.join(behind, F.col(side) == F.col("n"), "left_semi")
    core = written(core, "core")
    free = first.join(core.select("concept", "prerequisite").distinct(), ["concept", "prerequisite"], "left_anti")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, held = part.sort_values("pos"), Insertion()
        return part[[held.add(c, p) for c, p in zip(part["concept"], part["prerequisite"])]]

    kept = core.select(*edges.columns).groupBy(*([graph] if graph else [])).applyInPandas(run, edges.schema)
    return free.select(*edges.columns).unionByName(kept)


def direct(edges: DataFrame, concept: str) -> DataFrame:
    """(name) of a concept's own prerequisites."""
    return edges.where(F.col("concept") == X.node_name(F.lit(concept))).select(F.col("prerequisite").alias("name"))


def dependents(edges: DataFrame, prerequisite: str) -> DataFrame:
    return edges.where(F.col("prerequisite") == X.node_name(F.lit(prerequisite))).select(F.col("concept").alias("name"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(concept, prerequisite) of all that each concept, or each of ``starts`` (concept), needs at any distance.

    Semi-naive: a round joins only the pairs that the last one found.
    """
    graph = edges.select("concept", "prerequisite").distinct()
    step = graph.select(F.col("concept").alias("prerequisite"), F.col("prerequisite").alias("next"))
    fresh = written(graph if starts is None else graph.join(starts.select("concept").distinct(), "concept", "left_semi"), "closure")
    known = fresh
    while not fresh.isEmpty():
        far = fresh.join(step, "prerequisite").select("concept", F.col("next").alias("prerequisite")).distinct()
        fresh = written(far.join(known, ["concept", "prerequisite"], "left_anti"), "closure")
        known = known.unionByName(fresh)
    return known


def degrees(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, out_degree, in_degree) of all nodes, zeros included."""
    out = edges.groupBy(F.col("concept").alias("name")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("prerequisite").alias("name")).agg(F.count("*").alias("i"))
    both = names.join(out, "name", "left").join(into, "name", "left")
    zero = F.lit(0).cast("long")
    return both.select("id", "name", F.coalesce("o", zero).alias("out_degree"), F.coalesce("i", zero).alias("in_degree"))


def top(degree: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k nodes of highest degree; of equal ones those with smaller ids."""
    return degree.orderBy(F.desc(by), "id").limit(k).select("name", F.col(by).alias("degree"))


def statistics(degree: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, foundations, targets, highest degrees, longest chain."""
    zero = F.lit(0).cast("long")
    return degree.agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("out_degree"), zero).alias("edges"),
        F.count_if(F.col("out_degree") == 0).alias("foundations_count"), F.count_if(F.col("in_degree") == 0).alias("targets_count"),
        F.coalesce(F.max("out_degree"), zero).alias("max_out_degree"), F.coalesce(F.max("in_degree"), zero).alias("max_in_degree"),
    ).withColumn("longest_prereq_chain", F.lit(longest_chain(edges)).cast("long"))


class ConceptGraph:
    """A graph of DataFrames, read-only: ``edges`` (kept ones) and ``names``."""

    def __init__(self, edges: DataFrame, alone: DataFrame | None = None):
        """``edges``: pos, concept, prerequisite, in any case; cycles are refused by order."""
        self.given = edges
        self.edges = written(insert_acyclic(edges), "edges")
        self.names = written(nodes(edges, alone), "nodes")

    def added(self) -> tuple[int, int]:
        """Edges kept and edges passed over."""
        kept = self.edges.count()
        return kept, self.given.count() - kept

    def prerequisites_of(self, concept: str, transitive: bool = True) -> DataFrame:
        if not transitive:
            return direct(self.edges, concept)
        start = self.edges.sparkSession.range(1).select(X.node_name(F.lit(concept)).alias("concept"))
        return closure(self.edges, start).select(F.col("prerequisite").alias("name"))

    def dependents_of(self, prerequisite: str) -> DataFrame:
        return dependents(self.edges, prerequisite)

    def has_path(self, start: str, goal: str) -> bool:
        goal_name = self.edges.sparkSession.range(1).select(X.node_name(F.lit(goal)).alias("name"))
        same = goal_name.where(F.col("name") == X.node_name(F.lit(start)))
        return not (same.isEmpty() and self.prerequisites_of(start).join(goal_name, "name", "left_semi").isEmpty())

    def id_of(self, name: str) -> int | None:
        row = self.names.where(F.col("name") == X.node_name(F.lit(name))).first()
        return None if row is None else row["id"]

    def name_of(self, node: int) -> str:
        row = self.names.where(F.col("id") == node).first()
        if row is None:
            raise KeyError(f"no node {node}")
        return row["name"]

    def as_ids(self) -> DataFrame:
        """(src, dst, pos)."""
        src = self.names.select(F.col("id").alias("src"), F.col("name").alias("concept"))
        dst = self.names.select(F.col("id").alias("dst"), F.col("name").alias("prerequisite"))
        return self.edges.join(src, "concept").join(dst, "prerequisite").select("src", "dst", "pos")

    def num_nodes(self) -> int:
        return self.names.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def stats(self, topk: int = 5) -> dict:
        d = written(degrees(self.names, self.edges), "degrees")
        out = statistics(d, self.edges).first().asDict()
        for by in ("out_degree", "in_degree"):
            out[f"top_by_{by}"] = [(r["name"], r["degree"]) for r in top(d, by, topk).collect()]
        return out
