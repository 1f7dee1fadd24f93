"""The concept graph."""

import random

import pytest

from folium.operators import graph
from folium.plans import catalogue

EDGES = [("A", "b"), ("b", "C"), ("c", "a"), ("a ", "B"), ("d", "D"), ("", "x"), ("a", "c")]


def table(spark, pairs):
    return spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(pairs)], "pos long, concept string, prerequisite string")


def test_vectors(spark):
    g = graph.ConceptGraph(table(spark, EDGES))
    assert {r.name: r.id for r in g.names.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {(r.src, r.dst) for r in g.as_ids().collect()} == {(0, 1), (1, 2), (0, 2)}
    assert g.added() == (3, 4) and (g.num_nodes(), g.num_edges()) == (4, 3)
    s = g.stats()
    assert (s["foundations_count"], s["targets_count"], s["max_out_degree"], s["max_in_degree"], s["longest_prereq_chain"]) == (2, 2, 2, 2, 2)
    assert s["top_by_out_degree"][0] == ("a", 2)
    assert {r.name for r in g.prerequisites_of("A").collect()} == {"b", "c"} and {r.name for r in g.dependents_of("C").collect()} == {"a", "b"}
    assert g.has_path("a", "c") and not g.has_path("c", "a") and g.has_path("z", "z")
    assert g.id_of(" B ") == 1 and g.id_of("none") is None and g.name_of(2) == "c"
    assert g.prerequisites_of("none").count() == 0
    with pytest.raises(KeyError):
        g.name_of(9)


def greedy(pairs):
    kept, out = set(), {}
    for c, p in pairs:
        if c == p or (c, p) in kept:
            continue
        seen, todo = {p}, [p]
        while todo:
            todo += [n for n in out.get(todo.pop(), ()) if n not in seen and not seen.add(n)]
        if c not in seen:
            kept.add((c, p))
            out.setdefault(c, []).append(p)
    return kept


@pytest.mark.parametrize("nodes, edges", [(8, 30), (40, 60), (60, 45)])
def test_insertion_is_greedy(spark, nodes, edges):
    rng = random.Random(nodes)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]
    got = {(r.concept, r.prerequisite) for r in graph.insert_acyclic(table(spark, pairs)).collect()}
    assert got == greedy(pairs)
    kept = table(spark, sorted(got))
    assert graph.is_acyclic(kept)
    reach = {(r.concept, r.prerequisite) for r in graph.closure(kept).collect()}
    want = set(got)
    while more := {(a, d) for a, b in want for c, d in got if b == c} - want:
        want |= more
    assert reach == want


def test_insertion_query(spark, sf):
    """All events, against insertion one by one."""
    events, last, pairs = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect(), {}, {}
    for e in events:
        if e.event_type in last:
            pairs.setdefault(e.event_type, []).append((f"user {e.user_id}", f"user {last[e.event_type]}"))
        last[e.event_type] = e.user_id
    got = {(r.event_type, r.concept, r.prerequisite) for r in catalogue.QUERIES["graph_dag_insert"](spark, sf).collect()}
    want = {(kind, *edge) for kind, some in pairs.items() for edge in greedy(some)}
    assert got == want and len(want) < sum(len(set(p)) for p in pairs.values())


def test_ranks(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", None, "b") for v in (0, 3, 4, 11, 25)], "g string, v long")
    got = graph.ranks(df, "v", "r", ("g",), span=4).collect()
    assert len(got) == 15 and all(r.r == [0, 3, 4, 11, 25].index(r.v) for r in got)
    assert sorted(r.id for r in graph.ranks(df.where("g = 'a'"), "v", span=4).collect()) == [0, 1, 2, 3, 4]


def test_cycles(spark):
    assert graph.peel(table(spark, [("a", "b"), ("b", "a"), ("x", "a")]))[1] is False
    assert graph.longest_chain(table(spark, [])) == 0
    with pytest.raises(ValueError):
        graph.longest_chain(table(spark, [("a", "b"), ("b", "a")]))
    assert {tuple(r) for r in graph.build_edges(spark.createDataFrame([("A", False, ["x", "y"]), ("B", True, ["z"]), ("C", None, ["x"])], "concept string, noisy boolean, prerequisites array<string>")).collect()} == {("A", "x"), ("A", "y"), ("C", "x")}
