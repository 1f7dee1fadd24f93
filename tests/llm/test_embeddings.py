"""Embeddings against all pairs in double precision."""

import numpy as np
import pytest

from folium.llm import embeddings
from folium.llm.common import Scratch


def brute(rows, least=0.93):
    ok = lambda x: x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
    link = {k: set() for k, _, _ in rows}
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            if la is not None and la == lb and ok(x) and ok(y) and len(x) == len(y):
                u, v = np.array(x, np.float64), np.array(y, np.float64)
                u, v = u / abs(u).max(), v / abs(v).max()
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                    link[a].add(b), link[b].add(a)
    out = {}
    for k in link:
        seen, todo = {k}, [k]
        while todo:
            todo += (new := link[todo.pop()] - seen)
            seen |= new
        out[k] = (len(link[k]), min(seen), min(seen) == k)
    return out


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        for _ in range(12):
            rows.append(((centre + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.4])) * 10.0 ** rng.integers(-3, 4), int(rng.integers(0, 2))))
    rows = [(x.astype(np.float32).tolist(), c) for x, c in rows]
    rows += [(rows[0][0], rows[0][1])] * 3
    rows += [([0.0] * 16, 1), (None, 1), ([1.0, None], 1), ([float("nan")] * 16, 0), ([float("inf")] + [0.0] * 15, 0), (rows[1][0], None), ([], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([1e-38] * 16, 1), ([3e38] * 16, 1)]
    return [(k, x, c) for k, (x, c) in enumerate(rows)]


@pytest.mark.parametrize("block, pivots", [(1024, 4096), (7, 5), (16, 1), (3, 100)])
def test_brute_force(spark, block, pivots):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, block=block, pivots=pivots).collect()}
    assert got == brute(rows)


def test_a_hot_label_is_pruned(spark):
    """Most vectors have one label, in clusters that are far apart: tiles grow with the vectors, not with their square."""
    rng, counted = np.random.default_rng(2), []
    for clusters in (20, 40):
        centres = rng.normal(size=(clusters, 24))
        rows = [(k, (centres[k % clusters] + rng.normal(size=24) * 0.01).tolist(), 0) for k in range(clusters * 16)] + [(100_000 + k, rng.normal(size=24).tolist(), 1) for k in range(50)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        scratch = Scratch(spark, "counted")
        scratch.drop = lambda *names: None
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, block=16, scratch=scratch).collect()}
        assert all(got[k] == (15, k % clusters) for k in range(clusters * 16)) and all(got[100_000 + k] == (0, 100_000 + k) for k in range(50))
        counted.append(spark.read.parquet(f"{scratch.root}/tiles").count())
        scratch.clear()
    assert counted[1] < 3.2 * counted[0]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = embeddings.unit(rng.normal(size=(200, 64))), embeddings.unit(rng.normal(size=(100, 64)))
    (q, s, e), (r, t, f) = embeddings.quantise(x), embeddings.quantise(y)
    near = (q.astype(float) @ r.T.astype(float)) * s[:, None] * t
    assert (abs(x @ y.T - near) <= e[:, None] + (1 + e[:, None]) * f).all()
    assert (embeddings.links(x, y, 0.2) == (x @ y.T >= 0.2)).all()
