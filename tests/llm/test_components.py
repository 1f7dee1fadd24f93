"""Connected components against a plain search."""

import random

import numpy as np
import pytest

from folium.llm import components
from folium.llm.common import Scratch


def search(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    out = {}
    for k in sorted(near):
        if k not in out:
            todo = [k]
            out[k] = k
            while todo:
                for n in near[todo.pop()]:
                    if n not in out:
                        out[n] = k
                        todo.append(n)
    return out


RNG = random.Random(1)
GRAPHS = {
    "none": [], "loops alone": [(1, 1), (5, 5)], "chain": [(i, i + 1) for i in range(60)], "shuffled chain": [((i * 37) % 61, ((i + 1) * 37) % 61) for i in range(50)],
    "low hub": [(0, i) for i in range(1, 200)], "high hub": [(999, i) for i in range(200)] + [(-5, 3)], "random": [(RNG.randrange(90), RNG.randrange(90)) for _ in range(60)], "large ids": [(2**62, -(2**62)), (2**62, 3), (3, 3)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_connected(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "a long, b long")
    assert {r.node: r.component for r in components.connected(df, Scratch(spark, "test")).collect()} == search(GRAPHS[name])


def test_roots():
    rng = np.random.default_rng(2)
    for _ in range(20):
        link = rng.random((30, 30)) < 0.04
        link |= link.T
        np.fill_diagonal(link, False)
        want = {i: i for i in range(30)} | search([(int(i), int(j)) for i, j in np.argwhere(link)])
        assert components.roots(link).tolist() == [want[i] for i in range(30)]
