"""Connected components on the shapes that slow label propagation down."""

import random

import pytest

from graphweft.operators import components as cc


def plain(edges):
    roots = {}

    def find(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    return {x: find(x) for x in roots}


def shuffled_path(n):
    nodes = list(range(n))
    random.Random(5).shuffle(nodes)
    return list(zip(nodes, nodes[1:], strict=False))


SHAPES = {
    "crawl": [(0, 2000), *((k, k - 1) for k in range(2000, 1, -1))],
    "random path": shuffled_path(2000),
    "ordered path": [(k, k + 1) for k in range(2000)],
    "star with a late centre": [(5000, k) for k in range(2000)],
    "star": [(0, k) for k in range(1, 2000)],
    "spokes": [e for k in range(1, 600) for e in ((0, 1000 + k), (1000 + k, k))],
    "many small ones": [(k, k + 1) for k in range(0, 900, 3)],
    "loops and doubles": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (4, None)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, monkeypatch, shape):
    rounds = []
    write = cc.Tables.write
    monkeypatch.setattr(cc.Tables, "write", lambda self, df: rounds.append("moved" in df.columns) or write(self, df))
    got = cc.connected_components(spark.createDataFrame(SHAPES[shape], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == plain([(a, b) for a, b in SHAPES[shape] if a is not None and b is not None and a != b])
    assert len(got) == len({r.node for r in got}) and sum(rounds) < 25


def test_nodes_of_any_ordered_type(spark):
    got = cc.connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")).collect()
    assert {r.node: r.root for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
