"""Components against union-find."""

import random

import pytest

from tidemark.operators.graph import components


def by_union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (3, 3)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)] + [(99, 100)],
    [tuple(random.Random(k).sample(range(60), 2)) for k in range(40)], [(2**62, -5), (-5, 7)],
])
def test_components(spark, edges):
    frame = spark.createDataFrame([*edges, (None, 4), (5, None)], "src long, dst long")
    assert {r.node: r.component for r in components(frame).collect()} == by_union_find(edges)
    assert {r.node: r.component for r in components(frame, one_task_rows=1000).collect()} == by_union_find(edges)
