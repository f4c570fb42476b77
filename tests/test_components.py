import random

import pytest

from terrazzo.operators import components


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(k, k + 1) for k in range(100, 120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
