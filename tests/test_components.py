import random

from tessera.operators.components import components
from tessera.session import Scratch


def _brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_chains_stars_and_noise(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = spark.createDataFrame([*edges, *edges[:20], (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(rows, Scratch(spark, "t")).collect()}
    assert got == _brute(edges)


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr("tessera.operators.components.HELD", 20)
    rng = random.Random(6)
    edges = [(rng.randrange(-(2**62), 2**62) if k % 9 == 0 else rng.randrange(300), rng.randrange(300)) for k in range(400)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(rows, Scratch(spark, "t")).collect()}
    assert got == {k: v for k, v in _brute(edges).items() if any(k in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
