"""Connected components of a graph of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: Nodes of a task's forest before it is handed on and a new one begins.
HELD = 500_000


def _stars(edges: DataFrame) -> DataFrame:
    """(v, m): what joins the same nodes as the edges(v, m) of each task do, by union-find in bounded memory; m is the least node."""

    def emit(above: dict[int, int]) -> pa.RecordBatch:
        for v in above:
            m = above[v]
            while above.get(m, m) != m:
                m = above[m]
            above[v] = m
        pairs = [(v, m) for v, m in above.items() if v != m]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["v", "m"])

    def run(batches):
        above: dict[int, int] = {}
        for batch in batches:
            for v, m in zip(*(c.to_pylist() for c in batch.columns)):
                while (x := above.setdefault(v, v)) != v:
                    above[v] = v = above[x]
                while (x := above.setdefault(m, m)) != m:
                    above[m] = m = above[x]
                if v != m:
                    above[max(v, m)] = min(v, m)
            if len(above) > HELD:
                yield emit(above)
                above = {}
        yield emit(above)

    return edges.mapInArrow(run, "v long, m long")


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges(a, b), both LONG; root is the least node of its component.

    Each task first joins what its own edges connect; then large-star and
    small-star steps alternate: each round is two
    aggregations with map-side minima, so a hub of any degree costs one
    shuffled row for each neighbour and map task. Rounds grow with the
    logarithm of the longest path; they end when a round leaves the same edges. Self-loops and repeated edges do no harm,
    null ends are left out, and no edges give no rows. Sides of joins grow with the graph, so none is broadcast.
    """
    own = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    now = scratch.keep(_stars(own), "edges0")
    seal = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
    state = seal(now)
    for k in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("least")).select("v", F.least("v", "least").alias("least"))
        large = both.hint("merge").join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        down = large.union(least.where("least < v").select("v", F.col("least").alias("m"))).distinct()
        smallest = down.groupBy("v").agg(F.min("m").alias("least"))
        small = down.hint("merge").join(smallest, "v").where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        nxt = scratch.keep(small.union(smallest.select("v", F.col("least").alias("m"))).distinct(), f"edges{k}")
        was, state = state, seal(nxt)
        same = was == state and nxt.join(now.hint("merge"), ["v", "m"], "left_anti").isEmpty()
        scratch.drop(f"edges{k - 1}")
        now = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(now.select("m", "m").distinct())
