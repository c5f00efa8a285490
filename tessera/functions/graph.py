"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


#: So many edges, some megabytes, are left to one task; more than that contract first.
LAST_EDGES = 1 << 18


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of the edges of one task with the least node of their component."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    cuts = np.cumsum([len(x) for p in parts for x in p])[:-1]
    ends = np.split(at, cuts)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for us, vs in zip(ends[::2], ends[1::2], strict=True):
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = nodes[[find(i) for i in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "to"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", last_edges: int = LAST_EDGES) -> DataFrame:
    """The smallest id reachable from each endpoint: (node, component).

    Each round every node points to the one of least hash among itself and its neighbours,
    and then to where that one points; edges move to the nodes pointed to, and those inside
    one node or twice there go.  The hash is another one every round, so in expectation a
    share of the nodes goes each round whatever the shape of the graph, long paths included.
    Pointers and edges stay distributed and every round is cut.  Once at most ``last_edges``
    are left, a number that does not grow with the input, one task joins them by union-find.
    """
    left = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    rounds: list[DataFrame] = []
    while (n := left.count()) > last_edges:
        ranked = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = cut(ends.groupBy("u").agg(F.min(ranked("v")).alias("low")).select(F.col("u").alias("node"), F.least(ranked("u"), "low")["id"].alias("to")))
        far = near.select(F.col("node").alias("mid"), F.col("to").alias("far"))
        point = cut(near.join(far, F.col("to") == F.col("mid")).select("node", F.col("far").alias("to")))
        rounds.append(point)
        at = lambda side, point=point: point.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        moved = left.join(at("u"), "u").join(at("v"), "v")
        left = cut(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).where("u < v").distinct())
    if n:
        rounds.append(cut(left.repartition(1).mapInArrow(_union_find, "node long, to long")))
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def follow(known: DataFrame, point: DataFrame) -> DataFrame:
        """Where ``known`` leads one round later; what has no edge left stays."""
        on = point.select(F.col("node").alias("at"), F.col("to").alias("next"))
        return known.join(on, known["to"] == F.col("at"), "left").select("node", F.coalesce("next", "to").alias("to"))

    rooted = cut(reduce(follow, rounds[1:], rounds[0]))
    least = rooted.groupBy("to").agg(F.min("node").alias("component"))
    return cut(rooted.join(least, "to").select("node", "component"))
