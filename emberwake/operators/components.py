"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two shuffles over the edges; a hub with many neighbours is only ever joined
to its minimum, which is a partial aggregate, so no neighbourhood is gathered in one task.
Up to FEW edges, counted first, one task joins them in memory, which spares small inputs the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Edges that one task may hold: some ten MB.
FEW = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task, by union to the smaller root."""
    root: dict = {}

    def find(a):
        path = []
        while root.setdefault(a, a) != a:
            path.append(a)
            a = root[a]
        for p in path:
            root[p] = a
        return a

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    if root:
        nodes = list(root)
        yield pa.record_batch([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. edges(u, v) without loops, u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own minimum keeps its larger neighbours linked to itself
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without edges are absent.

    Self loops and null ends only contribute their non-null nodes if linked elsewhere; repeated
    edges are collapsed. Rounds end when the edge set is a set of stars (a fixed point).
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= few:
        kind = e.schema["u"].dataType.simpleString()
        return cut(e.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    mark = None
    for _ in range(max_rounds):
        e = cut(_star(_star(e, large=True), large=False))
        found = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
