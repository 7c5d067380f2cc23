"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Shards are by hash of the id and of bounded size, so the number of shards grows with the table. A
shard's graph has layers, each a random subset of the one below; a node's neighbours are picked from its
nearest by the usual diversity rule (nearer to the node than to any neighbour picked before),
with links in both directions. All layers are stored as flat neighbour arrays, one row per shard. As
a shard is bounded, the candidates of a node are found with blocked products and not by searches
during insertion; the search itself walks the graph for many queries at once.

For inner products an extra coordinate makes all norms equal, so that the nearest by angle is the
one of the largest product. Equal vectors of a shard are one node with a list of ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Vectors of a shard and queries of a block, about.
SHARD = 16_384
QUERIES = 4_096
#: Neighbours of a node on the lowest layer (half of it above), and nodes kept in view by a search.
DEGREE = 32
VIEW = 96
CANDIDATES = 64


def _layer(x: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbours (n, degree) of one layer, -1 where there are fewer."""
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    if n < 2:
        return out
    k = min(CANDIDATES, n - 1)
    source, target, gap = [], [], []
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(s, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        between = np.matmul(x[near], x[near].transpose(0, 2, 1))
        picked = np.zeros(near.shape, bool)
        taken = np.zeros(len(near), np.int64)
        for c in range(k):
            shaded = (picked & (between[:, c, :] > value[:, c, None])).any(1)
            picked[:, c] = ~shaded & (taken < degree // 2)
            taken += picked[:, c]
        picked[:, : min(k, 4)] = True  # the very nearest always
        i, c = np.nonzero(picked)
        source.append(i + at)
        target.append(near[i, c])
        gap.append(value[i, c])
    source, target, gap = map(np.concatenate, (source, target, gap))
    edge = np.unique(np.stack([np.concatenate([source, target]), np.concatenate([target, source])], 1), axis=0)
    value = np.concatenate([np.einsum("nd,nd->n", x[edge[a : a + 65536, 0]], x[edge[a : a + 65536, 1]]) for a in range(0, len(edge), 65536)])
    order = np.lexsort((edge[:, 1], -value, edge[:, 0]))
    edge = edge[order]
    place = np.arange(len(edge)) - np.searchsorted(edge[:, 0], edge[:, 0])
    keep = place < degree
    out[edge[keep, 0], place[keep]] = edge[keep, 1]
    return out


def build(x: np.ndarray, top: float, seed: int = 5) -> dict[str, np.ndarray]:
    """Layers over distinct vectors x: `members` and `neighbours` of each, lowest first, flattened."""
    extra = np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))
    y = np.concatenate([x, extra[:, None]], 1).astype(np.float32)
    level = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / math.log(DEGREE / 2)).astype(int)
    layers, members = [], []
    for depth in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= depth)
        local = _layer(y[own], DEGREE if depth == 0 else DEGREE // 2)
        layers.append(np.where(local >= 0, own[local].astype(np.int32), -1))
        members.append(own.astype(np.int32))
    return {"members": members, "layers": layers}


def _beam(x: np.ndarray, rows: np.ndarray, neighbours: np.ndarray, q: np.ndarray, start: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walks of all queries at once; rows: node -> row of neighbours. (nodes, products), the best first."""
    n = len(q)
    each = np.arange(n)[:, None]
    seen = np.zeros((n, len(x)), bool)
    nodes = np.full((n, view), -1, np.int64)
    value = np.full((n, view), -np.inf, np.float32)
    done = np.ones((n, view), bool)
    width = start.shape[1]
    nodes[:, :width], value[:, :width], done[:, :width] = start, np.einsum("qkd,qd->qk", x[start], q), False
    seen[each, start] = True
    live = np.arange(n)
    while len(live):
        score = np.where(done[live], -np.inf, value[live])
        pick = np.argpartition(-score, min(1, view - 1), axis=1)[:, :2]
        ok = np.take_along_axis(score, pick, 1) > -np.inf
        alive = ok.any(1)
        live, pick, ok = live[alive], pick[alive], ok[alive]
        if not len(live):
            break
        done[live[:, None], pick] = True
        at = rows[np.where(ok, nodes[live[:, None], pick], 0)]
        new = np.where(ok[:, :, None], neighbours[at], -1).reshape(len(live), -1)
        new.sort(1)
        fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        i, c = np.nonzero(fresh)
        if not len(i):
            continue
        seen[live[i], new[i, c]] = True
        found = np.full(new.shape, -np.inf, np.float32)
        found[i, c] = np.einsum("nd,nd->n", x[new[i, c]], q[live[i]])
        both = np.concatenate([value[live], found], 1)
        best = np.argpartition(-both, view - 1, axis=1)[:, :view]
        value[live] = np.take_along_axis(both, best, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], new], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(new.shape, bool)], 1), best, 1) | ~np.isfinite(value[live])
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)


def search(x: np.ndarray, graph: dict, q: np.ndarray, view: int) -> np.ndarray:
    """Nodes near each query, -1 where there are fewer."""
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    start = np.full((len(q), 1), graph["members"][-1][0], np.int64)
    for depth in range(len(graph["layers"]) - 1, -1, -1):
        rows = np.zeros(len(x), np.int64)
        rows[graph["members"][depth]] = np.arange(len(graph["members"][depth]))
        nodes, value = _beam(x32, rows, graph["layers"][depth], q32, start, view if depth == 0 else 8)
        start = np.where(np.isfinite(value), nodes, nodes[:, :1])
    return np.where(np.isfinite(value), nodes, -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", view: int = VIEW) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k of largest inner product that the graphs find.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components take no
    part; only vectors of one length are compared. Equal rows count once. Ties go to the smaller id.
    """
    raw = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    fit = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    own = raw.where(F.coalesce(fit, F.lit(False))).withColumn("dim", F.size("v"))
    sizes = own.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()  # a row for each vector length
    number = F.create_map(*[F.lit(z) for r in sizes for z in (r["dim"], max(1, math.ceil(r["n"] / SHARD)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    blocks = F.create_map(*[F.lit(z) for r in sizes for z in (r["dim"], max(1, math.ceil(r["n"] / every / QUERIES)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    top = {r["dim"]: math.sqrt(r["top"]) for r in sizes}
    kind = own.schema["vec_id"].dataType.simpleString()
    sharded = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), number[F.col("dim")]))

    def index(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("vec_id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) + 0.0
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, node))
        ids, node = ids[order], node[order]
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | (node[1:] != node[:-1])
        ids, node = ids[keep], node[keep]
        g = build(distinct, top[key[0].as_py()])
        sizes = np.array([len(m) for m in g["members"]], np.int32)
        row = [key[0].as_py(), key[1].as_py(), distinct.tobytes(), ids.tolist(), node.astype(np.int32).tolist(), sizes.tobytes(), b"".join(m.tobytes() for m in g["members"]), b"".join(n.astype(np.int32).tobytes() for n in g["layers"])]
        names = ["dim", "shard", "x", "ids", "node", "sizes", "members", "layers"]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(table.schema.field("vec_id").type), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    indexes = cut(sharded.groupBy("dim", "shard").applyInArrow(index, f"dim int, shard long, x binary, ids array<{kind}>, node array<int>, sizes binary, members binary, layers binary"))
    asked = own.where(F.col("vec_id") % every == 0).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks[F.col("dim")]))
    # Each block of queries meets each shard: the stated query set against all rows.
    shards = F.sequence(F.lit(0).cast("long"), (number[F.col("dim")] - 1).cast("long"))
    queries = asked.withColumn("shard", F.explode(shards)).select("dim", "shard", "block", F.col("vec_id").alias("query_id"), "v")
    each = indexes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks[F.col("dim")] - 1).cast("long"))))

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], b.schema.field("query_id").type), "vec_id": pa.array([], b.schema.field("query_id").type), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return none
        r = a.to_pylist()[0]
        dim = r["dim"]
        x = np.frombuffer(r["x"]).reshape(-1, dim)
        ids, node = np.array(r["ids"]), np.array(r["node"])
        first = np.searchsorted(node, np.arange(len(x) + 1))
        graph, sizes = {"members": [], "layers": []}, np.frombuffer(r["sizes"], np.int32)
        flat, layers, at, to = np.frombuffer(r["members"], np.int32), np.frombuffer(r["layers"], np.int32), 0, 0
        for depth, n in enumerate(sizes.tolist()):
            degree = DEGREE if depth == 0 else DEGREE // 2
            graph["members"].append(flat[at : at + n])
            graph["layers"].append(layers[to : to + n * degree].reshape(n, degree))
            at, to = at + n, to + n * degree
        asked, q = b.column("query_id").to_numpy(), b.column("v").combine_chunks().flatten().to_numpy().reshape(b.num_rows, -1)
        out = [[], [], []]
        for c in range(0, len(q), 256):
            found = search(x, graph, q[c : c + 256], max(view, k + 1))
            i, j = np.nonzero(found >= 0)
            nodes = found[i, j]
            score = (x[nodes] * q[c + i]).sum(1)
            order = np.lexsort((-score, i))
            i, nodes, score = i[order], nodes[order], score[order]
            # ids of equal vectors: the k + 1 smallest, as one of them may be the query
            count = np.minimum(first[nodes + 1] - first[nodes], k + 1)
            run = np.repeat(np.arange(len(nodes)), count)
            place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            who, other, value = asked[c + i[run]], ids[first[nodes[run]] + place], score[run]
            keep = who != other
            who, other, value = who[keep], other[keep], value[keep]
            order = np.lexsort((other, -value, who))
            who, other, value = who[order], other[order], value[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            for z, y in zip(out, (who[keep], other[keep], value[keep]), strict=True):
                z.append(y)
        return pa.table({n: pa.array(np.concatenate(z), t) for n, z, t in zip(("query_id", "vec_id", "score"), out, none.schema.types, strict=True)})

    found = each.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block")).applyInArrow(find, f"query_id {kind}, vec_id {kind}, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
