"""Near-duplicate vectors of equal label by PCA-ordered tiled comparison.

Unit vectors are turned onto the principal axes of the whole table, so that the leading dimensions
carry most of every product. Equal vectors are one row with a count. Rows of a label are cut into tiles of bounded
size along the first axis; vectors of cosine t or more differ by at most sqrt(2 - 2t) there, so
tiles farther apart are not paired. For each pair of tiles the products of the leading dimensions
are taken first; the product of what remains is bounded by the suffix norms, and pairs whose
bound stays below the threshold go no further. Survivors are settled in double precision on the
original vectors. A pair of tiles yields counts and a forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from .arrow import summed

#: Rows of a tile, about; rows of a block of a tile compared at once; bins of the first axis.
TILE = 4096
BLOCK = 256
BINS = 4096
#: Products within this of a bound are settled exactly.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns are the principal axes of unit vectors `v` (uncentred, so that products are kept), leading first."""

    def moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                x /= np.linalg.norm(x, axis=1)[:, None]
                total += x.T @ x
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    rows = summed(vectors.select("v").mapInArrow(moment, "part int, counts binary")).collect()
    total = np.frombuffer(rows[0][1]).reshape(dim, dim) if rows else np.eye(dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def tile_links(a: dict, b: dict | None, threshold: float, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (i of a, j of b) of two tiles, or of one (i < j), block by block."""
    other = b or a
    for at in range(0, len(a["y"]), BLOCK):
        y = a["y"][at : at + BLOCK]
        # leading dimensions, then the bound by suffix norms
        bound = y[:, :lead] @ other["y"][:, :lead].T
        bound += a["rest"][at : at + BLOCK, None] * other["rest"][None, :]
        i, j = np.nonzero(bound >= threshold - SLACK)
        if b is None:
            keep = i + at < j
            i, j = i[keep], j[keep]
        for c in range(0, len(i), 65_536):  # survivors: the remaining dimensions
            p, q = i[c : c + 65_536] + at, j[c : c + 65_536]
            exact = np.einsum("nd,nd->n", a["x"][p], other["x"][q]) / (a["norm"][p] * other["norm"][q])
            hit = exact >= threshold
            if hit.any():
                yield p[hit], q[hit]


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Joins links to the forest in root; returns those that joined two trees."""
    new = []
    same = root[i] == root[j]
    for a, b in zip(i[~same].tolist(), j[~same].tolist(), strict=True):
        path = []
        while root[a] != a:
            path.append(a)
            a = int(root[a])
        root[path] = a
        path = []
        while root[b] != b:
            path.append(b)
            b = int(root[b])
        root[path] = b
        if a != b:
            root[max(a, b)] = min(a, b)
            new.append((a, b))
    return new


def _prepared(t: pa.Table, turn: np.ndarray, lead: int) -> dict:
    x = _matrix(t.column("v"))
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ turn if len(x) else x
    return {"rep": t.column("rep").to_numpy(), "n": t.column("n").to_numpy(), "x": x, "norm": norm, "y": y, "rest": np.linalg.norm(y[:, lead:], axis=1) if len(x) else norm}


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", lead: int = 16) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Only rows of equal, non-null label are compared. Null, zero and empty vectors and those with
    null or non-finite components link with nothing, nor do vectors of different lengths. Rows of
    one id and vector count once. A null id is never the class's name.
    """
    raw = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    fit = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    marked = raw.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = marked.select("vec_id", "fit", F.when(F.col("fit"), F.struct(F.col("label").cast("string").alias("label"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), F.size("v").alias("dim"))).alias("same"), F.when(F.col("fit"), F.col("v")).alias("v"))
    single = rows.where("fit").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("v").alias("v"))
    reps = cut(single.select("rep", "n", F.col("same.label").alias("label"), F.col("same.dim").alias("dim"), "same", "v"))
    dims = [r[0] for r in reps.select("dim").distinct().collect()]
    links, edges = [], []
    for dim in dims:
        one = reps.where(F.col("dim") == dim)
        a, b = _compare(one, dim, threshold, min(lead, dim))
        links.append(a)
        edges.append(b)
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    edge = edges[0]
    link = links[0]
    for a, b in zip(links[1:], edges[1:], strict=True):
        link, edge = link.unionByName(a), edge.unionByName(b)
    classes = connected_components(edge, "a", "b")
    counted = link.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("rep", "n", "same").join(counted, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "same").join(known, "same", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compare(reps: DataFrame, dim: int, threshold: float, lead: int) -> tuple[DataFrame, DataFrame]:
    turn = axes(reps, dim)
    first = turn[:, 0].tolist()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, first)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    placed = reps.withColumn("y1", dot / norm).withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("y1") + 1) / 2 * BINS))).cast("int"))
    # Tiles: runs of bins with about TILE rows; a bin with more is split by the id's hash.
    bins = placed.groupBy("label", "bin").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("label").orderBy("bin")) - F.col("c")
    bins = bins.select("label", "bin", F.floor(before / TILE).alias("run"), F.ceil(F.col("c") / (2 * TILE)).alias("split"))
    tiled = placed.join(bins, ["label", "bin"]).withColumn("tile", F.struct("run", F.when(F.col("split") > 1, F.col("bin")).otherwise(-1).alias("b"), F.pmod(F.xxhash64("rep"), F.col("split")).alias("s")))
    tiled = cut(tiled.select("label", "tile", "y1", "rep", "n", "v"))
    tiles = cut(tiled.groupBy("label", "tile").agg(F.min("y1").alias("lo"), F.max("y1").alias("hi")))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    l, r = tiles.select("label", F.col("tile").alias("ta"), F.col("lo").alias("la"), F.col("hi").alias("ha")), tiles.select(F.col("label").alias("lb"), F.col("tile").alias("tb"), F.col("lo").alias("lo_b"), F.col("hi").alias("hb"))
    pairs = l.join(r, (F.col("label") == F.col("lb")) & (F.col("ta") <= F.col("tb")) & (F.col("lo_b") <= F.col("ha") + reach) & (F.col("la") <= F.col("hb") + reach)).select("label", "ta", "tb")
    sides = pairs.select("label", F.col("ta").alias("tile"), "ta", "tb", F.lit(0).alias("side")).union(pairs.where("ta != tb").select("label", F.col("tb").alias("tile"), "ta", "tb", F.lit(1).alias("side")))
    dealt = tiled.join(sides, ["label", "tile"]).select("label", "ta", "tb", "side", "rep", "n", "v")
    given = reps.sparkSession.sparkContext.broadcast(turn)
    kind = reps.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        side = table.column("side").to_numpy()
        cut_at = int((side == 0).sum())
        a = _prepared(table.slice(0, cut_at), given.value, lead)
        b = _prepared(table.slice(cut_at), given.value, lead) if cut_at < len(side) else None
        other, shift = (b, cut_at) if b else (a, 0)
        rep = np.concatenate([a["rep"], b["rep"]]) if b else a["rep"]
        count, root, tree = np.zeros(len(rep), np.int64), np.arange(len(rep)), []
        for i, j in tile_links(a, b, threshold, lead):
            np.add.at(count, i, other["n"][j])
            np.add.at(count, j + shift, a["n"][i])
            tree += _forest(root, i, j + shift)
        linked = np.flatnonzero(count)
        ea, eb = (rep[[x for x, _ in tree]], rep[[y for _, y in tree]]) if tree else (rep[:0], rep[:0])
        return pa.table({"rep": pa.array(np.concatenate([rep[linked], ea])), "links": pa.array(np.concatenate([count[linked], np.zeros(len(ea), np.int64)])), "b": pa.array(np.concatenate([np.full(len(linked), -1), np.arange(len(ea))])), "other": pa.array(np.concatenate([rep[linked], eb]))})

    found = cut(dealt.groupBy("label", "ta", "tb").applyInArrow(run, f"rep {kind}, links long, b long, other {kind}"))
    return found.where("b < 0").select("rep", "links"), found.where("b >= 0").select(F.col("rep").alias("a"), F.col("other").alias("b"))
