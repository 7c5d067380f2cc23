"""Range joins by cells: each point meets only the points of neighbouring cells of the widths' grid."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eps_pairs(df: DataFrame, widths: dict[str, float], within: Column, key: str = "point_id", same: tuple[str, ...] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """(src, dst) with src < dst, equal `same` columns and `within`, an expression over a.<col> and b.<col>, and the columns of `also`.

    widths: for each column the distance beyond which `within` never holds. One side is repeated in
    the neighbouring cells of which it is the smaller: half of them, so that each pair of cells is
    joined once. An equi-join on the cell, so it shuffles, spills and is split by the engine when a cell is hot.
    """
    names = [key, *widths, *same]
    cells = {f"_c{i}": F.floor(F.col(c).cast("double") / w).cast("long") for i, (c, w) in enumerate(widths.items())}
    points = df.select(*dict.fromkeys([*names, *_columns(df, names)])).withColumns(cells)
    n = len(widths)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=n) if o >= (0,) * n]
    shift = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in offsets]))
    a = points.withColumn("_o", shift)
    a = a.withColumns({f"_c{i}": F.col(f"_c{i}") + F.col(f"_o.o{i}") for i in range(n)}).withColumn("_own", F.lit(True) & _zero(n)).drop("_o").alias("a")
    b = points.alias("b")
    equal = [F.col(f"a._c{i}") == F.col(f"b._c{i}") for i in range(n)] + [F.col(f"a.{s}") == F.col(f"b.{s}") for s in same]
    joined = a.join(b, equal)
    once = ~F.col("a._own") | (F.col(f"a.{key}") < F.col(f"b.{key}"))
    hit = joined.where(once & (F.col(f"a.{key}") != F.col(f"b.{key}")) & within)
    return hit.select(F.least(f"a.{key}", f"b.{key}").alias("src"), F.greatest(f"a.{key}", f"b.{key}").alias("dst"), *[c.alias(n) for n, c in (also or {}).items()])


def _zero(n: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        out = out & (F.col(f"_o.o{i}") == 0)
    return out


def _columns(df: DataFrame, taken: list[str]) -> list[str]:
    return [c for c in df.columns if c not in taken]


def gap(c: str) -> Column:
    return F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))


def distance(x: str = "x_proj", y: str = "y_proj") -> Column:
    dx, dy = gap(x), gap(y)
    return F.sqrt(dx * dx + dy * dy)


def box_pairs(left: DataFrame, right: DataFrame, cell: float, left_key: str, right_key: str) -> DataFrame:
    """Pairs of boxes (minx, miny, maxx, maxy) that touch: both are dealt to the cells they cover, pairs count once.

    A pair is kept in the one cell that holds the corner of its common part, so no distinct is needed.
    """

    def dealt(df: DataFrame, key: str, side: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        one = df.select(F.col(key).alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key])
        return one.withColumn("cx", span(f"{side}_minx", f"{side}_maxx")).withColumn("cy", span(f"{side}_miny", f"{side}_maxy"))

    j = dealt(left, left_key, "l").join(dealt(right, right_key, "r"), ["cx", "cy"])
    touch = (F.col("l_minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy"))
    home = (F.floor(F.greatest("l_minx", "r_minx") / cell) == F.col("cx")) & (F.floor(F.greatest("l_miny", "r_miny") / cell) == F.col("cy"))
    return j.where(touch & home).drop("cx", "cy")
