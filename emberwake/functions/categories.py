"""Scalar categories and derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(x: Column, edges: list[tuple[float, str]], last: str, right_closed: bool = False, null: str | None = None) -> Column:
    """The name of the first band whose upper edge is above x (or at x, if right-closed), else `last`; `null` for null and NaN."""
    missing = x.isNull() | F.isnan(x.cast("double"))
    out = F.when(missing, F.lit(null))
    for edge, name in edges:
        out = out.when(x <= edge if right_closed else x < edge, name)
    return out.otherwise(last)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Fall")


def confidence_category(c: Column) -> Column:
    # fixed values
    return banded(c, [(30, "Very Low (<30%)"), (60, "Low (30-59%)"), (80, "Medium (60-79%)")], "High (≥80%)", null="Unknown")


def size_category(area: Column) -> Column:
    # fixed values
    return banded(area, [(10, "Very Small (<10 km²)"), (50, "Small (10-50 km²)"), (200, "Medium (50-200 km²)"), (500, "Large (200-500 km²)")], "Very Large (>500 km²)")


def region_category(lon: Column) -> Column:
    # fixed values
    return banded(lon, [(-120, "West Coast"), (-110, "Mountain West"), (-100, "Central West")], "Great Plains")


def fire_strata(n: Column) -> Column:
    # fixed values
    return banded(n, [(0, "No Fire"), (5, "Rare Fire"), (20, "Occasional Fire"), (50, "Frequent Fire")], "Very Frequent Fire", right_closed=True)


def acq_datetime(date: Column, hhmm: Column) -> Column:
    """Date and unpadded HHMM; null if they make no time."""
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("date").cast("string"), F.lpad(F.trim(hhmm.cast("string")), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def number(x: Column) -> Column:
    """Double, or null if it is no number or NaN."""
    return F.nullif(x.try_cast("double"), F.lit(float("nan")))


def decimals(text: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.length(F.split_part(text, F.lit("."), F.lit(2)))


def half_even(x: Column, digits: int) -> Column:
    """Rounds the scaled double to the even neighbour on ties, as numpy does."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def compactness(area: Column, perimeter: Column) -> Column:
    return F.try_divide(4 * F.pi() * area, perimeter * perimeter)


def shape_index(area: Column, perimeter: Column) -> Column:
    return F.try_divide(perimeter, 2 * F.sqrt(F.pi() * area))


def regime_name_b(frequency: Column, area: Column, frp: Column) -> Column:
    """Name by mean episodes, mean burned area and mean intensity, such as `Low-Frequency Small-High-Intensity`. Fixed values."""
    return F.concat(
        banded(frequency, [(5, "Low"), (15, "Moderate")], "High"),
        F.lit("-Frequency "),
        banded(area, [(10, "Small"), (50, "Medium")], "Large"),
        F.lit("-"),
        banded(frp, [(50, "Low-Intensity"), (100, "Moderate-Intensity")], "High-Intensity"),
    )


def regime_name_c(episodes: Column, hsbf: Column, frp: Column, area: Column) -> Column:
    """Name by frequency, impact, size and intensity, such as `Rare_Low-Impact_Small_High-Intensity`. Fixed values."""
    return F.concat_ws(
        "_",
        banded(episodes, [(3, "Rare"), (10, "Occasional"), (25, "Frequent")], "Very-Frequent"),
        banded(hsbf, [(0.05, "Minimal-Impact"), (0.15, "Low-Impact"), (0.30, "Moderate-Impact"), (0.50, "High-Impact")], "Extreme-Impact"),
        banded(area, [(5, "Small"), (20, "Medium")], "Large"),
        banded(frp, [(30, "Low-Intensity"), (70, "Moderate-Intensity")], "High-Intensity"),
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def ring_sum(ring: Column, term) -> Column:
    """Sum over the edges of a closed ring (array of struct x, y) of term(x0, y0, x1, y1)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: term(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    return F.abs(ring_sum(ring, lambda x0, y0, x1, y1: x0 * y1 - x1 * y0)) / 2


def ring_perimeter(ring: Column) -> Column:
    return ring_sum(ring, lambda x0, y0, x1, y1: F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    cross = lambda x0, y0, x1, y1: x0 * y1 - x1 * y0
    twice = ring_sum(ring, cross)
    cx = ring_sum(ring, lambda x0, y0, x1, y1: (x0 + x1) * cross(x0, y0, x1, y1))
    cy = ring_sum(ring, lambda x0, y0, x1, y1: (y0 + y1) * cross(x0, y0, x1, y1))
    return F.try_divide(cx, 3 * twice), F.try_divide(cy, 3 * twice)


def polygon_area(rings: Column) -> Column:
    """First ring less the others."""
    return F.aggregate(F.transform(rings, ring_area), F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("a")), lambda s, v: F.struct((s["i"] + 1).alias("i"), F.when(s["i"] == 0, v).otherwise(s["a"] - v).alias("a")), lambda s: s["a"])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
