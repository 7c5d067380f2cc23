"""Profiles of tables: describe, shares, histograms, completeness, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.categories import half_even


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std (n - 1), min, exact quartiles, max; NaN counts as null."""
    x = F.nullif(F.col(column).cast("double"), F.lit(float("nan")))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"))
    return out.select(*(by or []), "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def counts(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of all rows."""
    n = counts(df, by)
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def pivot_counts(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def repeats(df: DataFrame, *by: Column) -> DataFrame:
    """Groups with more than one row."""
    return counts(df, *by).where("n > 1")


def count_histogram(df: DataFrame, *by: Column) -> DataFrame:
    """How many groups have n rows."""
    return counts(df, *by).groupBy("n").agg(F.count("*").alias("groups"))


def completeness(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, non_null, nulls, percent), one pass over the table."""
    parts = [x for n in names for x in (F.lit(n), F.count(F.nullif(F.col(n), F.lit(float("nan"))) if dict(df.dtypes)[n] in ("double", "float") else F.col(n)))]
    row = df.agg(F.count("*").alias("rows"), F.map_from_arrays(F.array(*parts[::2]), F.array(*parts[1::2])).alias("m"))
    return row.select("rows", F.explode("m").alias("name", "non_null")).select("name", "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"), (F.try_divide(F.col("non_null"), F.col("rows")) * 100).alias("percent"))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) of all pairs a <= b in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("z"))
    return row.select(F.inline("z"))


def most_common(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The value of each group that occurs most, the smallest among equals."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(column).alias("value"), F.col("n").alias("n")), F.struct(F.col("n").alias("n"), (-F.col(column)).alias("o")))
    return n.groupBy(*by).agg(best.alias("b")).select(*by, "b.value", "b.n")


def grid_daily_rollup(df: DataFrame, lat: str = "latitude", lon: str = "longitude", digits: int = 2) -> DataFrame:
    """Cells of rounded place (half to even) by day: counts, confidence, intensity, brightness, day/night, satellites, times."""
    return df.groupBy(half_even(F.col(lat), digits).alias("cell_lat"), half_even(F.col(lon), digits).alias("cell_lon"), F.col("acq_date")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp"), F.sum("frp").alias("sum_frp"),
        F.avg("brightness").alias("mean_brightness"), F.max("brightness").alias("max_brightness"), F.count_distinct("daynight").alias("n_daynight"),
        F.concat_ws(",", F.sort_array(F.collect_set("satellite"))).alias("satellites"), F.min("acq_datetime").alias("first_time"), F.max("acq_datetime").alias("last_time"),
    )


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_of_tops(df: DataFrame, key: str, orders: list[Column], each: int, total: int) -> DataFrame:
    """The first rows by several orders, without repeats, in that order, filled up by the key's hash to `total`."""
    parts = [df.orderBy(o, F.col(key)).limit(each).select(key, F.lit(i).alias("o"), F.row_number().over(W.orderBy(o, F.col(key))).alias("r")) for i, o in enumerate(orders)]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.union(p)
    picked = picked.groupBy(key).agg(F.min(F.struct("o", "r")).alias("place"))
    rest = df.join(picked, key, "left_anti").orderBy(F.col(key) * 7919 % 1000, F.col(key)).limit(total).select(key, F.struct(F.lit(len(orders)).alias("o"), F.row_number().over(W.orderBy(F.col(key) * 7919 % 1000, F.col(key))).alias("r")).alias("place"))
    return picked.union(rest).orderBy("place").limit(total).select(key, "place.o", "place.r")
