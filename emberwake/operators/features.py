"""Feature preparation: strata, imputing, scaling. All statistics are exact aggregates of one row, joined by broadcast of that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_stats(df: DataFrame, stats: list[Column]) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def drop_constant(df: DataFrame, names: list[str]) -> list[str]:
    """The names that have more than one distinct non-null value."""
    row = df.agg(*[F.count_distinct(F.nullif(F.col(n).cast("double"), F.lit(float("nan")))).alias(n) for n in names]).first()
    return [n for n in names if row[n] > 1]


def median_impute(df: DataFrame, names: list[str]) -> DataFrame:
    """Null, NaN and infinite values take the exact median."""
    fine = lambda n: F.when(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), None).otherwise(F.col(n)).cast("double")
    clean = df.withColumns({n: fine(n) for n in names})
    out = _with_stats(clean, [F.percentile(n, F.lit(0.5)).alias(f"_{n}") for n in names])
    return out.withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])


def standard_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / std over n; a zero std counts as 1."""
    out = _with_stats(df, [s for n in names for s in (F.avg(n).alias(f"_m{n}"), F.stddev_pop(n).alias(f"_s{n}"))])
    scaled = {n: (F.col(n) - F.col(f"_m{n}")) / F.when(F.col(f"_s{n}") == 0, 1.0).otherwise(F.col(f"_s{n}")) for n in names}
    return out.withColumns(scaled).drop(*[p + n for n in names for p in ("_m", "_s")])


def robust_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - median) / interquartile range; a zero range counts as 1."""
    out = _with_stats(df, [F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{n}") for n in names])
    iqr = lambda n: F.col(f"_{n}")[2] - F.col(f"_{n}")[0]
    return out.withColumns({n: (F.col(n) - F.col(f"_{n}")[1]) / F.when(iqr(n) == 0, 1.0).otherwise(iqr(n)) for n in names}).drop(*[f"_{n}" for n in names])


def log_robust(df: DataFrame, names: list[str], logged: list[str]) -> DataFrame:
    return robust_scale(df.withColumns({n: F.log1p(F.greatest(F.col(n), F.lit(0.0))) for n in logged}), names)


def minmax(df: DataFrame, names: list[str], tiny: float = 0.0) -> DataFrame:
    out = _with_stats(df, [s for n in names for s in (F.min(n).alias(f"_l{n}"), F.max(n).alias(f"_h{n}"))])
    return out.withColumns({n: F.try_divide(F.col(n) - F.col(f"_l{n}"), F.col(f"_h{n}") - F.col(f"_l{n}") + tiny) for n in names}).drop(*[p + n for n in names for p in ("_l", "_h")])


def quantile_uniform(df: DataFrame, name: str, key: str, points: int = 1000) -> DataFrame:
    """Rank-interpolated quantiles in 0..1 from at most `points` exact reference quantiles; ties take the middle of their range."""
    n = min(points, max(2, df.where(F.col(name).isNotNull()).count()))
    levels = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
    out = _with_stats(df, [F.percentile(name, levels).alias("_q")])
    x = F.col(name)
    # Last reference at or below x, first at or above it.
    below = F.aggregate("_q", F.lit(0), lambda s, q: s + F.when(q < x, 1).otherwise(0))
    upto = F.aggregate("_q", F.lit(0), lambda s, q: s + F.when(q <= x, 1).otherwise(0))
    lo, hi = F.element_at("_q", F.greatest(F.lit(1), F.col("_b"))), F.element_at("_q", F.least(F.lit(n), F.col("_b") + 1))
    middle = (F.col("_b") + F.col("_u") - 1) / 2 / (n - 1)
    between = (F.col("_b") - 1 + F.try_divide(x - lo, hi - lo)) / (n - 1)
    return out.withColumn("_b", below).withColumn("_u", upto).select(key, F.when(F.col("_u") > F.col("_b"), middle).otherwise(between).alias(name))


def qcut_strata(df: DataFrame, name: str, levels: list[float], labels: list[str]) -> DataFrame:
    """Names by exact quantiles, upper edge inside; equal edges collapse to the first."""
    out = _with_stats(df, [F.percentile(name, F.array(*[F.lit(x) for x in levels[1:-1]])).alias("_q")])
    c = F.when(F.col(name).isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1]):
        c = c.when(F.col(name) <= F.col("_q")[i], label)
    return out.withColumn("stratum", c.otherwise(labels[-1])).drop("_q")


def derived(df: DataFrame) -> DataFrame:
    """Complexity, pressure and a proxy of severity."""
    return df.withColumns({"fire_complexity": F.col("fire_size_cv") * F.col("seasonality_index"), "fire_pressure": F.log1p("episode_count") * F.log1p("mean_frp"), "burn_severity_proxy": F.col("hsbf") * F.log1p("max_frp")})


def composite_risk(df: DataFrame, count: str, hsbf: str, severity: str, energy: str) -> DataFrame:
    """Weighted sum of shares of the maxima, and its five right-closed classes."""
    out = _with_stats(df, [F.max(c).alias(f"_{c}") for c in (count, severity, energy)])
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0))
    risk = 0.2 * part(count) + 0.3 * F.col(hsbf) + 0.25 * part(severity) + 0.25 * part(energy)
    out = out.withColumn("risk", risk)
    r = F.col("risk")
    return out.withColumn("risk_class", F.when(r <= 0, None).when(r <= 0.2, "Very Low").when(r <= 0.4, "Low").when(r <= 0.6, "Moderate").when(r <= 0.8, "High").otherwise("Very High")).drop(*[f"_{c}" for c in (count, severity, energy)])
