"""The aggregates behind the reports and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import banded


def quantiles(df: DataFrame, column: str, levels: dict[str, float]) -> DataFrame:
    return df.agg(F.percentile(column, F.array(*map(F.lit, levels.values()))).alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(levels)])


def hsbf_bands(df: DataFrame, column: str = "hsbf") -> DataFrame:
    """Right-closed bands; zero has its own."""
    b = banded(F.col(column), [(0, "none"), (0.1, "<10%"), (0.3, "10-30%"), (0.5, "30-50%"), (0.7, "50-70%")], ">70%", right_closed=True)  # fixed values
    return df.groupBy(b.alias("band")).agg(F.count("*").alias("n"))


def hsbf_contrast(df: DataFrame) -> DataFrame:
    """Zones above 1, which cannot be, against the others."""
    return df.groupBy((F.col("hsbf") > 1).alias("above")).agg(F.count("*").alias("n"), F.percentile("area_km2", F.lit(0.5)).alias("median_area"), F.avg("hsbf").alias("mean_hsbf"))


def hsbf_worst(df: DataFrame, n: int, key: str = "zone_id") -> DataFrame:
    top = df.orderBy(F.desc("hsbf"), key).limit(n)
    return top.select(key, (F.col("hsbf") * 100).alias("hsbf_percent"), (F.col("hsbf") * F.col("area_km2")).alias("implied_area"), ((F.col("hsbf") - 1) * F.col("area_km2")).alias("discrepancy"))


def severity_counts(df: DataFrame, column: str = "hsbf") -> DataFrame:
    levels = (("severe", 0.5), ("high", 0.3), ("moderate", 0.2), ("low", 0.1))
    row = df.agg(F.count("*").alias("t"), *[F.count_if(F.col(column) > x).alias(n) for n, x in levels])
    return row.select("t", F.inline(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n, _ in levels]))).select("class", "n", (F.col("n") / F.col("t")).alias("share"))


def threshold_exceedance(df: DataFrame, thresholds: tuple[int, ...] = tuple(range(10, 101, 10))) -> DataFrame:
    """(threshold, zones with any, sum) from the n_<t>pct_burns columns, one pass."""
    row = df.agg(*[x for t in thresholds for x in (F.count_if(F.col(f"n_{t}pct_burns") > 0).alias(f"z{t}"), F.sum(f"n_{t}pct_burns").alias(f"e{t}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"z{t}").alias("zones"), F.col(f"e{t}").alias("episodes")) for t in thresholds])))


def _extent(df: DataFrame, by: str) -> DataFrame:
    w, h = F.max("x_proj") - F.min("x_proj"), F.max("y_proj") - F.min("y_proj")
    micros = lambda f: F.unix_micros(f("acq_datetime").cast("timestamp"))
    return df.groupBy(by).agg(F.count("*").alias("n"), ((micros(F.max) - micros(F.min)) / 3.6e9).alias("hours"), (F.sqrt(w * w + h * h) / 1000).alias("km"), (F.sqrt(F.var_samp("x_proj") + F.var_samp("y_proj")) / 1000).alias("spread"))


def cluster_statistics(df: DataFrame, by: str) -> DataFrame:
    """Sizes, time spans and extents of all clusters."""
    e = _extent(df, by)
    return e.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_size"), F.stddev_samp("n").alias("std_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.percentile("n", F.lit(0.9)).alias("p90_size"), F.avg("hours").alias("mean_hours"), F.stddev_pop("hours").alias("std_hours"), F.max("hours").alias("max_hours"), F.avg("km").alias("mean_km"), F.max("km").alias("max_km"))


def quality_rules(df: DataFrame, by: str, max_days: float = 365, max_spread_km: float = 100, max_kmh: float = 50) -> DataFrame:
    """How many clusters last too long, are too wide or spread too fast, and the share of those that do none."""
    days = F.floor(F.col("hours") / 24)
    long = days > max_days
    wide = F.coalesce(F.col("spread") > max_spread_km, F.lit(False))
    fast = F.coalesce((F.col("n") > 5) & (F.try_divide(F.col("km"), days * 24) > max_kmh), F.lit(False))  # whole days, none under one
    return _extent(df, by).agg(F.count("*").alias("clusters"), F.count_if(long).alias("too_long"), F.count_if(wide).alias("too_wide"), F.count_if(fast).alias("too_fast"), (1 - F.try_divide(F.count_if(long | wide | fast), F.count("*"))).alias("quality_ratio"))


def quality_bands(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c > 0.8).alias("high"), F.count_if((c > 0.5) & (c <= 0.8)).alias("medium"), F.count_if(c <= 0.5).alias("low"))


def dominance(df: DataFrame, ratio: str = "day_night_ratio") -> DataFrame:
    r = F.col(ratio)
    return df.agg(F.count_if(r > 0.6).alias("day"), F.count_if(r < 0.4).alias("night"), F.count_if(r.between(0.4, 0.6)).alias("mixed"))


def validation_summary(episodes: DataFrame) -> DataFrame:
    """Means, and the verdicts drawn from them."""
    m = episodes.agg(F.avg("mean_confidence").alias("confidence"), F.avg("spatial_coherence_score").alias("coherence"), F.avg("detection_consistency").alias("consistency"), F.avg(F.when(F.col("is_valid"), 0.0).otherwise(1.0)).alias("invalid_ratio"))
    say = lambda c, yes, no: F.when(c, yes).otherwise(no)
    return m.withColumns({"confidence_says": say(F.col("confidence") > 75, "high confidence", "low confidence"), "coherence_says": say(F.col("coherence") > 0.7, "coherent", "scattered"), "consistency_says": say(F.col("consistency") > 0.5, "consistent", "irregular"), "validity_says": say(F.col("invalid_ratio") > 0.3, "many invalid", "mostly valid")})


def adaptive_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin: 0 for none, then equal integer steps up to the largest value."""
    top = df.agg(F.max(column).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("bin", F.when(F.col(column) == 0, 0).otherwise(1 + F.floor((F.col(column) - 1) * bins / F.col("_top")))).drop("_top")  # one row


def summary(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count("*").alias("episodes"), F.sum("n_detections").alias("detections"), F.round(F.avg("n_detections"), 6).alias("mean_size"), F.round(F.sum("total_frp"), 4).alias("total_frp"), F.round(F.avg("unique_days"), 6).alias("mean_days"))


def episode_statistics(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, min, median, max) in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    return episodes.agg(F.array(*parts).alias("z")).select(F.inline("z"))
