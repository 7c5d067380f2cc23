"""Zonal covariates from a pixel relation (zone, value, pixel_area, ts, class)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zonal_stats(pixels: DataFrame, zone: str, value: str = "value") -> DataFrame:
    """mean, std (n), min, max and ruggedness (max - min)."""
    v = F.col(value)
    return pixels.groupBy(zone).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("ruggedness"))


def class_fractions(pixels: DataFrame, zone: str, classes: dict[str, tuple[int, int]], area: str = "pixel_area") -> DataFrame:
    """Area shares of ranges of classes; null if a zone has no area."""
    total = F.nullif(F.sum(area), F.lit(0.0))
    return pixels.groupBy(zone).agg(*[(F.sum(F.when(F.col("class").between(a, b), F.col(area)).otherwise(0.0)) / total).alias(n) for n, (a, b) in classes.items()])


def climate(pixels: DataFrame, zone: str, value: str = "value", ts: str = "ts", first: int = 5, last: int = 10) -> DataFrame:
    """Total over all years, mean of yearly totals, variation, and mean of the fire season's months."""
    yearly = pixels.groupBy(zone, F.year(ts).alias("y")).agg(F.sum(value).alias("s")).groupBy(zone).agg(F.avg("s").alias("yearly_mean"))
    season = F.avg(F.when(F.month(ts).between(first, last), F.col(value)))
    g = pixels.groupBy(zone).agg(F.sum(value).alias("total"), season.alias("season_mean"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"))
    return g.join(yearly, zone)


def vegetation(pixels: DataFrame, zone: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """Mean, and the deviation over time of monthly means."""
    m = pixels.groupBy(zone, F.date_trunc("month", F.col(ts).cast("timestamp")).alias("t")).agg(F.avg(value).alias("m")).groupBy(zone).agg(F.stddev_pop("m").alias("temporal_std"))
    return pixels.groupBy(zone).agg(F.avg(value).alias("mean")).join(m, zone)


def with_default(zones: DataFrame, found: DataFrame, zone: str, name: str, default: float) -> DataFrame:
    return zones.join(found, zone, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def synthetic(zones: DataFrame, zone: str = "zone_id", seed: int = 42) -> DataFrame:
    """Correlated stand-ins by place, seeded by the zone's own key so that reruns agree whatever the partitioning."""

    def noise(k: int):
        u = lambda j: (F.pmod(F.xxhash64(F.col(zone), F.lit(seed + 10 * k + j)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))

    e = F.greatest(F.lit(0.0), 500 + (F.col("lon") + 125) * 60 + noise(1) * 200)
    t = 25 - F.abs(F.col("lat") - 30) * 0.6 - F.col("elevation_mean") * 0.0065 + noise(2)
    p = F.greatest(F.lit(50.0), 800 + (F.col("lat") - 35) * 30 + noise(3) * 150)
    veg = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("precip_mean") / 2000 + noise(4) * 0.05))
    out = zones.withColumn("elevation_mean", e).withColumn("temperature_mean", t).withColumn("precip_mean", p).withColumn("ndvi_mean", veg)
    return out.withColumns({"evi_mean": F.col("ndvi_mean") * 0.6, "elevation_std": F.abs(noise(5)) * 100, "slope_mean": F.abs(noise(6)) * 10, "ruggedness": F.abs(noise(7)) * 300, "forest_fraction": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ndvi_mean") + noise(8) * 0.1)), "population_density": F.exp(noise(9) * 1.5 + 2), "road_distance": F.exp(noise(10) + 6)})
