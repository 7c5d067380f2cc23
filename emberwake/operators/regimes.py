"""Overlay of episodes with zones, and metrics of each zone, both variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import projection as proj
from .pairs import box_pairs

YEAR = 365.0
#: Shares of a zone that an episode burns, in percent.
THRESHOLDS = tuple(range(10, 101, 10))


def overlay_rectangles(episodes: DataFrame, zones: DataFrame, cell: float, episode: str = "episode_id", zone: str = "huc12", scale: float = 1e6) -> DataFrame:
    """Pairs of boxes (minx, miny, maxx, maxy) with their common area; only areas above 0."""
    j = box_pairs(episodes, zones, cell, episode, zone)
    w = F.least("l_maxx", "r_maxx") - F.greatest("l_minx", "r_minx")
    h = F.least("l_maxy", "r_maxy") - F.greatest("l_miny", "r_miny")
    return j.select(F.col("l_key").alias(episode), F.col("r_key").alias(zone), (w * h / scale).alias("intersection_area_km2")).where("intersection_area_km2 > 0")


def overlay_polygons(episodes: DataFrame, zones: DataFrame, cell: float, episode: str = "episode_id", zone: str = "huc12", degrees: bool = True) -> DataFrame:
    """Pairs of a convex episode `ring` and a zone's `polygons` with their common area in km2, by clipping.

    Both are dealt by their bounding boxes; exact areas come from the kernel. With degrees, parts are projected before
    their area is taken; else coordinates are metres.
    """
    box = lambda xs, ys: [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]
    e = episodes.select(episode, "ring", *box(F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])))
    points = F.flatten(F.flatten("polygons"))
    z = zones.select(zone, "polygons", *box(F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])))
    pairs = box_pairs(e, z, cell, episode, zone).select("l_key", "r_key", "l_ring", "r_polygons")
    lk, rk = (pairs.schema[c].dataType.simpleString() for c in ("l_key", "r_key"))
    project = proj.project_arrays if degrees else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [kernels.clipped_area(p, np.array(r, float), project) / 1e6 for r, p in zip(b.column("l_ring").to_pylist(), b.column("r_polygons").to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(a, pa.float64())], [episode, zone, "intersection_area_km2"])

    return pairs.mapInArrow(cut, f"{episode} {lk}, {zone} {rk}, intersection_area_km2 double").where("intersection_area_km2 > 0")


def return_interval(start: str = "start_date") -> Column:
    """Mean gap of consecutive starts in years of 365 days; null with fewer than two."""
    span = F.datediff(F.max(start), F.min(start))
    return F.when(F.count(start) > 1, span / (F.count(start) - 1) / YEAR)


def month_counts(start: str = "start_date") -> list[Column]:
    return [F.count_if(F.month(start) == m) for m in range(1, 13)]


def peak_month(start: str = "start_date") -> Column:
    """The month of most starts, the first among equals."""
    counts = F.array(*month_counts(start))
    return F.array_position(counts, F.array_max(counts)).cast("int")


def seasonality(start: str = "start_date") -> Column:
    """Coefficient of variation (n - 1) of the twelve monthly counts, over 3.46, at most 1; 0 with under three starts."""
    c = month_counts(start)
    squares = sum((x * x for x in c[1:]), c[0] * c[0])
    n = F.count(start)
    mean = n / 12
    std = F.sqrt((squares - 12 * mean * mean) / 11)
    return F.when(n >= 3, F.least(F.lit(1.0), std / mean / 3.46)).otherwise(0.0)


def zone_metrics_a(pairs: DataFrame, episodes: DataFrame, zones: DataFrame, zone: str = "huc12", episode: str = "episode_id") -> DataFrame:
    """Variant A: all zones, zero-filled. zones(huc12, area_km2); a degenerate hull gives a share of 0."""
    p95 = episodes.agg(F.percentile("peak_frp", F.lit(0.95)).alias("p95"))
    j = pairs.join(episodes, episode).join(zones.select(zone, F.col("area_km2").alias("zone_km2")), zone).crossJoin(F.broadcast(p95))  # one row
    share = F.coalesce(F.try_divide("intersection_area_km2", F.when(F.col("area_km2") > 0, F.col("area_km2"))), F.lit(0.0))
    j = j.withColumn("share", share)
    burned = F.col("intersection_area_km2") / F.col("zone_km2") * 100
    g = j.groupBy(zone).agg(
        F.count("*").alias("episode_count"), F.sum(F.col("total_energy_mwh") * F.col("share")).alias("total_energy_mwh"), F.sum("intersection_area_km2").alias("total_burned_area_km2"), F.max("intersection_area_km2").alias("max_episode_area_km2"),
        F.avg("duration_days").alias("mean_episode_duration"), F.max("duration_days").alias("max_episode_duration"), F.sum("active_days").alias("total_fire_days"), F.max("peak_frp").alias("watershed_peak_frp"), F.avg("mean_frp").alias("watershed_mean_frp"),
        F.sum(F.col("detection_count") * F.col("share")).alias("total_detections"), F.avg("day_night_ratio").alias("mean_day_activity"), F.avg("persistence_score").alias("mean_persistence"),
        *[F.count_if(burned > t).alias(f"n_{t}pct_burns") for t in THRESHOLDS], F.count_if(F.col("peak_frp") > F.col("p95")).alias("n_high_severity"),
    )
    out = zones.select(zone, "area_km2").join(g, zone, "left").na.fill(0)
    return out.withColumn("hsbf", F.least(F.lit(1.0), F.coalesce(F.try_divide("max_episode_area_km2", "area_km2"), F.lit(0.0))))


def zone_metrics_b(pairs: DataFrame, episodes: DataFrame, zones: DataFrame, zone: str = "huc12", episode: str = "episode_id") -> DataFrame:
    """Variant B: all zones; counts and sums zero-filled, the return interval stays null where there is none."""
    j = pairs.join(episodes, episode)
    q90 = j.groupBy(zone).agg(F.percentile("max_frp", F.lit(0.9)).alias("q90"))
    high = j.select(zone, "max_frp").join(q90, zone).groupBy(zone).agg(F.count_if(F.col("max_frp") > F.col("q90")).alias("high_intensity_count"))
    a = "intersection_area_km2"
    g = j.groupBy(zone).agg(
        F.count("*").alias("episode_count"), F.sum("n_detections").alias("total_detections"), F.sum(a).alias("total_burned_area"), F.max(a).alias("max_burned_area"), F.avg(a).alias("mean_burned_area"),
        F.sum("total_frp").alias("total_frp"), F.max("max_frp").alias("max_frp"), F.avg("mean_frp").alias("mean_frp"), F.sum("duration_days").alias("total_duration"), F.max("duration_days").alias("max_duration"), F.avg("duration_days").alias("mean_duration"),
        return_interval().alias("fire_return_interval_years"), peak_month().alias("peak_fire_month"), seasonality().alias("seasonality_index"),
        (F.sum("day_detections") / F.greatest(F.lit(1), F.sum("n_detections"))).alias("day_detection_ratio"), F.coalesce(F.stddev_samp(a) / F.greatest(F.lit(0.001), F.avg(a)), F.lit(0.0)).alias("fire_size_cv"),
    ).join(high, zone)
    out = zones.select(zone, "area_km2").join(g, zone, "left")
    filled = [c for c in out.columns if c not in (zone, "fire_return_interval_years")]
    out = out.na.fill(0, filled)
    return out.withColumns({"area_burned_fraction": F.least(F.lit(1.0), F.coalesce(F.try_divide("total_burned_area", "area_km2"), F.lit(0.0))), "hsbf": F.least(F.lit(1.0), F.coalesce(F.try_divide("max_burned_area", "area_km2"), F.lit(0.0)))})


def active_on_dates(episodes: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(day, active): episodes active on each day from the first start on. By steps: +1 at the start, -1 after the end."""
    first = episodes.agg(F.min(F.to_date(start)).alias("lo"), F.max(F.to_date(end)).alias("hi"))
    spine = first.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    spans = episodes.select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day")).groupBy("day").agg(F.count("*").alias("active"))
    return spine.join(spans, "day", "left").na.fill(0)
