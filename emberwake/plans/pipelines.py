"""The three pipelines over detections and zones, each stage a table that is resumed if it is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clean, dbscan, episodes, features, models, regimes, score
from ..sources import io


def pipeline_a(spark: SparkSession, raw: DataFrame, zones: DataFrame, root: str, cfg: Config = Config()) -> dict[str, DataFrame]:
    """Detections to prepared points, clusters, episodes (variant A) and zone metrics. zones(huc12, polygons) in lon/lat."""
    points = io.stage(spark, root, "prepared", lambda: clean.prepare(raw, cfg.quality, cfg.region))

    def label() -> DataFrame:
        pairs = dbscan.near_combined(points, cfg.clustering.eps_km, cfg.clustering.eps_days)
        found = dbscan.drop_small(dbscan.dbscan(points, pairs, cfg.clustering.min_samples), max(cfg.clustering.min_samples, cfg.clustering.drop_below))
        return dbscan.renumber(found, points)

    labels = io.stage(spark, root, "labels", label)
    clustered = points.join(labels.where("cluster_id >= 0"), "point_id")
    found = io.stage(spark, root, "episodes", lambda: episodes.episodes_a(clustered, "cluster_id", cfg.episodes))

    def overlay() -> DataFrame:
        b = F.col("bounding_box")
        corner = lambda x, y: F.array(b[x], b[y])
        box = found.select(F.col("cluster_id").alias("episode_id"), F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3)).alias("ring"))
        return regimes.overlay_polygons(box, zones, 0.25)

    pairs = io.stage(spark, root, "overlay", overlay)
    areas = io.zone_areas(zones).select("huc12", "area_km2")
    metrics = io.stage(spark, root, "zones", lambda: regimes.zone_metrics_a(pairs, found.withColumnRenamed("cluster_id", "episode_id"), areas))
    return {"points": points, "labels": labels, "episodes": found, "overlay": pairs, "zones": metrics}


def pipeline_b(spark: SparkSession, raw: DataFrame, zones: DataFrame, root: str, cfg: Config = Config()) -> dict[str, DataFrame]:
    """The speed-constrained detector, buffered hulls, zone metrics of variant B."""
    c = cfg.clustering
    points = io.stage(spark, root, "prepared", lambda: clean.derive(clean.qc_filter(clean.bbox_filter(raw, cfg.region), cfg.quality)))

    def label() -> DataFrame:
        pairs = dbscan.near_speed(points, c.speed_eps_m, c.speed_eps_days, c.max_kmh)
        return dbscan.renumber(dbscan.quality_drop(dbscan.dbscan(points, pairs, c.min_samples), points, 2, c.speed_eps_m), points)

    labels = io.stage(spark, root, "labels", label)
    clustered = points.join(labels.where("cluster_id >= 0"), "point_id").withColumnRenamed("cluster_id", "episode_id")
    found = io.stage(spark, root, "episodes", lambda: episodes.episodes_b(clustered, "episode_id"))
    pairs = io.stage(spark, root, "overlay", lambda: regimes.overlay_polygons(found.select("episode_id", "ring"), zones, 0.25))
    areas = io.zone_areas(zones).select("huc12", "area_km2")
    metrics = io.stage(spark, root, "zones", lambda: regimes.zone_metrics_b(pairs, found.drop("ring", "area_km2"), areas))
    return {"points": points, "labels": labels, "episodes": found, "overlay": pairs, "zones": metrics}


def pipeline_c(spark: SparkSession, zones: DataFrame, root: str, names: list[str], key: str = "huc12", ks: tuple[int, ...] = (3, 4, 5), algorithms: tuple[str, ...] = ("kmeans", "gmm_diag", "bisecting")) -> dict[str, DataFrame]:
    """Zones with fire to scaled features, a suite of clusterings, the best run and profiles of its classes."""
    burned = zones.where("episode_count > 0")
    kept = features.drop_constant(burned, names)
    ready = features.robust_scale(features.median_impute(burned, kept), kept)
    points = io.stage(spark, root, "features", lambda: ready.select(F.col(key).alias("key"), F.array(*[F.col(n).cast("double") for n in kept]).alias("features")))
    runs = io.stage(spark, root, "runs", lambda: models.suite(points, ks, algorithms))
    best = score.select_best(runs).first()
    if best is None:
        return {"features": points, "runs": runs}
    name, _, k = best["run_id"].partition("-")
    labels = io.stage(spark, root, "labels", lambda: models.RUNNERS[name](points, int(k)) if k else models.RUNNERS[name](points))
    joined = burned.join(labels.withColumnRenamed("key", key), key)
    return {"features": points, "runs": runs, "labels": labels, "profiles": score.profile(joined, "label", kept), "anova": score.anova(joined, "label", kept)}
