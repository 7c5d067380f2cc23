"""Episode records, both variants. `by` names the cluster column; all rows are clustered ones.

Each block of metrics is its own relation on `by`, from one or two aggregates; only the hull needs
an Arrow kernel, and it gets the hulls of parts first, so that no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Episodes
from ..functions import kernels
from ..functions import projection as proj


def _hours(a, b):
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(3.6e9)


def temporal(df: DataFrame, by: str, dormancy_days: int = 2) -> DataFrame:
    """Start, end, durations, active days, gaps of days, detections a day, consistency."""
    span = df.groupBy(by).agg(F.min("acq_datetime").alias("start_datetime"), F.max("acq_datetime").alias("end_datetime"))
    daily = df.groupBy(by, "acq_date").agg(F.count("*").alias("n"))
    step = daily.withColumn("gap", F.datediff("acq_date", F.lag("acq_date").over(W.partitionBy(by).orderBy("acq_date"))))
    day = step.groupBy(by).agg(F.count("*").alias("active_days"), F.count_if(F.col("gap") > dormancy_days).alias("dormancy_periods"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_dormancy_days"), F.avg("n").alias("mean_daily_detections"), F.max("n").alias("max_daily_detections"))
    hours = _hours(F.col("start_datetime"), F.col("end_datetime"))
    return span.join(day, by).withColumns({"duration_hours": hours, "duration_days": hours / 24, "detection_consistency": F.col("active_days") / (F.floor(hours / 24) + 1)})


def spatial(df: DataFrame, by: str) -> DataFrame:
    """Centre, bounds, box sizes and perimeter."""
    g = df.groupBy(by).agg(F.avg("x_proj").alias("cx"), F.avg("y_proj").alias("cy"), *[f(c).alias(n) for c, lo, hi in (("longitude", "west", "east"), ("latitude", "south", "north"), ("x_proj", "x0", "x1"), ("y_proj", "y0", "y1")) for f, n in ((F.min, lo), (F.max, hi))])
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return g.select(by, proj.to_lon(F.col("cx")).alias("centroid_lon"), proj.to_lat(F.col("cy")).alias("centroid_lat"), F.array("west", "south", "east", "north").alias("bounding_box"), (w / 1000).alias("bbox_width_km"), (h / 1000).alias("bbox_height_km"), ((w + h) * 2 / 1000).alias("perimeter_km"))


def hulls(df: DataFrame, by: str, x: str = "x_proj", y: str = "y_proj") -> DataFrame:
    """(by, n, ring): convex hull of each group as array of (x, y). Hulls of each task's rows first, then of those."""
    kind = df.schema[by].dataType.simpleString()
    shape = f"{by} {kind}, xs array<double>, ys array<double>, n long"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, place = np.unique(np.array(b.column(0).to_pylist()), return_inverse=True)
            xy = np.stack([b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)], 1)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(len(keys) + 1))
            rings = [kernels.hull(xy[order[cuts[i] : cuts[i + 1]]]) for i in range(len(keys))]
            yield pa.record_batch([pa.array(keys.tolist(), b.schema.field(0).type), pa.array([r[:, 0] for r in rings], pa.list_(pa.float64())), pa.array([r[:, 1] for r in rings], pa.list_(pa.float64())), pa.array(np.diff(cuts), pa.int64())], [by, "xs", "ys", "n"])

    def whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy, n, kind = np.zeros((0, 2)), 0, None
        for b in batches:
            kind = b.schema.field(0).type
            x = [b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2)]
            xy = kernels.hull(np.concatenate([xy, np.stack(x, 1)]))
            n += int(np.sum(b.column(3).to_numpy()))
        yield pa.record_batch([pa.array([key[0].as_py()], kind), pa.array([xy[:, 0]], pa.list_(pa.float64())), pa.array([xy[:, 1]], pa.list_(pa.float64())), pa.array([n], pa.int64())], [by, "xs", "ys", "n"])

    return df.where(F.col(by).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double"), F.col(y).cast("double")).mapInArrow(parts, shape).groupBy(by).applyInArrow(whole, shape)


def hull_metrics(df: DataFrame, by: str) -> DataFrame:
    """Hull area in km2 (0 if degenerate), elongation, largest spread in km."""
    rings = hulls(df, by)
    kind = df.schema[by].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [np.stack([np.array(x), np.array(y)], 1) for x, y in zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array([kernels.area(x) / 1e6 for x in r], pa.float64()), pa.array([kernels.elongation(x) for x in r], pa.float64()), pa.array([kernels.diameter(x) / 1000 for x in r], pa.float64())], [by, "area_km2", "shape_elongation", "max_spread_km"])

    return rings.mapInArrow(measure, f"{by} {kind}, area_km2 double, shape_elongation double, max_spread_km double")


def spread(df: DataFrame, by: str, key: str = "point_id") -> DataFrame:
    """Direction (degrees from north, circular mean) and rates (km/h) between centres of consecutive windows of rows in time."""
    order = W.partitionBy(by).orderBy("acq_datetime", key)
    sized = df.select(by, "x_proj", "y_proj", F.unix_micros(F.col("acq_datetime").cast("timestamp")).alias("t"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(W.partitionBy(by)).alias("n"))
    w = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n") / 4))).cast("long")
    step = F.floor(F.col("w") / 2)
    rows = sized.withColumn("w", w).withColumn("step", step)
    # Row i is in the first window of starts s in (i - w, i] and in the second of s in (i - 2w, i - w]; starts are multiples of step below n - w.
    last = F.floor((F.col("n") - F.col("w") - 1) / F.col("step"))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - 2 * F.col("w")) / F.col("step")) + 1)
    high = F.least(last, F.floor(F.col("i") / F.col("step")))
    hit = rows.where((F.col("n") > F.col("w"))).withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("s", F.explode(F.sequence("lo", "hi")))
    second = F.col("i") >= F.col("s") * F.col("step") + F.col("w")
    m = lambda c, k: F.avg(F.when(second if k else ~second, F.col(c)))
    pair = hit.groupBy(by, "s").agg(*[m(c, k).alias(f"{c}{k}") for c in ("x_proj", "y_proj", "t") for k in (0, 1)])
    dx, dy = F.col("x_proj1") - F.col("x_proj0"), F.col("y_proj1") - F.col("y_proj0")
    v = pair.select(by, dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("d"), ((F.col("t1") - F.col("t0")) / 3.6e9).alias("h")).where("h > 0 and d > 0")
    rate = F.col("d") / 1000 / F.col("h")
    found = v.groupBy(by).agg(F.sum(F.col("dx") / F.col("d")).alias("sx"), F.sum(F.col("dy") / F.col("d")).alias("sy"), F.avg(rate).alias("mean_spread_rate_kmh"), F.max(rate).alias("max_spread_rate_kmh"))
    found = found.withColumn("spread_direction_deg", F.pmod(F.degrees(F.atan2("sx", "sy")), F.lit(360.0))).drop("sx", "sy")
    return df.select(by).distinct().join(found, by, "left").fillna(0.0, ["mean_spread_rate_kmh", "max_spread_rate_kmh"])


def intensity(df: DataFrame, by: str) -> DataFrame:
    """Energy, intensity and brightness statistics, trend of daily means, share above the group's own upper quartile."""
    c = F.col("confidence") / 100
    g = df.groupBy(by).agg(
        (F.sum("frp") * 0.25).alias("total_energy_mwh"), F.max("frp").alias("peak_frp"), F.avg("frp").alias("mean_frp"), F.stddev_pop("frp").alias("std_frp"), F.percentile("frp", F.lit(0.9)).alias("percentile_90_frp"),
        F.max("brightness").alias("peak_brightness"), F.avg("brightness").alias("mean_brightness"), F.coalesce(F.try_divide(F.sum(F.col("frp") * c), F.sum(c)), F.avg("frp")).alias("confidence_weighted_frp"), F.percentile("frp", F.lit(0.75)).alias("p75"),
    )
    high = df.select(by, "frp").join(g.select(by, "p75"), by).groupBy(by).agg(F.count_if(F.col("frp") > F.col("p75")).alias("high_intensity_detections"))
    day = df.groupBy(by, "acq_date").agg(F.avg("frp").alias("m")).withColumn("r", (F.row_number().over(W.partitionBy(by).orderBy("acq_date")) - 1).cast("double"))
    slope = day.groupBy(by).agg(F.when((F.count("*") > 1) & (F.avg("m") > 0), F.try_divide(F.covar_pop("r", "m"), F.var_pop("r")) / F.avg("m")).otherwise(0.0).alias("intensity_trend"))
    return g.drop("p75").join(high, by).join(slope, by)


def quality(df: DataFrame, by: str) -> DataFrame:
    """Counts, satellites, confidence, completeness, coherence."""
    g = df.groupBy(by).agg(
        F.count("*").alias("detection_count"), (F.count_distinct("satellite") / 2).alias("satellite_coverage"), F.concat_ws(",", F.sort_array(F.collect_set("satellite"))).alias("satellites_list"),
        F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.avg(F.when(F.col("confidence") >= 80, 1.0).otherwise(0.0)).alias("high_confidence_ratio"),
        F.min("acq_datetime").alias("a"), F.max("acq_datetime").alias("b"), F.avg("x_proj").alias("cx"), F.avg("y_proj").alias("cy"),
    )
    dx, dy = F.col("x_proj") - F.col("cx"), F.col("y_proj") - F.col("cy")
    far = df.select(by, "x_proj", "y_proj").join(g.select(by, "cx", "cy"), by).select(by, F.sqrt(dx * dx + dy * dy).alias("d")).groupBy(by).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    coherence = F.when(F.col("detection_count") > 3, F.coalesce(1 / (1 + F.try_divide("s", "m")), F.lit(1.0))).otherwise(1.0)
    complete = F.least(F.lit(1.0), F.col("detection_count") / (4 * (F.floor(_hours(F.col("a"), F.col("b")) / 24) + 1)))
    return g.join(far, by).withColumns({"data_completeness_score": complete, "spatial_coherence_score": coherence}).drop("a", "b", "cx", "cy", "m", "s")


def behavior(df: DataFrame, by: str, cfg: Episodes = Episodes()) -> DataFrame:
    """Day and night, hours, persistence, rekindling."""
    day, night = F.count_if(F.col("daynight") == "D"), F.count_if(F.col("daynight") == "N")
    g = df.groupBy(by).agg(day.alias("day_detections"), night.alias("night_detections")).withColumn("day_night_ratio", F.coalesce(F.try_divide(F.col("day_detections"), F.col("day_detections") + F.col("night_detections")), F.lit(0.5)))
    hours = df.groupBy(by, F.hour("acq_datetime").alias("h")).agg(F.count("*").alias("n"))
    hourly = hours.groupBy(by).agg(F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("peak_activity_hour"), (F.stddev_samp("n") / F.avg("n")).alias("diurnal_variation_coef"))
    days = df.select(by, "acq_date").distinct().withColumn("gap", F.datediff("acq_date", F.lag("acq_date").over(W.partitionBy(by).orderBy("acq_date"))))
    d = days.groupBy(by).agg((F.count("*") / (F.datediff(F.max("acq_date"), F.min("acq_date")) + 1)).alias("persistence_score"), F.when(F.count("*") > 2, F.count_if((F.col("gap") > cfg.dormancy_days) & (F.col("gap") <= cfg.rekindle_days))).otherwise(0).alias("rekindle_events"))
    out = g.join(hourly, by).join(d, by)
    return out.withColumns({"is_persistent": F.col("persistence_score") > 0.5, "is_day_active": F.col("day_night_ratio") > 0.6, "is_night_active": F.col("day_night_ratio") < 0.4})


def classify(df: DataFrame) -> DataFrame:
    """episode_type from duration, peak, persistence and rekindling."""
    p, r = F.col("persistence_score"), F.col("rekindle_events")
    short = F.when(F.col("peak_frp") > 1000, "explosive").otherwise("short")
    middle = F.when(p > 0.8, "persistent_moderate").otherwise("intermittent")
    long = F.when(r > 0, "complex_rekindle").when(p > 0.7, "long_persistent").otherwise("long_intermittent")
    return df.withColumn("episode_type", F.when(F.col("duration_days") < 1, short).when(F.col("duration_days") < 7, middle).otherwise(long))


def validity(df: DataFrame, cfg: Episodes = Episodes()) -> DataFrame:
    ok = (F.col("duration_hours") >= cfg.min_hours) & (F.col("duration_days") <= cfg.max_days) & (F.col("area_km2") >= cfg.min_area_km2) & (F.col("max_spread_rate_kmh") <= cfg.max_rate_kmh) & (F.col("spatial_coherence_score") >= cfg.min_coherence) & (F.col("data_completeness_score") >= cfg.min_completeness)
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def round4(df: DataFrame) -> DataFrame:
    """All doubles to four decimals, half to even."""
    return df.withColumns({n: F.bround(n, 4) for n, t in df.dtypes if t == "double"})


def episodes_a(df: DataFrame, by: str, cfg: Episodes = Episodes()) -> DataFrame:
    """The whole record of variant A."""
    out = temporal(df, by, cfg.dormancy_days)
    for part in (spatial(df, by), hull_metrics(df, by), spread(df, by), intensity(df, by), quality(df, by), behavior(df, by, cfg)):
        out = out.join(part, by)
    return round4(validity(classify(out), cfg))


def record_b(df: DataFrame, by: str) -> DataFrame:
    """Variant B without geometry: whole days + 1."""
    whole = F.floor(_hours(F.min("acq_datetime"), F.max("acq_datetime")) / 24) + 1
    return df.groupBy(by).agg(
        F.min("acq_datetime").alias("start_date"), F.max("acq_datetime").alias("end_date"), whole.alias("duration_days"), F.count("*").alias("n_detections"), F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp"), F.sum("frp").alias("total_frp"),
        F.avg("confidence").alias("mean_confidence"), F.count_distinct("acq_date").alias("unique_days"), F.count_if(F.col("daynight") == "D").alias("day_detections"), F.count_if(F.col("daynight") == "N").alias("night_detections"),
    )


def geometry_b(df: DataFrame, by: str) -> DataFrame:
    """(by, ring, area_km2): the buffered hull in degrees, its area in the equal-area projection."""
    kind = df.schema[by].dataType.simpleString()

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = [kernels.buffer(np.stack([np.array(x), np.array(y)], 1), 0.01 if n < 3 else 0.005) for x, y, n in zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array([r.tolist() for r in rings], pa.list_(pa.list_(pa.float64()))), pa.array([kernels.area(proj.project_arrays(r)) / 1e6 for r in rings], pa.float64())], [by, "ring", "area_km2"])

    return hulls(df, by, "longitude", "latitude").mapInArrow(widen, f"{by} {kind}, ring array<array<double>>, area_km2 double")


def episodes_b(df: DataFrame, by: str) -> DataFrame:
    return record_b(df, by).join(geometry_b(df, by), by)
