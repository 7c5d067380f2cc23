"""Cleaning and derivation of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Quality, Region
from ..functions import categories as cat
from ..functions import projection as proj


def bbox_filter(df: DataFrame, region: Region, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Inclusive on all sides; nulls go."""
    return df.where(F.col(lon).between(region.west, region.east) & F.col(lat).between(region.south, region.north))


def qc_filter(df: DataFrame, quality: Quality, confidence: str = "confidence", frp: str = "frp") -> DataFrame:
    """Confidence, instrument, satellite, positive intensity, known place. An empty list skips its test."""
    out = df.where((F.col(confidence) >= quality.min_confidence) & (F.col(frp) > 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    for name, allowed in (("instrument", quality.instruments), ("satellite", quality.satellites)):
        if allowed:
            out = out.where(F.col(name).isin(*allowed))
    return out


def coerce(df: DataFrame, names: tuple[str, ...] = ("latitude", "longitude", "frp", "brightness", "confidence")) -> DataFrame:
    return df.withColumns({n: cat.number(F.col(n)) for n in names if n in df.columns})


def derive(df: DataFrame, time: str = "acq_datetime") -> DataFrame:
    """Day of year, hour, season and projected place."""
    t = F.col(time)
    return df.withColumns({"day_of_year": F.dayofyear(t), "hour_of_day": F.hour(t), "season": cat.season(F.month(t)), "x_proj": proj.to_x(F.col("longitude")), "y_proj": proj.to_y(F.col("latitude"))})


def dedup_keep_best(df: DataFrame, quality: Quality, x: str = "x_proj", y: str = "y_proj", time: str = "acq_datetime", confidence: str = "confidence", key: str = "point_id") -> DataFrame:
    """Of each cell of place and hour (rounded half to even) the row of highest confidence, then earliest, then smallest key."""
    hours = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(3.6e9 * quality.dedup_hours)
    cell = [F.rint(F.col(x) / quality.dedup_meters), F.rint(F.col(y) / quality.dedup_meters), F.rint(hours)]
    w = W.partitionBy(*cell).orderBy(F.desc_nulls_last(confidence), F.col(time), F.col(key))
    return df.withColumn("_best", F.row_number().over(w)).where("_best = 1").drop("_best")


def prepare(raw: DataFrame, quality: Quality, region: Region) -> DataFrame:
    """The whole of cleaning: place, quality, derived columns, copies. Rows keep their point_id."""
    return dedup_keep_best(derive(qc_filter(bbox_filter(raw, region), quality)), quality)


def data_summary(df: DataFrame) -> DataFrame:
    """One row: counts, ranges, means."""
    return df.agg(
        F.count("*").alias("n"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"), F.avg("frp").alias("mean_frp"), F.stddev_samp("frp").alias("std_frp"), F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("daynight") == "D").alias("n_day"), F.count_if(F.col("daynight") == "N").alias("n_night"),
    )
