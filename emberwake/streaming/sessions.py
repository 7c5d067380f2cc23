"""Gap-based episodes of one place, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: str, gap: str = "11 days", time: str = "acq_datetime", late: str | None = None) -> DataFrame:
    """(key, start_time, end_time, n, total_frp): rows of a key closer than gap are one session.

    On a stream give `late`: sessions are final once the watermark passes their end.
    """
    d = df.withWatermark(time, late) if late else df
    g = d.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("frp").alias("total_frp"))
    return g.select(key, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n", "total_frp")


def daily(df: DataFrame, time: str = "acq_datetime", late: str | None = None) -> DataFrame:
    """Counts and intensity by day."""
    d = df.withWatermark(time, late) if late else df
    return d.groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("frp").alias("total_frp")).select(F.col("w.start").alias("day"), "n", "total_frp")
