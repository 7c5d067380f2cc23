"""Scans and sinks: detections and zones from JSON, Parquet tables, CSV, GeoJSON, JSON summaries, stage tables."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import categories as cat

DETECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("latitude", "longitude", "acq_date", "acq_time", "confidence", "frp", "brightness", "instrument", "satellite", "daynight")])
_RING = "array<array<double>>"
FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def scan_detections_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of detections with a fixed schema; bad numbers are null. Convert it to Parquet once: one file is one task."""
    raw = spark.read.schema(DETECTION).json(path, multiLine=True)
    numbers = {n: cat.number(F.col(n)) for n in ("latitude", "longitude", "confidence", "frp", "brightness")}
    out = raw.withColumns(numbers).withColumn("acq_datetime", cat.acq_datetime(F.try_to_date("acq_date"), F.col("acq_time"))).withColumn("acq_date", F.try_to_date("acq_date"))
    return out.withColumn("point_id", F.xxhash64(*[F.col(c).cast("string") for c in out.columns]))


def scan_zones_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(huc12, polygons): the features of a collection; polygons are arrays of rings of points. The id has three spellings."""
    doc = spark.read.schema(FEATURES).json(path, multiLine=True)
    f = doc.select(F.inline("features"))
    p = F.col("properties")
    ids = F.coalesce(p["huc12"], p["HUC12"], p["huc_12"])
    one, many = F.from_json("geometry.coordinates", f"array<{_RING}>"), F.from_json("geometry.coordinates", f"array<array<{_RING}>>")
    shape = F.when(F.col("geometry.type") == "Polygon", F.array(one)).when(F.col("geometry.type") == "MultiPolygon", many)
    return f.select(ids.alias("huc12"), shape.alias("polygons"))


def zone_areas(zones: DataFrame) -> DataFrame:
    """Adds area_km2 of lon/lat polygons in the equal-area projection."""
    from ..functions import projection as proj

    ring = lambda r: F.transform(r, lambda q: F.struct(proj.to_x(q[0]).alias("x"), proj.to_y(q[1]).alias("y")))
    areas = F.transform("polygons", lambda p: cat.polygon_area(F.transform(p, ring)))
    return zones.withColumn("area_km2", F.aggregate(areas, F.lit(0.0), lambda s, a: s + a) / 1e6)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system of the path, so also in remote stores."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path of a fallback chain that is there."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths}")


def newest_run(root: str | Path, prefix: str = "run_") -> Path:
    """The newest timestamped run directory by name."""
    found = sorted(p for p in Path(root).glob(f"{prefix}*") if p.is_dir())
    if not found:
        raise FileNotFoundError(f"no {prefix}* in {root}")
    return found[-1]


def run_directory(root: str | Path, parts: tuple[str, ...] = ("data", "reports", "stages")) -> Path:
    path = Path(root) / time.strftime("run_%Y%m%d_%H%M%S")
    for p in parts:
        (path / p).mkdir(parents=True, exist_ok=True)
    return path


def sink_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """With a header; nested columns as JSON text."""
    flat = {n: F.to_json(n) for n, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(flat).write.mode("overwrite").csv(path, header=True) if flat else df.write.mode("overwrite").csv(path, header=True)


def _geojson(df: DataFrame, geometry, properties: list[str]) -> DataFrame:
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def sink_geojson_points(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """One feature a line."""
    g = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    _geojson(df, g, [c for c in df.columns if c not in (lon, lat)]).write.mode("overwrite").text(path)


def sink_geojson_polygons(df: DataFrame, path: str, polygons: str = "polygons") -> None:
    g = F.struct(F.lit("MultiPolygon").alias("type"), F.col(polygons).alias("coordinates"))
    _geojson(df, g, [c for c in df.columns if c != polygons]).write.mode("overwrite").text(path)


def wkt(polygons):
    """MULTIPOLYGON text of polygons, for tables that replace geometry packages."""
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, lambda q: F.concat_ws(" ", q[0].cast("string"), q[1].cast("string")))), F.lit(")"))
    shape = lambda p: F.concat(F.lit("("), F.concat_ws(", ", F.transform(p, ring)), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.concat_ws(", ", F.transform(polygons, shape)), F.lit(")"))


def sink_json(row: DataFrame, path: str | Path) -> dict:
    """A one-row summary as a JSON file of the driver."""
    found = row.limit(1).collect()
    data = json.loads(json.dumps(found[0].asDict(recursive=True) if found else {}, default=str))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2))
    return data


def sink_report(sections: dict[str, DataFrame], path: str | Path, most: int = 50) -> str:
    """Markdown tables of small aggregates, `most` rows each."""
    out = []
    for title, df in sections.items():
        rows = df.limit(most).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    text = "\n".join(out)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return text


def stage(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if it was finished before (its success marker is there), else made and written."""
    path = f"{root.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def duration(seconds: float) -> str:
    """Human-readable."""
    m, s = divmod(int(seconds), 60)
    h, m = divmod(m, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{seconds:.1f}s"


class Monitor:
    """Logs the time of each stage."""

    def __init__(self, name: str = "emberwake"):
        self.log, self.began = logging.getLogger(name), time.time()

    def done(self, what: str) -> None:
        self.log.info("%s after %s", what, duration(time.time() - self.began))
