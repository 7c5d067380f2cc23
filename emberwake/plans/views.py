"""Views over the given tables that stand in for detections, zones, episodes and pixels. Integer arithmetic, then one division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as proj

#: The same text runs in both engines.
DETECTIONS = """SELECT event_id AS point_id, date_trunc('minute', ts) AS acq_datetime, CAST(ts AS DATE) AS acq_date,
 CAST(-1240000 + ((user_id*37)%90)*1000 + ((event_id*7919)%101-50)*2 AS DOUBLE)/1e4 AS longitude,
 CAST(330000 + ((user_id*53)%80)*1000 + ((event_id*104729)%101-50)*2 AS DOUBLE)/1e4 AS latitude,
 CAST(50+(event_id*31)%51 AS DOUBLE) AS confidence, value AS frp,
 CAST(300+(event_id*13)%100 AS DOUBLE) AS brightness,
 CASE WHEN event_id%2=0 THEN 'Terra' ELSE 'Aqua' END AS satellite,
 CASE WHEN event_id%20=0 THEN 'VIIRS' ELSE 'MODIS' END AS instrument,
 CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight, user_id
FROM events"""

X = f"({proj.A * proj.K0!r} * radians(longitude))"
_S = "sin(radians(latitude))"
Y = f"(({_S}/(1-{proj.E2!r}*{_S}*{_S}) - ln((1-{proj.E1!r}*{_S})/(1+{proj.E1!r}*{_S}))/{2 * proj.E1!r}) * {1 - proj.E2!r} * {proj.A / (2 * proj.K0)!r})"
QC = "confidence >= 70 AND instrument = 'MODIS' AND frp > 0"
#: CTEs for oracles: d (detections), p (projected, quality controlled), g (grouped by user and week).
D = f"d AS ({DETECTIONS})"
P = f"{D}, p AS (SELECT *, {X} AS x_proj, {Y} AS y_proj FROM d WHERE {QC})"
G = f"{D}, g AS (SELECT *, {X} AS x_proj, {Y} AS y_proj, user_id*100 + CAST(week(acq_date) AS BIGINT) AS grp FROM d)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    select = DETECTIONS.split("FROM events")[0].removeprefix("SELECT ")
    parts, depth, start = [], 0, 0
    for i, c in enumerate(select + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(select[start:i].strip())
            start = i + 1
    return table(spark, sf_dir, "events").selectExpr(*parts)


def projected(df: DataFrame) -> DataFrame:
    return df.withColumns({"x_proj": proj.to_x(F.col("longitude")), "y_proj": proj.to_y(F.col("latitude"))})


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality controlled and projected."""
    from ..config import Quality
    from ..operators.clean import qc_filter

    return projected(qc_filter(detections(spark, sf_dir), Quality()))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections with a given cluster column: user and week."""
    return projected(detections(spark, sf_dir)).withColumn("grp", F.col("user_id") * 100 + F.weekofyear("acq_date"))


#: Orders as episodes of their customer, customers as zones.
ORDER_EPISODES = """SELECT o_orderkey AS episode_id, o_custkey AS zone_id, CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS area FROM orders"""


def order_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("zone_id"), F.to_date("o_orderdate").alias("start_date"), F.col("o_totalprice").alias("area"))


#: Episodes (user and week) as lon/lat boxes of integers over 1e4, and zones as a grid of boxes of 0.05 degrees.
E_BOX = """e AS (SELECT user_id*100 + CAST(week(acq_date) AS BIGINT) AS episode_id, min(longitude)-0.0201 AS minx, min(latitude)-0.0201 AS miny, max(longitude)+0.0201 AS maxx, max(latitude)+0.0201 AS maxy FROM d GROUP BY ALL)"""
Z_BOX = """z AS (SELECT CAST(i*1000+j AS BIGINT) AS zone_id, CAST(-12410+5*i AS DOUBLE)/100 AS minx, CAST(3290+5*j AS DOUBLE)/100 AS miny, CAST(-12405+5*i AS DOUBLE)/100 AS maxx, CAST(3295+5*j AS DOUBLE)/100 AS maxy
 FROM (SELECT DISTINCT CAST(floor((longitude+124.1)/0.05) AS BIGINT) AS i, CAST(floor((latitude-32.9)/0.05) AS BIGINT) AS j FROM d))"""


def episode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    return g.groupBy(F.col("grp").alias("episode_id")).agg((F.min("longitude") - 0.0201).alias("minx"), (F.min("latitude") - 0.0201).alias("miny"), (F.max("longitude") + 0.0201).alias("maxx"), (F.max("latitude") + 0.0201).alias("maxy"))


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    c = d.select(F.floor((F.col("longitude") + 124.1) / 0.05).alias("i"), F.floor((F.col("latitude") - 32.9) / 0.05).alias("j")).distinct()
    f = lambda e: (e.cast("double") / 100)
    return c.select((F.col("i") * 1000 + F.col("j")).alias("zone_id"), f(F.col("i") * 5 - 12410).alias("minx"), f(F.col("j") * 5 + 3290).alias("miny"), f(F.col("i") * 5 - 12405).alias("maxx"), f(F.col("j") * 5 + 3295).alias("maxy"))


#: Customers with figures of their orders as a feature table.
FEATURES = """SELECT c_custkey AS key, c_acctbal AS bal, CAST(count(o_orderkey) AS DOUBLE) AS n, coalesce(avg(o_totalprice), 0) AS mean_price, coalesce(max(o_totalprice), 0) AS max_price, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS holes, CAST(1 AS DOUBLE) AS same, CAST(c_nationkey % 5 AS INT) AS label
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal, c_nationkey"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    j = c.join(g, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0.0, ["n", "mean_price", "max_price"])
    return j.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), "n", "mean_price", "max_price", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("double")).alias("holes"), F.lit(1.0).alias("same"), (F.col("c_nationkey") % 5).cast("int").alias("label"))


def points(spark: SparkSession, sf_dir: str, n: int | None = 8) -> DataFrame:
    """Vectors' first n fields as features, or all, with the given label. The oracles of the indices are over 8 fields."""
    e = table(spark, sf_dir, "embeddings")
    if n is None:
        return e.select(F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return e.select(F.col("vec_id").alias("key"), "label", F.slice(F.col("embedding").cast("array<double>"), 1, n).alias("features"))
