"""Queries over single tables: cleaning, derivation, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Quality, Region
from ..functions import categories as cat
from ..functions import projection as proj
from ..operators import clean, profile
from .registry import query, rounded
from .views import QC, D, P, X, Y, detections, prepared, projected, table

BOX = Region(-122.0, 34.0, -118.0, 38.0)


@query(f"WITH {D} SELECT point_id, longitude, latitude FROM d WHERE longitude BETWEEN -122 AND -118 AND latitude BETWEEN 34 AND 38")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.bbox_filter(detections(spark, sf_dir), BOX).select("point_id", "longitude", "latitude")


@query(f"WITH {D} SELECT point_id, confidence, frp, satellite FROM d WHERE {QC}")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.qc_filter(detections(spark, sf_dir), Quality()).select("point_id", "confidence", "frp", "satellite")


@query(f"WITH {P} SELECT point_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x_proj/1000, 0), round_even(y_proj/1000, 0), round_even(epoch_us(acq_datetime)/3.6e9, 0) ORDER BY confidence DESC, acq_datetime, point_id) AS r FROM p) WHERE r = 1")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_keep_best(prepared(spark, sf_dir), Quality()).select("point_id", "confidence")


@query(f"WITH {D} SELECT point_id, CAST(dayofyear(acq_datetime) AS BIGINT) AS day_of_year, CAST(hour(acq_datetime) AS BIGINT) AS hour_of_day, CASE WHEN month(acq_datetime) IN (12,1,2) THEN 'Winter' WHEN month(acq_datetime) <= 5 THEN 'Spring' WHEN month(acq_datetime) <= 8 THEN 'Summer' ELSE 'Fall' END AS season FROM d")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.derive(detections(spark, sf_dir)).select("point_id", "day_of_year", "hour_of_day", "season"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'Winter' WHEN month(o_orderdate) IN (3,4,5) THEN 'Spring' WHEN month(o_orderdate) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season FROM orders")
def season_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", cat.season(F.month("o_orderdate")).alias("season"))


@query(f"WITH {D} SELECT point_id, CASE WHEN confidence >= 80 THEN 'High (≥80%)' WHEN confidence >= 60 THEN 'Medium (60-79%)' WHEN confidence >= 30 THEN 'Low (30-59%)' ELSE 'Very Low (<30%)' END AS category FROM d")
def confidence_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("point_id", cat.confidence_category(F.col("confidence")).alias("category"))


@query(f"WITH {D} SELECT point_id, round({X}, 3) AS x_proj, round({Y}, 3) AS y_proj FROM d")
def project_6933(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(projected(detections(spark, sf_dir)).select("point_id", "x_proj", "y_proj"), 3)


@query(f"WITH {D} SELECT point_id, round(longitude, 5) AS lon, round(latitude, 5) AS lat FROM d")
def unproject_6933(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projected(detections(spark, sf_dir))
    return rounded(p.select("point_id", proj.to_lon(F.col("x_proj")).alias("lon"), proj.to_lat(F.col("y_proj")).alias("lat")), 5)


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(CAST(hour(ts)*60 + minute(ts) AS BIGINT)) AS acq_datetime FROM events")
def make_acq_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hhmm = (F.hour("ts") * 100 + F.minute("ts")).cast("string")
    return e.select("event_id", cat.acq_datetime(F.to_date("ts"), hhmm).cast("timestamp_ntz").alias("acq_datetime"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", cat.number(text).alias("number"))


@query(f"WITH {D} SELECT point_id, round_even(latitude, 3) AS lat3, round_even(longitude, 2) AS lon2 FROM d")
def grid_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("point_id", cat.half_even(F.col("latitude"), 3).alias("lat3"), cat.half_even(F.col("longitude"), 2).alias("lon2"))


@query("SELECT event_id, CAST(length(split_part(s, '.', 2)) AS BIGINT) AS digits FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id || '.' || (event_id * 7 % 1000) ELSE CAST(event_id AS VARCHAR) END AS s FROM events)")
def decimal_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 3 == 0, F.concat_ws(".", "event_id", F.col("event_id") * 7 % 1000)).otherwise(F.col("event_id").cast("string"))
    return rounded(e.select("event_id", cat.decimals(s).alias("digits")))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 10 THEN 'Very Small (<10 km²)' WHEN p_retailprice < 50 THEN 'Small (10-50 km²)' WHEN p_retailprice < 200 THEN 'Medium (50-200 km²)' WHEN p_retailprice < 500 THEN 'Large (200-500 km²)' ELSE 'Very Large (>500 km²)' END AS category FROM part")
def size_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", cat.size_category(F.col("p_retailprice")).alias("category"))


@query("WITH c AS (SELECT CASE WHEN p_size < 10 THEN 'Very Small (<10 km²)' WHEN p_size < 50 THEN 'Small (10-50 km²)' WHEN p_size < 200 THEN 'Medium (50-200 km²)' WHEN p_size < 500 THEN 'Large (200-500 km²)' ELSE 'Very Large (>500 km²)' END AS category FROM part) SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY category")
def size_category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(cat.size_category(F.col("p_size")).alias("category"))
    return rounded(profile.shares(p, "category"))


@query(f"WITH {D}, r AS (SELECT *, CASE WHEN longitude < -120 THEN 'West Coast' WHEN longitude < -110 THEN 'Mountain West' WHEN longitude < -100 THEN 'Central West' ELSE 'Great Plains' END AS region FROM d) SELECT region, count(frp) AS count, round(avg(frp), 6) AS mean, round(stddev_samp(frp), 6) AS std, round(min(frp), 6) AS min, round(quantile_cont(frp, 0.25), 6) AS p25, round(quantile_cont(frp, 0.5), 6) AS p50, round(quantile_cont(frp, 0.75), 6) AS p75, round(max(frp), 6) AS max FROM r GROUP BY region")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("region", cat.region_category(F.col("longitude")))
    return rounded(profile.describe(d, "frp", ["region"]))


@query("SELECT c_mktsegment, count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, round(min(c_acctbal), 6) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.75), 6) AS p75, round(max(c_acctbal), 6) AS max FROM customer GROUP BY c_mktsegment")
def describe_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]))


@query(f"WITH {D} SELECT CAST(acq_date AS VARCHAR) AS acq_date, count(*) AS n FROM d GROUP BY 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.counts(detections(spark, sf_dir), "acq_date"))


@query(f"WITH {D} SELECT CAST(hour(acq_datetime) AS BIGINT) AS hour, count(*) AS n FROM d GROUP BY 1")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.counts(detections(spark, sf_dir), F.hour("acq_datetime").alias("hour")))


@query("SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS period, count(*) AS n FROM orders GROUP BY 1")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.counts(table(spark, sf_dir, "orders"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")))


@query(f'WITH {D} SELECT CAST(acq_date AS VARCHAR) AS acq_date, count(*) FILTER (WHERE daynight = \'D\') AS "D", count(*) FILTER (WHERE daynight = \'N\') AS "N" FROM d GROUP BY 1')
def daynight_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.pivot_counts(detections(spark, sf_dir), "acq_date", "daynight", ["D", "N"]))


@query(f"WITH {D} SELECT round_even(latitude, 2) AS cell_lat, round_even(longitude, 2) AS cell_lon, CAST(acq_date AS VARCHAR) AS acq_date, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(max(confidence), 6) AS max_confidence, round(avg(frp), 6) AS mean_frp, round(max(frp), 6) AS max_frp, round(sum(frp), 6) AS sum_frp, round(avg(brightness), 6) AS mean_brightness, round(max(brightness), 6) AS max_brightness, count(DISTINCT daynight) AS n_daynight, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS satellites, min(acq_datetime) AS first_time, max(acq_datetime) AS last_time FROM d GROUP BY 1, 2, 3")
def grid_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.grid_daily_rollup(detections(spark, sf_dir)))


@query(f"WITH {D} SELECT round_even(latitude, 2) AS lat, round_even(longitude, 2) AS lon, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1")
def repeat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repeats(detections(spark, sf_dir), cat.half_even(F.col("latitude"), 2).alias("lat"), cat.half_even(F.col("longitude"), 2).alias("lon"))


@query(f"WITH {D} SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM d GROUP BY round_even(latitude, 2), round_even(longitude, 2)) GROUP BY n")
def location_repeat_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.count_histogram(detections(spark, sf_dir), cat.half_even(F.col("latitude"), 2).alias("lat"), cat.half_even(F.col("longitude"), 2).alias("lon"))


@query("SELECT a, b, round(r, 6) AS r FROM (SELECT unnest([{'a': 'l_quantity', 'b': 'l_quantity', 'r': corr(l_quantity, l_quantity)}, {'a': 'l_quantity', 'b': 'l_extendedprice', 'r': corr(l_quantity, l_extendedprice)}, {'a': 'l_quantity', 'b': 'l_discount', 'r': corr(l_quantity, l_discount)}, {'a': 'l_extendedprice', 'b': 'l_extendedprice', 'r': corr(l_extendedprice, l_extendedprice)}, {'a': 'l_extendedprice', 'b': 'l_discount', 'r': corr(l_extendedprice, l_discount)}, {'a': 'l_discount', 'b': 'l_discount', 'r': corr(l_discount, l_discount)}], recursive := true) FROM lineitem)")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT 'half' AS name, count(half) AS non_null, count(*) - count(half) AS nulls, round(100.0 * count(half) / count(*), 6) AS percent FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS half FROM part) UNION ALL SELECT 'p_name', count(p_name), count(*) - count(p_name), round(100.0 * count(p_name) / count(*), 6) FROM part")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("half", F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")))
    return rounded(profile.completeness(p, ["half", "p_name"]))


@query("SELECT c_mktsegment, CAST(value AS BIGINT) AS value, n FROM (SELECT c_mktsegment, c_nationkey AS value, count(*) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def mode_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.most_common(table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment"]))


@query(f"WITH {D} SELECT count(*) AS n, CAST(min(acq_date) AS VARCHAR) AS first_date, CAST(max(acq_date) AS VARCHAR) AS last_date, round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat, round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, round(avg(frp), 6) AS mean_frp, round(stddev_samp(frp), 6) AS std_frp, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE daynight = 'D') AS n_day, count(*) FILTER (WHERE daynight = 'N') AS n_night FROM d")
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.data_summary(detections(spark, sf_dir)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top(table(spark, sf_dir, "orders"), 100, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("""WITH t AS (SELECT key, o, r FROM (SELECT p_partkey AS key, 0 AS o, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5
 UNION ALL SELECT key, o, r FROM (SELECT p_partkey AS key, 1 AS o, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 5
 UNION ALL SELECT key, o, r FROM (SELECT p_partkey AS key, 2 AS o, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part) WHERE r <= 5),
 u AS (SELECT key, min((o, r)) AS place FROM t GROUP BY key),
 f AS (SELECT p_partkey AS key, (3, row_number() OVER (ORDER BY p_partkey * 7919 % 1000, p_partkey)) AS place FROM part WHERE p_partkey NOT IN (SELECT key FROM u))
 SELECT key AS p_partkey, CAST(place[1] AS BIGINT) AS o, CAST(place[2] AS BIGINT) AS r FROM (SELECT * FROM u UNION ALL SELECT * FROM f) ORDER BY place LIMIT 18""")
def topk_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.union_of_tops(table(spark, sf_dir, "part"), "p_partkey", [F.desc("p_retailprice"), F.desc("p_size"), F.asc("p_size")], 5, 18))
