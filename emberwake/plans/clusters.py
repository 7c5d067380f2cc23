"""Queries over pairs, clusters, episodes and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Clustering
from ..operators import dbscan as db
from ..operators import episodes as ep
from ..operators import regimes as rg
from ..operators.pairs import distance, eps_pairs, gap
from .registry import query, rounded
from .views import D, E_BOX, ORDER_EPISODES, P, Z_BOX, G, episode_boxes, grouped, order_episodes, prepared, zone_boxes

CFG = Clustering()
#: Ranges of config.yaml:40-42.
GRID_KM, GRID_DAYS, GRID_SAMPLES = [1.0, 2.0, 3.0, 5.0], [1.0, 2.0, 3.0, 5.0, 7.0], [2, 3, 5]
_T = "epoch_us(acq_datetime) / 8.64e10"
_PT = f"{P}, q AS (SELECT *, {_T} AS t FROM p)"
_DIST = "sqrt((a.x_proj-b.x_proj)*(a.x_proj-b.x_proj)+(a.y_proj-b.y_proj)*(a.y_proj-b.y_proj))"


def _pairs_sql(m: float, days: float, extra: str = "", base: str = "q") -> str:
    return f"SELECT a.point_id AS src, b.point_id AS dst FROM {base} a JOIN {base} b ON b.x_proj BETWEEN a.x_proj - {m} AND a.x_proj + {m} AND a.point_id < b.point_id AND {_DIST} <= {m} AND abs(a.t - b.t) <= {days} {extra}"


_SPEED = f"AND (a.t = b.t OR {_DIST} <= abs(a.t - b.t) * 240000.0)"


def _cc(edges: str, nodes: str = "SELECT point_id AS id FROM q") -> str:
    """CTEs named n, e, cc(id, comp): components by keyed recursion."""
    return f"""n AS ({nodes}), e0 AS ({edges}), e AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0),
 cc(id, comp) USING KEY (id) AS (SELECT id, id FROM n UNION (SELECT e.dst, min(cc.comp) FROM cc JOIN e ON e.src = cc.id JOIN recurring.cc AS r ON r.id = e.dst WHERE cc.comp < r.comp GROUP BY e.dst)),
 lab AS (SELECT id AS point_id, CASE WHEN id IN (SELECT src FROM e) THEN comp END AS cluster FROM cc)"""


@query(f"WITH {_PT} {_pairs_sql(1500.0, 3)}")
def eps_pairs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.neighbours_combined(prepared(spark, sf_dir), CFG.eps_km, CFG.eps_days)


@query(f"WITH {_PT} {_pairs_sql(2500.0, 11, _SPEED)}")
def eps_pairs_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.neighbours_speed(prepared(spark, sf_dir), CFG.speed_eps_m, CFG.speed_eps_days, CFG.max_kmh)


@query(f"WITH {_PT} SELECT src, dst, round({_DIST}, 4) AS dist, round(least(abs(a.t - b.t), 2), 6) AS days FROM ({_pairs_sql(1500.0, 3)}) z JOIN q a ON a.point_id = src JOIN q b ON b.point_id = dst")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of pairs in space and, capped at two days, in time."""
    d = prepared(spark, sf_dir).withColumn("t_days", db.days())
    also = {"dist": F.round(distance(), 4), "days": F.round(F.least(gap("t_days"), F.lit(2.0)), 6)}
    return db.near_combined(d, CFG.eps_km, CFG.eps_days).pairs(also=also)


@query(f"WITH RECURSIVE {_PT}, {_cc(_pairs_sql(1500.0, 3))} SELECT point_id, coalesce(cluster, -1) AS cluster FROM lab")
def dbscan_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    return db.dbscan(d, db.near_combined(d, CFG.eps_km, CFG.eps_days), CFG.min_samples).na.fill(-1, ["cluster"])


@query(f"WITH RECURSIVE {_PT}, {_cc(_pairs_sql(2500.0, 11, _SPEED))} SELECT point_id, coalesce(cluster, -1) AS cluster FROM lab")
def dbscan_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    return db.dbscan(d, db.near_speed(d, CFG.speed_eps_m, CFG.speed_eps_days, CFG.max_kmh), CFG.min_samples).na.fill(-1, ["cluster"])


_L2 = "AND (a.x_proj-b.x_proj)/1500.0*((a.x_proj-b.x_proj)/1500.0)+(a.y_proj-b.y_proj)/1500.0*((a.y_proj-b.y_proj)/1500.0)+(a.t-b.t)/3.0*((a.t-b.t)/3.0)"


@query(f"WITH RECURSIVE {_PT}, {_cc(_pairs_sql(1500.0, 3, _L2 + ' <= 1'))} SELECT point_id, coalesce(cluster, -1) AS cluster FROM lab")
def dbscan_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    return db.dbscan(d, db.near_l2(d, CFG.eps_km, CFG.eps_days), CFG.min_samples).na.fill(-1, ["cluster"])


_WEIGHED = f"{P}, q AS (SELECT *, {_T} AS t, (confidence-50)/50*0.5 AS wc, (ln(1+frp) - avg(ln(1+frp)) OVER ()) / stddev_pop(ln(1+frp)) OVER () * 0.3 AS wf FROM p)"


@query(f"WITH RECURSIVE {_WEIGHED}, {_cc(_pairs_sql(1500.0, 3, _L2 + '+(a.wc-b.wc)*(a.wc-b.wc)+(a.wf-b.wf)*(a.wf-b.wf) <= 1'))} SELECT point_id, coalesce(cluster, -1) AS cluster FROM lab")
def dbscan_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    return db.dbscan(d, db.near_weighted(d, CFG.eps_km, CFG.eps_days), CFG.min_samples).na.fill(-1, ["cluster"])


_CORE = "core AS (SELECT src AS id FROM b GROUP BY src HAVING count(*) + 1 >= 4)"


@query(f"""WITH RECURSIVE {_PT}, b0 AS ({_pairs_sql(1500.0, 3)}), b AS (SELECT src, dst FROM b0 UNION ALL SELECT dst, src FROM b0), {_CORE},
 {_cc("SELECT src, dst FROM b0 WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)", "SELECT id FROM core")},
 border AS (SELECT b.dst AS id, min(cc.comp) AS comp FROM b JOIN cc ON cc.id = b.src GROUP BY b.dst)
 SELECT q.point_id, coalesce(cc.comp, border.comp, -1) AS cluster FROM q LEFT JOIN cc ON cc.id = q.point_id LEFT JOIN border ON border.id = q.point_id""")
def dbscan_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples: core and border points."""
    d = prepared(spark, sf_dir)
    return db.dbscan(d, db.near_combined(d, CFG.eps_km, CFG.eps_days), 4).na.fill(-1, ["cluster"])


@query(f"""WITH RECURSIVE {_PT}, {_cc(_pairs_sql(1500.0, 3))},
 s AS (SELECT cluster, min((acq_datetime, point_id)) AS f FROM lab JOIN q USING (point_id) WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 3),
 r AS (SELECT cluster, row_number() OVER (ORDER BY f) - 1 AS cluster_id FROM s)
 SELECT point_id, coalesce(cluster_id, -1) AS cluster_id FROM lab LEFT JOIN r USING (cluster)""")
def drop_small_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    labels = db.drop_small(db.dbscan(d, db.near_combined(d, CFG.eps_km, CFG.eps_days), CFG.min_samples), CFG.drop_below)
    return db.renumber(labels, d)


@query(f"""WITH RECURSIVE {_PT}, {_cc(_pairs_sql(2500.0, 11, _SPEED))},
 ok AS (SELECT cluster FROM lab JOIN q USING (point_id) WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 2 AND NOT (count(*) > 3 AND sqrt(var_pop(x_proj) + var_pop(y_proj)) > 2500.0 * sqrt(count(*))))
 SELECT point_id, CASE WHEN cluster IN (SELECT cluster FROM ok) THEN cluster ELSE -1 END AS cluster FROM lab""")
def quality_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prepared(spark, sf_dir)
    return db.quality_drop(db.dbscan(d, db.near_speed(d, CFG.speed_eps_m, CFG.speed_eps_days, CFG.max_kmh), CFG.min_samples), d).na.fill(-1, ["cluster"])


_DN = _cc(_pairs_sql(1500.0, 3, "AND a.daynight = b.daynight"))


@query(f"""WITH RECURSIVE {_PT}, {_DN},
 c AS (SELECT cluster AS point_id, avg(x_proj) AS x_proj, avg(y_proj) AS y_proj, min(t) AS lo, max(t) AS hi, min(daynight) AS dn FROM lab JOIN q USING (point_id) WHERE cluster IS NOT NULL GROUP BY cluster),
 m0 AS (SELECT a.point_id AS src, b.point_id AS dst FROM c a JOIN c b ON a.point_id < b.point_id AND a.dn <> b.dn AND {_DIST} <= 3000 AND greatest(a.lo, b.lo) - least(a.hi, b.hi) <= 1), m AS (SELECT src, dst FROM m0 UNION ALL SELECT dst, src FROM m0),
 c2(id, comp) USING KEY (id) AS (SELECT point_id, point_id FROM c UNION (SELECT m.dst, min(c2.comp) FROM c2 JOIN m ON m.src = c2.id JOIN recurring.c2 AS r ON r.id = m.dst WHERE c2.comp < r.comp GROUP BY m.dst))
 SELECT point_id, coalesce(comp, -1) AS cluster FROM lab LEFT JOIN c2 ON c2.id = lab.cluster""")
def merge_daynight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.separate_day_night(prepared(spark, sf_dir), CFG).na.fill(-1, ["cluster"])


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's grid: 4 distances, 5 times and 3 numbers of samples."""
    return db.grid_search(prepared(spark, sf_dir), GRID_KM, GRID_DAYS, GRID_SAMPLES)


@query(f"WITH {D} SELECT point_id, round(longitude - 0.01, 6) AS west, round(latitude + 0.01, 6) AS north FROM d")
def bounding_box_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grouped(spark, sf_dir)
    return rounded(d.select("point_id", (F.col("longitude") - 0.01).alias("west"), (F.col("latitude") + 0.01).alias("north")))


_HOURS = "(epoch_us(max(acq_datetime)) - epoch_us(min(acq_datetime))) / 3.6e9"


@query(f"""WITH {G}, s AS (SELECT grp, min(acq_datetime) AS start_datetime, max(acq_datetime) AS end_datetime, {_HOURS} AS h FROM g GROUP BY grp),
 dd AS (SELECT grp, acq_date, count(*) AS n, acq_date - lag(acq_date) OVER (PARTITION BY grp ORDER BY acq_date) AS gap FROM g GROUP BY grp, acq_date),
 t AS (SELECT grp, count(*) AS active_days, count(*) FILTER (WHERE gap > 2) AS dormancy_periods, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_dormancy_days, avg(n) AS m, max(n) AS max_daily_detections FROM dd GROUP BY grp)
 SELECT grp, start_datetime, end_datetime, active_days, dormancy_periods, max_dormancy_days, round(m, 6) AS mean_daily_detections, max_daily_detections, round(h, 6) AS duration_hours, round(h/24, 6) AS duration_days, round(active_days / (floor(h/24) + 1), 6) AS detection_consistency FROM s JOIN t USING (grp)""")
def episode_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.temporal(grouped(spark, sf_dir), "grp"))


@query(f"""WITH {G} SELECT grp, round(degrees(avg(x_proj) / {6378137.0 * 0.8667510025721987!r}) + 1e-9, 5) AS centroid_lon, round(min(longitude), 6) AS west, round(max(latitude), 6) AS north, round((max(x_proj)-min(x_proj))/1000, 5) AS bbox_width_km, round((max(y_proj)-min(y_proj))/1000, 5) AS bbox_height_km, round((max(x_proj)-min(x_proj)+max(y_proj)-min(y_proj))*2/1000, 5) AS perimeter_km FROM g GROUP BY grp""")
def episode_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ep.spatial(grouped(spark, sf_dir), "grp")
    return rounded(s.select("grp", (F.col("centroid_lon") + 1e-9).alias("centroid_lon"), F.col("bounding_box")[0].alias("west"), F.col("bounding_box")[3].alias("north"), "bbox_width_km", "bbox_height_km", "perimeter_km"), 5)


@query(f"""WITH {G}, b AS (SELECT grp, sum(frp)*0.25 AS e, max(frp) AS pk, avg(frp) AS mf, stddev_pop(frp) AS sf, quantile_cont(frp, 0.9) AS p90, quantile_cont(frp, 0.75) AS p75, max(brightness) AS pb, avg(brightness) AS mb, sum(frp*confidence/100)/sum(confidence/100) AS cw FROM g GROUP BY grp),
 h AS (SELECT grp, count(*) FILTER (WHERE frp > p75) AS high FROM g JOIN b USING (grp) GROUP BY grp),
 dd AS (SELECT grp, avg(frp) AS m, CAST(row_number() OVER (PARTITION BY grp ORDER BY acq_date) - 1 AS DOUBLE) AS r FROM g GROUP BY grp, acq_date),
 t AS (SELECT grp, CASE WHEN count(*) > 1 AND avg(m) > 0 THEN regr_slope(m, r) / avg(m) ELSE 0 END AS trend FROM dd GROUP BY grp)
 SELECT grp, round(e, 6) AS total_energy_mwh, round(pk, 6) AS peak_frp, round(mf, 6) AS mean_frp, round(sf, 6) AS std_frp, round(p90, 6) AS percentile_90_frp, round(pb, 6) AS peak_brightness, round(mb, 6) AS mean_brightness, round(cw, 6) AS confidence_weighted_frp, high AS high_intensity_detections, round(trend, 6) + 0.0 AS intensity_trend FROM b JOIN h USING (grp) JOIN t USING (grp)""")
def episode_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.intensity(grouped(spark, sf_dir), "grp"))


@query(f"""WITH {G}, b AS (SELECT grp, count(*) AS n, count(DISTINCT satellite) AS s, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS sl, avg(confidence) AS mc, min(confidence) AS nc, avg(CASE WHEN confidence >= 80 THEN 1.0 ELSE 0.0 END) AS hc, {_HOURS} AS h, avg(x_proj) AS cx, avg(y_proj) AS cy FROM g GROUP BY grp),
 f AS (SELECT grp, avg(d) AS m, stddev_pop(d) AS sd FROM (SELECT grp, sqrt((x_proj-cx)*(x_proj-cx)+(y_proj-cy)*(y_proj-cy)) AS d FROM g JOIN b USING (grp)) GROUP BY grp)
 SELECT grp, n AS detection_count, round(s/2, 6) AS satellite_coverage, sl AS satellites_list, round(mc, 6) AS mean_confidence, round(nc, 6) AS min_confidence, round(hc, 6) AS high_confidence_ratio, round(least(1.0, n/(4*(floor(h/24)+1))), 6) AS data_completeness_score, round(CASE WHEN n > 3 THEN 1/(1+sd/m) ELSE 1 END, 6) AS spatial_coherence_score FROM b JOIN f USING (grp)""")
def episode_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.quality(grouped(spark, sf_dir), "grp"))


_BEHAVIOR = f"""b AS (SELECT grp, count(*) FILTER (WHERE daynight='D') AS dd, count(*) FILTER (WHERE daynight='N') AS nn FROM g GROUP BY grp),
 h0 AS (SELECT grp, hour(acq_datetime) AS h, count(*) AS n FROM g GROUP BY ALL), h AS (SELECT grp, arg_max(h, (n, -h)) AS peak, stddev_samp(n)/avg(n) AS cv FROM h0 GROUP BY grp),
 d0 AS (SELECT grp, acq_date, acq_date - lag(acq_date) OVER (PARTITION BY grp ORDER BY acq_date) AS gap FROM (SELECT DISTINCT grp, acq_date FROM g)),
 dy AS (SELECT grp, count(*) / (max(acq_date) - min(acq_date) + 1) AS pers, CASE WHEN count(*) > 2 THEN count(*) FILTER (WHERE gap > 2 AND gap <= 7) ELSE 0 END AS rek FROM d0 GROUP BY grp)"""


@query(f"""WITH {G}, {_BEHAVIOR} SELECT grp, dd AS day_detections, nn AS night_detections, round(dd/(dd+nn), 6) AS day_night_ratio, CAST(peak AS BIGINT) AS peak_activity_hour, round(cv, 6) AS diurnal_variation_coef, round(pers, 6) AS persistence_score, rek AS rekindle_events, pers > 0.5 AS is_persistent, dd/(dd+nn) > 0.6 AS is_day_active, dd/(dd+nn) < 0.4 AS is_night_active FROM b JOIN h USING (grp) JOIN dy USING (grp)""")
def episode_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.behavior(grouped(spark, sf_dir), "grp"))


@query(f"""WITH {G}, r AS (SELECT grp, x_proj, y_proj, epoch_us(acq_datetime) AS t, row_number() OVER (PARTITION BY grp ORDER BY acq_datetime, point_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM g),
 w AS (SELECT *, greatest(2, least(10, n // 4)) AS w FROM r),
 st AS (SELECT DISTINCT grp, w, n, unnest(range(0, n - w, w // 2)) AS s FROM w WHERE n > w),
 c AS (SELECT st.grp, s, avg(x_proj) FILTER (WHERE i < s + st.w) AS x0, avg(y_proj) FILTER (WHERE i < s + st.w) AS y0, avg(t) FILTER (WHERE i < s + st.w) AS t0, avg(x_proj) FILTER (WHERE i >= s + st.w) AS x1, avg(y_proj) FILTER (WHERE i >= s + st.w) AS y1, avg(t) FILTER (WHERE i >= s + st.w) AS t1 FROM st JOIN w ON w.grp = st.grp AND i >= s AND i < s + 2 * st.w GROUP BY st.grp, s),
 v AS (SELECT grp, x1-x0 AS dx, y1-y0 AS dy, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS d, (t1-t0)/3.6e9 AS h FROM c),
 f AS (SELECT grp, avg(d/1000/h) AS m, max(d/1000/h) AS x, degrees(atan2(sum(dx/d), sum(dy/d))) AS dir FROM v WHERE h > 0 AND d > 0 GROUP BY grp)
 SELECT u.grp, round(coalesce(m, 0), 5) AS mean_spread_rate_kmh, round(coalesce(x, 0), 5) AS max_spread_rate_kmh, round(CASE WHEN dir < 0 THEN dir + 360 ELSE dir END, 3) AS spread_direction_deg FROM (SELECT DISTINCT grp FROM g) u LEFT JOIN f USING (grp)""")
def episode_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ep.spread(grouped(spark, sf_dir), "grp")
    return s.select("grp", F.round("mean_spread_rate_kmh", 5).alias("mean_spread_rate_kmh"), F.round("max_spread_rate_kmh", 5).alias("max_spread_rate_kmh"), F.round("spread_direction_deg", 3).alias("spread_direction_deg"))


@query()
def episode_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.hull_metrics(grouped(spark, sf_dir), "grp"))


@query(f"""WITH {G}, {_BEHAVIOR}, s AS (SELECT grp, {_HOURS} / 24 AS days, max(frp) AS pk FROM g GROUP BY grp)
 SELECT grp, CASE WHEN days < 1 THEN CASE WHEN pk > 1000 THEN 'explosive' ELSE 'short' END WHEN days < 7 THEN CASE WHEN pers > 0.8 THEN 'persistent_moderate' ELSE 'intermittent' END WHEN rek > 0 THEN 'complex_rekindle' WHEN pers > 0.7 THEN 'long_persistent' ELSE 'long_intermittent' END AS episode_type FROM s JOIN dy USING (grp)""")
def episode_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    j = ep.temporal(g, "grp").join(ep.behavior(g, "grp"), "grp").join(ep.intensity(g, "grp"), "grp")
    return ep.classify(j).select("grp", "episode_type")


@query()
def episodes_a_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of variant A with type and validity."""
    return ep.episodes_a(grouped(spark, sf_dir), "grp").drop("bounding_box")


@query(f"""WITH {G} SELECT grp, min(acq_datetime) AS start_date, max(acq_datetime) AS end_date, CAST(floor({_HOURS} / 24) + 1 AS BIGINT) AS duration_days, count(*) AS n_detections, round(avg(frp), 6) AS mean_frp, round(max(frp), 6) AS max_frp, round(sum(frp), 6) AS total_frp, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT acq_date) AS unique_days, count(*) FILTER (WHERE daynight='D') AS day_detections, count(*) FILTER (WHERE daynight='N') AS night_detections FROM g GROUP BY grp""")
def episode_record_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.record_b(grouped(spark, sf_dir), "grp"))


@query()
def episode_geometry_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.geometry_b(grouped(spark, sf_dir), "grp").select("grp", F.size("ring").alias("vertices"), "area_km2")


_OVER = f"{D}, {E_BOX}, {Z_BOX}, o AS (SELECT episode_id, zone_id, (least(e.maxx, z.maxx) - greatest(e.minx, z.minx)) * (least(e.maxy, z.maxy) - greatest(e.miny, z.miny)) AS a FROM e JOIN z ON e.minx <= z.maxx AND z.minx <= e.maxx AND e.miny <= z.maxy AND z.miny <= e.maxy)"


@query(f"WITH {_OVER} SELECT episode_id, zone_id, round(a, 9) AS area FROM o WHERE a > 0")
def overlay_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rg.overlay_rectangles(episode_boxes(spark, sf_dir), zone_boxes(spark, sf_dir), 0.05, zone="zone_id", scale=1.0)
    return o.select("episode_id", "zone_id", F.round("intersection_area_km2", 9).alias("area"))


@query()
def overlay_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered hulls against boxes as polygons, by clipping."""
    e = ep.geometry_b(grouped(spark, sf_dir), "grp").select(F.col("grp").alias("episode_id"), "ring")
    z = zone_boxes(spark, sf_dir)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    return rg.overlay_polygons(e, z.select("zone_id", F.array(F.array(ring)).alias("polygons")), 0.05, zone="zone_id")


_MONTHS = ", ".join(f"count(*) FILTER (WHERE month(start_date) = {m}) AS m{m}" for m in range(1, 13))
_LIST = "[" + ", ".join(f"m{m}" for m in range(1, 13)) + "]"


@query(f"""WITH e AS ({ORDER_EPISODES}), z AS (SELECT zone_id, count(*) AS n, sum(area) AS a, max(area) AS x, avg(area) AS m, stddev_samp(area) AS s, min(start_date) AS lo, max(start_date) AS hi, {_MONTHS} FROM e GROUP BY zone_id)
 SELECT zone_id, n AS episode_count, round(a, 4) AS total_burned_area, round(CASE WHEN n > 1 THEN (hi - lo) / (n - 1) / 365.0 END, 6) AS fire_return_interval_years, CAST(list_position({_LIST}, list_max({_LIST})) AS BIGINT) AS peak_fire_month,
 round(CASE WHEN n >= 3 THEN least(1.0, list_stddev_samp({_LIST}) / list_avg({_LIST}) / 3.46) ELSE 0 END, 6) AS seasonality_index, round(coalesce(s / greatest(0.001, m), 0), 6) AS fire_size_cv FROM z""")
def regime_of_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return interval, peak month, seasonality and variation of size of each zone."""
    e = order_episodes(spark, sf_dir)
    g = e.groupBy("zone_id").agg(F.count("*").alias("episode_count"), F.round(F.sum("area"), 4).alias("total_burned_area"), rg.return_interval().alias("fire_return_interval_years"), rg.peak_month().alias("peak_fire_month"), rg.seasonality().alias("seasonality_index"), F.coalesce(F.stddev_samp("area") / F.greatest(F.lit(0.001), F.avg("area")), F.lit(0.0)).alias("fire_size_cv"))
    return rounded(g)


_REGIME_A = f"""{_OVER}, g AS (SELECT *, user_id*100 + CAST(week(acq_date) AS BIGINT) AS grp FROM d), ea AS (SELECT grp AS episode_id, count(*) AS detection_count, sum(frp)*0.25 AS total_energy_mwh, max(frp) AS peak_frp, avg(frp) AS mean_frp, {_HOURS}/24 AS duration_days, count(DISTINCT acq_date) AS active_days, count(*) FILTER (WHERE daynight='D')/count(*) AS dn, count(DISTINCT acq_date)/(max(acq_date)-min(acq_date)+1) AS pers FROM g GROUP BY grp),
 eb AS (SELECT ea.*, (maxx-minx)*(maxy-miny) AS area FROM ea JOIN e USING (episode_id)), q AS (SELECT quantile_cont(peak_frp, 0.95) AS p95 FROM eb), zz AS (SELECT zone_id, (maxx-minx)*(maxy-miny) AS area FROM z),
 j AS (SELECT o.zone_id, o.a, o.a/eb.area AS share, o.a/zz.area*100 AS burned, zz.area AS za, eb.* EXCLUDE (area), q.p95 FROM o JOIN eb USING (episode_id) JOIN zz ON zz.zone_id = o.zone_id, q WHERE o.a > 0)"""


@query(f"""WITH {_REGIME_A} SELECT zone_id, count(a) AS episode_count, round(coalesce(sum(total_energy_mwh*share), 0), 4) AS total_energy_mwh, round(coalesce(sum(a), 0), 8) AS total_burned_area_km2, round(coalesce(max(duration_days), 0), 6) AS max_episode_duration, CAST(coalesce(sum(active_days), 0) AS BIGINT) AS total_fire_days, round(coalesce(max(peak_frp), 0), 6) AS watershed_peak_frp, round(coalesce(sum(detection_count*share), 0), 5) AS total_detections, round(coalesce(avg(dn), 0), 6) AS mean_day_activity, round(coalesce(avg(pers), 0), 6) AS mean_persistence,
 count(*) FILTER (WHERE burned > 10) AS n_10pct_burns, count(*) FILTER (WHERE burned > 50) AS n_50pct_burns, count(*) FILTER (WHERE burned > 90) AS n_90pct_burns, count(*) FILTER (WHERE peak_frp > p95) AS n_high_severity, round(least(1.0, coalesce(max(a/za), 0)), 6) AS hsbf FROM zz LEFT JOIN j USING (zone_id) GROUP BY zone_id""")
def regime_metrics_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    boxes, zones = episode_boxes(spark, sf_dir), zone_boxes(spark, sf_dir)
    pairs = rg.overlay_rectangles(boxes, zones, 0.05, zone="zone_id", scale=1.0)
    size = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    e = ep.temporal(g, "grp").join(ep.intensity(g, "grp"), "grp").join(ep.behavior(g, "grp"), "grp").join(ep.quality(g, "grp"), "grp").withColumnRenamed("grp", "episode_id").join(boxes.select("episode_id", size.alias("area_km2")), "episode_id")
    m = rg.zone_metrics_a(pairs, e, zones.select("zone_id", size.alias("area_km2")), "zone_id")
    return rounded(m.select("zone_id", "episode_count", F.round("total_energy_mwh", 4).alias("total_energy_mwh"), "max_episode_duration", "total_fire_days", "watershed_peak_frp", F.round("total_detections", 5).alias("total_detections"), "mean_day_activity", "mean_persistence", "n_10pct_burns", "n_50pct_burns", "n_90pct_burns", "n_high_severity", "hsbf")).join(m.select("zone_id", F.round("total_burned_area_km2", 8).alias("total_burned_area_km2")), "zone_id")


@query(f"""WITH {_OVER}, g AS (SELECT *, user_id*100 + CAST(week(acq_date) AS BIGINT) AS grp FROM d), eb AS (SELECT grp AS episode_id, count(*) AS n, avg(frp) AS mf, max(frp) AS xf, sum(frp) AS tf, CAST(min(acq_datetime) AS DATE) AS start_date, floor({_HOURS}/24)+1 AS dur, count(*) FILTER (WHERE daynight='D') AS dd FROM g GROUP BY grp),
 j AS (SELECT o.zone_id, o.a, eb.* FROM o JOIN eb USING (episode_id) WHERE o.a > 0), q AS (SELECT zone_id, quantile_cont(xf, 0.9) AS q90 FROM j GROUP BY zone_id), zz AS (SELECT zone_id, (maxx-minx)*(maxy-miny) AS area FROM z)
 SELECT zone_id, count(a) AS episode_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_detections, round(coalesce(max(a), 0), 8) AS max_burned_area, round(coalesce(sum(tf), 0), 4) AS total_frp, round(coalesce(avg(mf), 0), 6) AS mean_frp, CAST(coalesce(sum(dur), 0) AS BIGINT) AS total_duration, round(CASE WHEN count(a) > 1 THEN (max(start_date)-min(start_date))/(count(a)-1)/365.0 END, 6) AS fire_return_interval_years,
 round(coalesce(sum(dd)/greatest(1, sum(n)), 0), 6) AS day_detection_ratio, round(coalesce(stddev_samp(a)/greatest(0.001, avg(a)), 0), 5) AS fire_size_cv, count(*) FILTER (WHERE xf > q90) AS high_intensity_count, round(least(1.0, coalesce(sum(a)/max(area), 0)), 6) AS area_burned_fraction, round(least(1.0, coalesce(max(a)/max(area), 0)), 6) AS hsbf FROM zz LEFT JOIN j USING (zone_id) LEFT JOIN q USING (zone_id) GROUP BY zone_id""")
def regime_metrics_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, zones = episode_boxes(spark, sf_dir), zone_boxes(spark, sf_dir)
    pairs = rg.overlay_rectangles(boxes, zones, 0.05, zone="zone_id", scale=1.0)
    e = ep.record_b(grouped(spark, sf_dir), "grp").withColumnRenamed("grp", "episode_id")
    size = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    m = rg.zone_metrics_b(pairs, e, zones.select("zone_id", size.alias("area_km2")), "zone_id")
    return m.select("zone_id", "episode_count", "total_detections", F.round("max_burned_area", 8).alias("max_burned_area"), F.round("total_frp", 4).alias("total_frp"), F.round("mean_frp", 6).alias("mean_frp"), F.col("total_duration").cast("long").alias("total_duration"), F.round("fire_return_interval_years", 6).alias("fire_return_interval_years"), F.round("day_detection_ratio", 6).alias("day_detection_ratio"), F.round("fire_size_cv", 5).alias("fire_size_cv"), "high_intensity_count", F.round("area_burned_fraction", 6).alias("area_burned_fraction"), F.round("hsbf", 6).alias("hsbf"))


@query(f"""WITH {G}, e AS (SELECT grp, CAST(min(acq_datetime) AS DATE) AS a, CAST(max(acq_datetime) AS DATE) AS b FROM g GROUP BY grp), s AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(a) AS TIMESTAMP) FROM e), (SELECT CAST(max(b) AS TIMESTAMP) FROM e), INTERVAL 1 DAY)) AS DATE) AS day)
 SELECT CAST(day AS VARCHAR) AS day, count(e.grp) AS active FROM s LEFT JOIN e ON day BETWEEN a AND b GROUP BY 1""")
def active_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.active_on_dates(ep.record_b(grouped(spark, sf_dir), "grp")))
