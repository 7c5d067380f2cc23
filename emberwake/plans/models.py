"""Queries over feature tables: scaling, indices, tests, selection, consensus, clusterers, reports, covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as cat
from ..operators import covariates as cov
from ..operators import episodes as ep
from ..operators import features as ft
from ..operators import models as md
from ..operators import reports as rp
from ..operators import score as sc
from .registry import query, rounded
from .views import FEATURES, D, G, detections, features, grouped, points, table

_F = f"f AS ({FEATURES})"


@query(f"WITH {_F} SELECT key, CASE WHEN n <= 0 THEN 'No Fire' WHEN n <= 5 THEN 'Rare Fire' WHEN n <= 20 THEN 'Occasional Fire' WHEN n <= 50 THEN 'Frequent Fire' ELSE 'Very Frequent Fire' END AS stratum FROM f")
def fire_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("key", cat.fire_strata(F.col("n")).alias("stratum"))


@query(f"WITH {_F}, q AS (SELECT quantile_cont(max_price, [0.25, 0.5, 0.75, 0.9]) AS q FROM f) SELECT key, CASE WHEN max_price <= q[1] THEN 'a' WHEN max_price <= q[2] THEN 'b' WHEN max_price <= q[3] THEN 'c' WHEN max_price <= q[4] THEN 'd' ELSE 'e' END AS stratum FROM f, q")
def qcut_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.qcut_strata(features(spark, sf_dir), "max_price", [0, 0.25, 0.5, 0.75, 0.9, 1], list("abcde")).select("key", "stratum")


@query(f"WITH {_F} SELECT 'bal' AS name, count(DISTINCT bal) > 1 AS kept FROM f UNION ALL SELECT 'same', count(DISTINCT same) > 1 FROM f UNION ALL SELECT 'holes', count(DISTINCT holes) > 1 FROM f")
def drop_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["bal", "same", "holes"]
    kept = ft.drop_constant(features(spark, sf_dir), names)
    return spark.createDataFrame([(n, n in kept) for n in names], "name string, kept boolean")


@query(f"WITH {_F} SELECT key, round(coalesce(holes, (SELECT quantile_cont(holes, 0.5) FROM f)), 6) AS holes FROM f")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.median_impute(features(spark, sf_dir), ["holes"]).select("key", "holes"))


@query(f"WITH {_F}, s AS (SELECT avg(bal) AS mb, stddev_pop(bal) AS sb, avg(n) AS mn, stddev_pop(n) AS sn FROM f) SELECT key, round((bal-mb)/sb, 6) AS bal, round((n-mn)/sn, 6) AS n, 0.0::DOUBLE AS same FROM f, s")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.standard_scale(features(spark, sf_dir), ["bal", "n", "same"]).select("key", "bal", "n", "same"))


_ROBUST = "(SELECT quantile_cont(bal, 0.5) AS b2, quantile_cont(bal, 0.75)-quantile_cont(bal, 0.25) AS bi, quantile_cont({n}, 0.5) AS n2, quantile_cont({n}, 0.75)-quantile_cont({n}, 0.25) AS ni FROM f)"


@query(f"WITH {_F} SELECT key, round((bal-b2)/bi, 6) AS bal, round((n-n2)/ni, 6) AS n, 0.0::DOUBLE AS same FROM f, {_ROBUST.format(n='n')}")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.robust_scale(features(spark, sf_dir), ["bal", "n", "same"]).select("key", "bal", "n", "same"))


@query(f"WITH {_F} SELECT key, round((bal-b2)/bi, 6) AS bal, round((ln(1+n)-n2)/ni, 6) AS n FROM f, {_ROBUST.format(n='ln(1+n)')}")
def log_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.log_robust(features(spark, sf_dir), ["bal", "n"], ["n"]).select("key", "bal", "n"))


@query(f"WITH {_F}, q AS (SELECT quantile_cont(bal, list_transform(range(0, 101), lambda i: i/100.0)) AS q FROM f), p AS (SELECT key, bal, q, len(list_filter(q, lambda x: x < bal)) AS b, len(list_filter(q, lambda x: x <= bal)) AS u FROM f, q) SELECT key, round(CASE WHEN u > b THEN (b+u-1)/2/100 ELSE (b-1+(bal-q[b])/(q[b+1]-q[b]))/100 END, 6) AS bal FROM p")
def quantile_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.quantile_uniform(features(spark, sf_dir), "bal", "key", 101))


@query(f"WITH {_F} SELECT key, round((bal-(SELECT min(bal) FROM f))/(SELECT max(bal)-min(bal) FROM f), 6) AS bal FROM f")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.minmax(features(spark, sf_dir), ["bal"]).select("key", "bal"))


@query(f"WITH {_F} SELECT key, round(n/10*(key%5)/5, 6) AS fire_complexity, round(ln(1+n)*ln(1+mean_price), 6) AS fire_pressure, round((key%5)/5*ln(1+max_price), 6) AS burn_severity_proxy FROM f")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).withColumns({"fire_size_cv": F.col("n") / 10, "seasonality_index": F.col("key") % 5 / 5, "episode_count": F.col("n"), "mean_frp": F.col("mean_price"), "hsbf": F.col("key") % 5 / 5, "max_frp": F.col("max_price")})
    return rounded(ft.derived(f).select("key", "fire_complexity", "fire_pressure", "burn_severity_proxy"))


@query(f"WITH {_F}, r AS (SELECT key, 0.2*n/(SELECT max(n) FROM f)+0.3*(key%11)/10+0.25*max_price/(SELECT max(max_price) FROM f)+0.25*mean_price/(SELECT max(mean_price) FROM f) AS risk FROM f) SELECT key, round(risk, 6) AS risk, CASE WHEN risk <= 0 THEN 'None' WHEN risk <= 0.2 THEN 'Very Low' WHEN risk <= 0.4 THEN 'Low' WHEN risk <= 0.6 THEN 'Moderate' WHEN risk <= 0.8 THEN 'High' ELSE 'Very High' END AS risk_class FROM r")
def composite_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).withColumn("hsbf", F.col("key") % 11 / 10)
    return rounded(ft.composite_risk(f, "n", "hsbf", "max_price", "mean_price").select("key", "risk", F.coalesce("risk_class", F.lit("None")).alias("risk_class")))


_V = "v AS (SELECT vec_id, label, CAST(embedding[1:8] AS DOUBLE[]) AS f FROM embeddings), u AS (SELECT vec_id, label, unnest(range(1, 9)) AS i, unnest(f) AS x FROM v), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY label, i)"


@query(f"WITH {_V}, g AS (SELECT i, avg(x) AS m FROM u GROUP BY i), w AS (SELECT sum((x-m)*(x-m)) AS w FROM u JOIN c USING (label, i)), b AS (SELECT sum(n*(c.m-g.m)*(c.m-g.m)) AS b FROM c JOIN g USING (i)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM v) SELECT round(b*(n-k)/(w*(k-1)), 6) AS ch FROM w, b, k")
def ch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.calinski_harabasz(points(spark, sf_dir)))


@query(f"WITH {_V}, s AS (SELECT label, avg(d) AS s FROM (SELECT label, vec_id, sqrt(sum((x-m)*(x-m))) AS d FROM u JOIN c USING (label, i) GROUP BY label, vec_id) GROUP BY label), p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m-b.m)*(a.m-b.m))) AS d FROM c a JOIN c b ON a.i=b.i AND a.label<>b.label GROUP BY 1, 2) SELECT round(avg(r), 6) AS db FROM (SELECT a, max((x.s+y.s)/d) AS r FROM p JOIN s x ON x.label=a JOIN s y ON y.label=b GROUP BY a)")
def db_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.davies_bouldin(points(spark, sf_dir)))


@query(f"WITH {_V}, p AS (SELECT a.vec_id AS k, a.label AS own, b.label AS other, avg(list_distance(a.f, b.f)) AS m FROM v a JOIN v b ON a.vec_id<>b.vec_id GROUP BY 1, 2, 3), e AS (SELECT k, min(m) FILTER (WHERE own=other) AS a, min(m) FILTER (WHERE own<>other) AS b FROM p GROUP BY k) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END), 6) AS silhouette FROM e")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.silhouette(points(spark, sf_dir)))


@query(f"WITH {_V} SELECT round(sum((x-m)*(x-m)), 6) AS inertia FROM u JOIN c USING (label, i)")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.inertia(points(spark, sf_dir)))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label > 1 GROUP BY label) SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(stddev_pop(n), 6) AS std_size, round(min(n)/max(n), 6) AS cluster_balance, (SELECT count(*) FROM embeddings WHERE label <= 1) AS n_noise, round((SELECT count(*) FROM embeddings WHERE label <= 1)/(SELECT count(*) FROM embeddings), 6) AS noise_ratio FROM s")
def cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.balance(points(spark, sf_dir).withColumn("label", F.when(F.col("label") > 1, F.col("label")).otherwise(-1))))


@query(f"WITH {_F}, l AS (SELECT label, 'bal' AS feature, bal AS x FROM f UNION ALL SELECT label, 'n', n FROM f), g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL), t AS (SELECT feature, avg(x) AS gm FROM l GROUP BY feature) SELECT feature, round((sum(n*(m-gm)*(m-gm))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))), 4) AS f, count(*)-1 AS df_between, CAST(sum(n)-count(*) AS BIGINT) AS df_within FROM g JOIN t USING (feature) GROUP BY feature")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.anova(features(spark, sf_dir), "label", ["bal", "n"]), 4)


@query(f"WITH {_V} SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sqrt(sum((a.m-b.m)*(a.m-b.m))), 6) AS distance FROM c a JOIN c b ON a.i=b.i AND a.label<b.label GROUP BY 1, 2")
def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.centroid_distances(points(spark, sf_dir)))


@query(f"WITH {_F} SELECT CAST(label AS BIGINT) AS label, count(*) AS size, round(avg(bal), 5) AS mean_bal, round(stddev_samp(bal), 5) AS std_bal, round(quantile_cont(bal, 0.5), 5) AS median_bal, round(max(bal), 5) AS max_bal FROM f GROUP BY label")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.profile(features(spark, sf_dir), "label", ["bal"]), 5)


@query(f"WITH {_F} SELECT key, CASE WHEN n < 5 THEN 'Low' WHEN n < 15 THEN 'Moderate' ELSE 'High' END || '-Frequency ' || CASE WHEN key%80 < 10 THEN 'Small' WHEN key%80 < 50 THEN 'Medium' ELSE 'Large' END || '-' || CASE WHEN key%130 < 50 THEN 'Low-Intensity' WHEN key%130 < 100 THEN 'Moderate-Intensity' ELSE 'High-Intensity' END AS name_b, concat_ws('_', CASE WHEN n < 3 THEN 'Rare' WHEN n < 10 THEN 'Occasional' WHEN n < 25 THEN 'Frequent' ELSE 'Very-Frequent' END, CASE WHEN key%10 < 0.5 THEN 'Minimal-Impact' WHEN key%10 < 1.5 THEN 'Low-Impact' WHEN key%10 < 3 THEN 'Moderate-Impact' WHEN key%10 < 5 THEN 'High-Impact' ELSE 'Extreme-Impact' END, CASE WHEN key%80 < 5 THEN 'Small' WHEN key%80 < 20 THEN 'Medium' ELSE 'Large' END, CASE WHEN key%130 < 30 THEN 'Low-Intensity' WHEN key%130 < 70 THEN 'Moderate-Intensity' ELSE 'High-Intensity' END) AS name_c FROM f")
def cluster_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return features(spark, sf_dir).select("key", cat.regime_name_b(F.col("n"), k % 80, k % 130).alias("name_b"), cat.regime_name_c(F.col("n"), k % 10 / 10, k % 130, k % 80).alias("name_c"))


_RUNS = """SELECT CAST(p_partkey AS BIGINT) AS run_id, CAST(2 + p_size % 15 AS BIGINT) AS n_clusters, (p_partkey * 37 % 101) / 101.0::DOUBLE AS silhouette, CAST(p_partkey * 91 % 997 AS DOUBLE) AS calinski_harabasz, (p_partkey * 53 % 89) / 89.0::DOUBLE AS davies_bouldin, (p_partkey * 17 % 71) / 71.0::DOUBLE AS cluster_balance, (p_partkey % 10) / 20.0::DOUBLE AS noise_ratio FROM part"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("run_id"), (F.col("p_size") % 15 + 2).cast("long").alias("n_clusters"), (k * 37 % 101 / 101).alias("silhouette"), (k * 91 % 997).cast("double").alias("calinski_harabasz"), (k * 53 % 89 / 89).alias("davies_bouldin"), (k * 17 % 71 / 71).alias("cluster_balance"), (k % 10 / 20).alias("noise_ratio"))


@query(f"WITH r AS ({_RUNS}), f AS (SELECT * FROM r WHERE n_clusters BETWEEN 3 AND 15 AND noise_ratio < 0.3), s AS (SELECT min(silhouette) AS a, max(silhouette) AS b, min(calinski_harabasz) AS c, max(calinski_harabasz) AS d, min(davies_bouldin) AS e, max(davies_bouldin) AS g, min(cluster_balance) AS h, max(cluster_balance) AS i FROM f) SELECT run_id, round(0.3*(silhouette-a)/(b-a+1e-10)+0.2*(calinski_harabasz-c)/(d-c+1e-10)+0.2*(1-(davies_bouldin-e)/(g-e+1e-10))+0.3*(cluster_balance-h)/(i-h+1e-10), 6) AS score FROM f, s")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.select_best(_runs(spark, sf_dir)).select("run_id", "score"))


@query(f"WITH r AS ({_RUNS}) SELECT run_id AS k, round(silhouette/(SELECT max(silhouette) FROM r)+calinski_harabasz/(SELECT max(calinski_harabasz) FROM r)-davies_bouldin/(SELECT max(davies_bouldin) FROM r), 6) AS score FROM r")
def select_k_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _runs(spark, sf_dir).select(F.col("run_id").alias("k"), "silhouette", F.col("calinski_harabasz").alias("ch"), F.col("davies_bouldin").alias("db"))
    return rounded(sc.select_k(m).select("k", "score"))


@query("WITH l AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 97 = 0 THEN -1 ELSE c_custkey % 2 END AS a, c_nationkey % 3 AS b FROM customer), k AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS c FROM (SELECT DISTINCT a, b FROM l WHERE a >= 0 AND b >= 0)), o AS (SELECT key, row_number() OVER (ORDER BY key) - 1 + (SELECT count(*) FROM k) AS c FROM l WHERE a < 0 OR b < 0) SELECT key, c AS consensus FROM l JOIN k USING (a, b) UNION ALL SELECT key, c FROM o")
def consensus_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    l = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 97 == 0, -1).otherwise(F.col("c_custkey") % 2).alias("a"), (F.col("c_nationkey") % 3).cast("long").alias("b"))
    return rounded(sc.consensus(l, "key", ["a", "b"]))


def _model(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return md.RUNNERS[name](points(spark, sf_dir, None)).select("key", F.col("label").cast("long").alias("label"))

    run.__name__ = name
    return query()(run)


for _name in md.RUNNERS:
    _model(_name)


@query()
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.pca(points(spark, sf_dir, None), 4)


@query()
def select_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.try_k(points(spark, sf_dir, None), range(2, 11))


@query()
def stability_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.bootstrap(points(spark, sf_dir, None), 4)


@query()
def model_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.suite(points(spark, sf_dir, None))


@query()
def knn_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.knn(points(spark, sf_dir, None), 4)


@query()
def synth_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.synthetic(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zone_id"), (F.col("c_custkey") % 90 / 10 - 124).alias("lon"), (F.col("c_custkey") % 80 / 10 + 33).alias("lat")))


_PIX = "p AS (SELECT l_suppkey AS zone_id, l_quantity AS value, l_extendedprice AS area, CAST(l_shipdate AS DATE) AS ts, l_linenumber AS class FROM lineitem)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone_id"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("pixel_area"), F.to_date("l_shipdate").alias("ts"), F.col("l_linenumber").alias("class"))


@query(f"WITH {_PIX} SELECT zone_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value)-min(value), 6) AS ruggedness FROM p GROUP BY zone_id")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cov.zonal_stats(_pixels(spark, sf_dir), "zone_id"))


@query(f"WITH {_PIX} SELECT zone_id, round(sum(CASE WHEN class BETWEEN 1 AND 3 THEN area ELSE 0 END)/sum(area), 6) AS low, round(sum(CASE WHEN class = 4 THEN area ELSE 0 END)/sum(area), 6) AS mid FROM p GROUP BY zone_id")
def class_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cov.class_fractions(_pixels(spark, sf_dir), "zone_id", {"low": (1, 3), "mid": (4, 4)}))


@query(f"WITH {_PIX}, y AS (SELECT zone_id, year(ts) AS y, sum(value) AS s FROM p GROUP BY ALL) SELECT p.zone_id, round(sum(value), 4) AS total, round(avg(value) FILTER (WHERE month(ts) BETWEEN 5 AND 10), 6) AS season_mean, round(stddev_pop(value)/avg(value), 6) AS cv, round(min(m), 6) AS yearly_mean FROM p JOIN (SELECT zone_id, avg(s) AS m FROM y GROUP BY zone_id) z ON z.zone_id = p.zone_id GROUP BY p.zone_id")
def fire_season_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cov.climate(_pixels(spark, sf_dir), "zone_id")
    return c.select("zone_id", F.round("total", 4).alias("total"), F.round("season_mean", 6).alias("season_mean"), F.round("cv", 6).alias("cv"), F.round("yearly_mean", 6).alias("yearly_mean"))


@query(f"WITH {_PIX}, m AS (SELECT zone_id, date_trunc('month', ts) AS t, avg(value) AS m FROM p GROUP BY ALL) SELECT p.zone_id, round(avg(value), 6) AS mean, round(min(s), 6) AS temporal_std FROM p JOIN (SELECT zone_id, stddev_pop(m) AS s FROM m GROUP BY zone_id) z ON z.zone_id = p.zone_id GROUP BY p.zone_id")
def vegetation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cov.vegetation(_pixels(spark, sf_dir), "zone_id"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 1000 END, 6) AS distance FROM customer")
def road_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    roads = c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_acctbal").alias("distance"))
    return rounded(cov.with_default(c.select("c_custkey"), roads, "c_custkey", "distance", 1000.0))


_BANDS = "CASE WHEN h <= 0.1 THEN '<10%' WHEN h <= 0.3 THEN '10-30%' WHEN h <= 0.5 THEN '30-50%' WHEN h <= 0.7 THEN '50-70%' ELSE '>70%' END"
_H = "h AS (SELECT p_partkey AS zone_id, (p_partkey * 37 % 1200) / 1000.0::DOUBLE AS h, p_retailprice AS area, p_size AS n FROM part)"


def _hsbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zone_id"), (F.col("p_partkey") * 37 % 1200 / 1000).alias("hsbf"), F.col("p_retailprice").alias("area_km2"), F.col("p_size").alias("n"))


@query(f"WITH {_H} SELECT CASE WHEN h <= 0 THEN 'none' ELSE {_BANDS} END AS band, count(*) AS n FROM h WHERE h <= 1 GROUP BY 1")
def hsbf_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.hsbf_bands(_hsbf(spark, sf_dir).where("hsbf <= 1"))


@query(f"WITH {_H} SELECT h > 1 AS above, count(*) AS n, round(quantile_cont(area, 0.5), 6) AS median_area, round(avg(h), 6) AS mean_hsbf FROM h GROUP BY 1")
def hsbf_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.hsbf_contrast(_hsbf(spark, sf_dir)))


@query(f"WITH {_H} SELECT zone_id, round(h*100, 6) AS hsbf_percent, round(h*area, 6) AS implied_area, round((h-1)*area, 6) AS discrepancy FROM h ORDER BY h DESC, zone_id LIMIT 20")
def hsbf_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.hsbf_worst(_hsbf(spark, sf_dir), 20))


@query(f"WITH {_H} SELECT round(quantile_cont(h, 0.05), 6) AS p5, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.95), 6) AS p95, round(quantile_cont(h, 0.99), 6) AS p99 FROM h")
def hsbf_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.quantiles(_hsbf(spark, sf_dir), "hsbf", {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}))


@query(f"WITH {_H} SELECT 'severe' AS class, count(*) FILTER (WHERE h > 0.5) AS n, round(count(*) FILTER (WHERE h > 0.5)/count(*), 6) AS share FROM h UNION ALL SELECT 'high', count(*) FILTER (WHERE h > 0.3), round(count(*) FILTER (WHERE h > 0.3)/count(*), 6) FROM h UNION ALL SELECT 'moderate', count(*) FILTER (WHERE h > 0.2), round(count(*) FILTER (WHERE h > 0.2)/count(*), 6) FROM h UNION ALL SELECT 'low', count(*) FILTER (WHERE h > 0.1), round(count(*) FILTER (WHERE h > 0.1)/count(*), 6) FROM h")
def burn_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.severity_counts(_hsbf(spark, sf_dir)))


@query(f"WITH {_H}, t AS (SELECT unnest(range(10, 101, 10)) AS threshold) SELECT CAST(threshold AS BIGINT) AS threshold, count(*) FILTER (WHERE n % (threshold//10 + 1) > 0) AS zones, CAST(sum(n % (threshold//10 + 1)) AS BIGINT) AS episodes FROM h, t GROUP BY threshold")
def threshold_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hsbf(spark, sf_dir).withColumns({f"n_{t}pct_burns": F.col("n") % (t // 10 + 1) for t in range(10, 101, 10)})
    return rounded(rp.threshold_exceedance(h))


_GE = f"{G}, e AS (SELECT grp, (epoch_us(max(acq_datetime))-epoch_us(min(acq_datetime)))/3.6e9 AS h, sqrt((max(x_proj)-min(x_proj))*(max(x_proj)-min(x_proj))+(max(y_proj)-min(y_proj))*(max(y_proj)-min(y_proj)))/1000 AS km, count(*) AS n, stddev_samp(x_proj) AS sx, stddev_samp(y_proj) AS sy FROM g GROUP BY grp)"


@query(f"WITH {_GE} SELECT count(*) AS clusters, round(avg(n), 6) AS mean_size, round(stddev_samp(n), 6) AS std_size, min(n) AS min_size, max(n) AS max_size, round(quantile_cont(n, 0.9), 6) AS p90_size, round(avg(h), 6) AS mean_hours, round(stddev_pop(h), 6) AS std_hours, round(max(h), 6) AS max_hours, round(avg(km), 5) AS mean_km, round(max(km), 5) AS max_km FROM e")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rp.cluster_statistics(grouped(spark, sf_dir), "grp")
    return rounded(s).withColumns({c: F.round(c, 5) for c in ("mean_km", "max_km")})


@query(f"WITH {_GE}, r AS (SELECT grp, floor(h/24) > 5 AS too_long, sqrt(sx*sx+sy*sy)/1000 > 0.7 AS too_wide, n > 5 AND floor(h/24) > 0 AND km/(floor(h/24)*24) > 0.01 AS too_fast FROM e) SELECT count(*) AS clusters, count(*) FILTER (WHERE too_long) AS too_long, count(*) FILTER (WHERE too_wide) AS too_wide, count(*) FILTER (WHERE too_fast) AS too_fast, round(1 - count(*) FILTER (WHERE too_long OR coalesce(too_wide, false) OR too_fast)/count(*), 6) AS quality_ratio FROM r")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.quality_rules(grouped(spark, sf_dir), "grp", max_days=5, max_spread_km=0.7, max_kmh=0.01))


@query(f"WITH {G}, e AS (SELECT grp, avg(confidence)/100 AS c FROM g GROUP BY grp) SELECT count(*) FILTER (WHERE c > 0.8) AS high, count(*) FILTER (WHERE c > 0.5 AND c <= 0.8) AS medium, count(*) FILTER (WHERE c <= 0.5) AS low FROM e")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grouped(spark, sf_dir).groupBy("grp").agg((F.avg("confidence") / 100).alias("c"))
    return rp.quality_bands(e, "c")


@query(f"WITH {G}, e AS (SELECT grp, count(*) FILTER (WHERE daynight='D') / count(*) AS r FROM g GROUP BY grp) SELECT count(*) FILTER (WHERE r > 0.6) AS day, count(*) FILTER (WHERE r < 0.4) AS night, count(*) FILTER (WHERE r BETWEEN 0.4 AND 0.6) AS mixed FROM e")
def daynight_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.dominance(ep.behavior(grouped(spark, sf_dir), "grp"))


@query()
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.validation_summary(ep.episodes_a(grouped(spark, sf_dir), "grp"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size = 0 THEN 0 ELSE 1 + (p_size - 1) * 5 // (SELECT max(p_size) FROM part) END AS BIGINT) AS bin FROM part")
def adaptive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.adaptive_bins(table(spark, sf_dir, "part"), "p_size", 5).select("p_partkey", "bin"))


@query(f"WITH {G} SELECT acq_date::VARCHAR AS day, count(DISTINCT grp) AS clusters FROM g GROUP BY 1")
def clusters_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).groupBy(F.col("acq_date").cast("string").alias("day")).agg(F.count_distinct("grp").alias("clusters"))


@query(f"WITH {G}, e AS (SELECT grp, count(*) AS n, sum(frp) AS f, count(DISTINCT acq_date) AS d FROM g GROUP BY grp) SELECT count(*) AS episodes, CAST(sum(n) AS BIGINT) AS detections, round(avg(n), 6) AS mean_size, round(sum(f), 4) AS total_frp, round(avg(d), 6) AS mean_days FROM e")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.summary(ep.record_b(grouped(spark, sf_dir), "grp"))


@query(f"WITH {D}, o AS (SELECT *, lag(acq_datetime) OVER (PARTITION BY user_id ORDER BY acq_datetime, point_id) AS prev FROM d), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR acq_datetime > prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY acq_datetime, point_id ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(acq_datetime) AS start_time, count(*) AS n, round(sum(frp), 6) AS total_frp FROM s GROUP BY user_id, k")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of one place by gaps of twelve hours."""
    from ..streaming.sessions import sessions

    return rounded(sessions(detections(spark, sf_dir), "user_id", "12 hours").select("user_id", "start_time", "n", "total_frp"))
