import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwake.config import Config, Quality, load_config
from emberwake.functions import categories as cat
from emberwake.functions import kernels, projection
from emberwake.operators import clean, dbscan, episodes, regimes, score
from emberwake.operators.components import connected_components
from emberwake.operators.pairs import eps_pairs, gap


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n,m,few", [(40, 25, 0), (120, 130, 0), (120, 130, 1000)])
def test_components(spark, n, m, few):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long"), few=few).collect()))
    linked = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({x for e in linked for x in e}, linked)


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(70)]
    for few in (0, 1000):
        assert {r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long"), few=few).collect()} == {0}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def test_eps_pairs_match_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(150)] + [(200, 0.0, 0.0), (201, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "point_id long, x double, y double")
    got = sorted(map(tuple, eps_pairs(df, {"x": 0.5, "y": 0.5}, (gap("x") <= 0.5) & (gap("y") <= 0.5)).collect()))
    want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and abs(a[1] - b[1]) <= 0.5 and abs(a[2] - b[2]) <= 0.5)
    assert got == want


@pytest.mark.parametrize("least", [2, 3, 5])
def test_dbscan_matches_the_sequential_one(spark, least):
    rng = random.Random(least)
    pts = [(i, rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(120)]
    near = {i: [j for j, x2, y2 in pts if math.hypot(x - x2, y - y2) <= 0.6] for i, x, y in pts}
    label = {}
    for i, _, _ in pts:
        if i in label or len(near[i]) < least:
            continue
        label[i], todo = i, list(near[i])
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = i
            if len(near[j]) >= least:
                todo += near[j]
    df = spark.createDataFrame(pts, "point_id long, x_proj double, y_proj double")
    from emberwake.operators.pairs import distance

    pairs = eps_pairs(df, {"x_proj": 0.6, "y_proj": 0.6}, distance() <= 0.6)
    got = {r.point_id: r.cluster for r in dbscan.dbscan(df, pairs, least).collect()}
    core = {i for i in near if len(near[i]) >= least}
    assert {i: c for i, c in got.items() if i in core} == {i: min(j for j in core if label.get(j) == label[i]) for i in core}
    assert {i for i, c in got.items() if c is None} == {i for i in near if i not in label}


def test_chain_in_time_and_small_clusters(spark):
    at = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    df = spark.createDataFrame([(0, at(0), 0.0, 0.0), (1, at(2), 0.0, 0.0), (2, at(4), 0.0, 0.0), (3, at(9), 0.0, 0.0)], "point_id long, acq_datetime timestamp_ntz, x_proj double, y_proj double")
    labels = dbscan.drop_small(dbscan.dbscan(df, dbscan.neighbours_combined(df, 1.5, 3), 2), 3)
    assert {r.point_id: r.cluster_id for r in dbscan.renumber(labels, df).collect()} == {0: 0, 1: 0, 2: 0, 3: -1}


@pytest.mark.parametrize("minutes,linked", [(0, True), (6, False), (13, True)])
def test_speed_limit(spark, minutes, linked):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(0, t, 0.0, 0.0), (1, t + dt.timedelta(minutes=minutes), 2000.0, 0.0)], "point_id long, acq_datetime timestamp_ntz, x_proj double, y_proj double")
    assert (dbscan.neighbours_speed(df, 2500, 11, 10).count() == 1) == linked


def test_keep_best_takes_the_earliest_of_equals(spark):
    t = dt.datetime(2020, 1, 1, 12)
    rows = [(2, t + dt.timedelta(minutes=5), 90.0), (1, t + dt.timedelta(minutes=9), 90.0), (3, t, 80.0)]
    df = spark.createDataFrame([(*r, 10.0, 10.0) for r in rows], "point_id long, acq_datetime timestamp_ntz, confidence double, x_proj double, y_proj double")
    assert [r.point_id for r in clean.dedup_keep_best(df, Quality()).collect()] == [2]


def test_gaps(spark):
    days = [1, 2, 6, 20]
    df = spark.createDataFrame([(0, dt.datetime(2020, 1, d, 3), dt.date(2020, 1, d), "D") for d in days], "g long, acq_datetime timestamp_ntz, acq_date date, daynight string")
    t, b = episodes.temporal(df, "g").first(), episodes.behavior(df, "g").first()
    assert (t.dormancy_periods, t.max_dormancy_days, b.rekindle_events) == (2, 14, 1)
    assert b.persistence_score == pytest.approx(4 / 20)


def test_return_interval_and_seasonality(spark):
    day = dt.date
    starts = [(0, day(2000, 1, 1)), (0, day(2001, 12, 31)), (1, day(2000, 1, 1)), *[(2, day(2000, 5, d)) for d in (1, 2, 3)], *[(3, day(2000, m, 1)) for m in range(1, 13)]]
    g = spark.createDataFrame(starts, "z long, start_date date").groupBy("z").agg(regimes.return_interval().alias("r"), regimes.seasonality().alias("s"), regimes.peak_month().alias("p"))
    got = {r.z: (r.r, r.s, r.p) for r in g.collect()}
    assert got[0][0] == pytest.approx(2.0) and got[1][0] is None and got[1][1] == 0
    assert got[2][1] == 1.0 and got[2][2] == 5 and got[3][1] == pytest.approx(0)


def test_projection(spark):
    assert projection.project(180, 0)[0] == pytest.approx(17367530.445, abs=1e-3)
    assert projection.project(0, 85.0445664)[1] == pytest.approx(7314540.831, abs=0.01)
    r = spark.range(1).select(projection.to_lon(projection.to_x(F.lit(-120.0))).alias("lon"), projection.to_lat(projection.to_y(F.lit(40.0))).alias("lat")).first()
    assert (r.lon, r.lat) == pytest.approx((-120, 40), abs=1e-7)


def test_clip_and_hull():
    unit = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    ell = [[[0, 0], [1, 0], [1, 0.5], [0.5, 0.5], [0.5, 1], [0, 1], [0, 0]]]
    hole = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]]
    far = [[[5, 5], [6, 5], [6, 6], [5, 5]]]
    touch = [[[1, 0], [2, 0], [2, 1], [1, 1], [1, 0]]]
    assert [kernels.clipped_area([p], unit) for p in (ell, hole, far, touch)] == pytest.approx([0.75, 0.96, 0, 0])
    ring = kernels.hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]]))
    assert len(ring) == 4 and kernels.area(ring) == 1
    assert kernels.area(kernels.hull(np.array([[0, 0], [1, 1], [2, 2]]))) == 0
    assert kernels.valid_ring(np.array(hole[0])) and not kernels.valid_ring(np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float))


def test_clipped_tiles_add_up():
    star = [[[0.1, 0.1], [2.9, 0.4], [1.6, 1.2], [2.5, 2.8], [0.7, 1.9], [0.1, 0.1]]]
    tiles = [np.array([[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1]], float) for x in range(3) for y in range(3)]
    assert sum(kernels.clipped_area([star], t) for t in tiles) == pytest.approx(kernels.area(np.array(star[0])))


def test_buffer_is_a_capsule():
    ring = kernels.buffer(np.array([[0, 0], [2, 0]], float), 1.0)
    assert kernels.area(ring) == pytest.approx(4 + math.pi, rel=0.01)


def test_strata_edges_and_bad_input(spark):
    r = spark.createDataFrame([(float(x),) for x in (0, 5, 20, 50, 51)], "n double").select(cat.fire_strata(F.col("n")).alias("s")).collect()
    assert [x.s for x in r] == ["No Fire", "Rare Fire", "Occasional Fire", "Frequent Fire", "Very Frequent Fire"]
    r = spark.createDataFrame([("30", "2020-01-01", "x"), ("2400", "2020-01-01", "NaN"), ("1230", "bad", "1")], "t string, d string, n string")
    got = r.select(cat.acq_datetime(F.try_to_date("d"), F.col("t")).cast("string").alias("a"), cat.number(F.col("n")).alias("n")).collect()
    assert [x.a for x in got] == ["2020-01-01 00:30:00", None, None] and [x.n for x in got] == [None, None, 1.0]


def test_consensus_splits_noise(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, -1, 0), (5, -1, 0)], "key long, a long, b long")
    got = {r.key: r.consensus for r in score.consensus(df, "key", ["a", "b"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def test_f_tail():
    assert score.f_tail(4.0, 2, 10) == pytest.approx(0.0529, abs=2e-4)
    assert score.f_tail(0.0, 2, 10) == pytest.approx(1.0)


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("quality: {min_confidence: 50, instruments: []}\nclustering: {eps_km: 2.0}\n")
    c = load_config(p)
    assert c.quality.min_confidence == 50 and c.quality.instruments == () and c.clustering.eps_km == 2.0 and c.episodes == Config().episodes
    p.write_text("quality: {typo: 1}")
    with pytest.raises(ValueError):
        load_config(p)


def brute_silhouette(rows):
    by = {}
    for _, l, f in rows:
        by.setdefault(l, []).append(f)
    each = []
    for _, l, f in rows:
        m = {o: sum(math.dist(f, g) for g in fs) / (len(fs) - (o == l) or 1) for o, fs in by.items()}
        a, b = m.pop(l), min(m.values())
        each.append(0.0 if len(by[l]) == 1 else (b - a) / max(a, b))
    return sum(each) / len(each)


@pytest.mark.parametrize("size", [1 << 26, 24 * 50])
def test_silhouette_of_all_rows_in_passes(spark, size):
    """Clusters that passes and blocks cut, a lone row, and many small clusters."""
    rng = random.Random(2)
    rows = [(i, 0 if i < 1 else 1 if i < 160 else 2 + i % 60, [rng.gauss(i % 5, 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, label int, features array<double>")
    assert score.silhouette(df, pass_bytes=size).first()[0] == pytest.approx(brute_silhouette(rows))


def test_silhouette_does_not_sample(spark):
    """Beyond 20,000 rows: two far pairs of clusters, the value is that of all rows in closed form."""
    n = 10_500
    df = spark.range(2 * n + 2).select(F.col("id").alias("key"), F.when(F.col("id") < 2 * n, (F.col("id") % 2).cast("int")).otherwise(2).alias("label"), F.array(F.when(F.col("id") < 2 * n, F.col("id") % 2 * 10.0).otherwise(F.lit(13.0) + 4 * (F.col("id") % 2))).alias("features"))
    near = (3.0 - 4.0) / 4.0, (7.0 - 4.0) / 7.0
    assert score.silhouette(df).first()[0] == pytest.approx((2 * n + sum(near)) / (2 * n + 2), abs=1e-12)


def test_grid_search_scores_each_combination(spark):
    """Against DBSCAN of each combination by itself, with the silhouette of all clustered rows."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    pts = [(i, (i % 6) * 9000 + rng.uniform(-1500, 1500), rng.uniform(-1500, 1500), start + dt.timedelta(days=rng.uniform(0, 9))) for i in range(90)]
    df = spark.createDataFrame(pts, "point_id long, x_proj double, y_proj double, acq_datetime timestamp")
    got = dbscan.grid_search(df, [1.0, 3.0], [2.0, 7.0], [2, 5]).collect()
    assert [(r.eps_km, r.eps_days, r.min_samples) for r in got] == [(a, b, m) for a in (1.0, 3.0) for b in (2.0, 7.0) for m in (2, 5)]
    for r in got:
        labels = dbscan.drop_small(dbscan.dbscan(df, dbscan.neighbours_combined(df, r.eps_km, r.eps_days), r.min_samples), max(3, r.min_samples))
        of = {x.point_id: x.cluster for x in labels.collect()}
        rows = [(i, of[i], (x / 1000, y / 1000, (t - start).total_seconds() / 86400)) for i, x, y, t in pts if of[i] is not None]
        k, noise = len({x[1] for x in rows}), 1 - len(rows) / len(pts)
        s = brute_silhouette(rows) if k > 1 and len(rows) > 10 else -1.0
        assert (r.n_clusters, r.noise_ratio, r.silhouette) == (k, pytest.approx(noise), pytest.approx(s))
        assert r.score == pytest.approx(0.5 * s + 0.3 * (1 - noise) + 0.2 * min(1, k / 100))


def test_grid_search_query_runs_the_whole_grid(spark, monkeypatch):
    from emberwake.plans import clusters

    monkeypatch.setattr(clusters, "prepared", lambda *a: None)
    monkeypatch.setattr(clusters.db, "grid_search", lambda df, *grid: grid)
    assert clusters.grid_search(spark, "") == ([1, 2, 3, 5], [1, 2, 3, 5, 7], [2, 3, 5])


def test_model_queries_run_the_whole_job(spark, sf_dir, monkeypatch):
    """2 to 10 clusters, every algorithm, 10 resamples, over all fields of each vector."""
    from emberwake.plans import QUERIES
    from emberwake.plans import models as plans

    seen = {}
    for name in ("try_k", "suite", "bootstrap", "knn"):
        monkeypatch.setattr(plans.md, name, lambda points, *a, _name=name, **k: seen.update({_name: (score.dims(points), a, k)}))
    for query in ("select_k", "model_suite", "stability_bootstrap", "knn_self_join"):
        QUERIES[query](spark, sf_dir)
    n = len(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first().embedding)
    assert seen == {"try_k": (n, (range(2, 11),), {}), "suite": (n, (), {}), "bootstrap": (n, (4,), {}), "knn": (n, (4,), {})}


def _odd_points(spark):
    rng = random.Random(11)
    at = lambda m: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)
    pts = [(i, at(rng.choice([rng.uniform(0, 40), rng.uniform(0, 40000), 7.0])), rng.choice([0.0, 9000.0]) + rng.uniform(0, 2600), rng.uniform(0, 2600), rng.uniform(50, 100), rng.uniform(0.1, 90), "DN"[i % 2]) for i in range(260)]
    pts += [(900, at(1), None, 0.0, 60.0, 1.0, "D"), (901, at(1), float("nan"), 0.0, 60.0, 1.0, "D"), (902, None, 0.0, 0.0, 60.0, 1.0, "D"), (903, at(1), float("nan"), 0.0, 60.0, 1.0, "D"), (904, at(1), 0.0, 0.0, None, 1.0, None)]
    return spark.createDataFrame(pts, "point_id long, acq_datetime timestamp_ntz, x_proj double, y_proj double, confidence double, frp double, daynight string")


@pytest.mark.parametrize("least", [2, 4])
@pytest.mark.parametrize("kind,args", [("combined", (0.3, 0.4)), ("combined", (0.3, 0.4, ("daynight",))), ("l2", (0.5, 0.8)), ("weighted", (0.5, 0.8)), ("speed", (700.0, 0.5, 3.0)), ("speed", (700.0, 0.05, 0.5))])
def test_clusters_of_a_neighbourhood_are_those_of_its_pairs(spark, kind, args, least):
    df = _odd_points(spark)
    near = getattr(dbscan, f"near_{kind}")(df, *args)
    got = dict(map(tuple, dbscan.dbscan(df, near, least).collect()))
    assert got == dict(map(tuple, dbscan.dbscan(df, near.pairs(), least).collect()))
    assert len(got) == 265 and len({c for c in got.values() if c is not None}) > 1


DENSE = ["merge_daynight", "dbscan_l2", "dbscan_weighted", "drop_small_renumber", "dbscan_border", "dbscan_combined", "dbscan_speed", "quality_drop"]


@pytest.mark.parametrize("name", DENSE)
def test_no_pairs_of_a_dense_place_are_written(spark, tmp_path, monkeypatch, name):
    from emberwake.plans import QUERIES

    df = spark.range(800).selectExpr("id * 2020 + 31 AS event_id", "timestamp_ntz'2024-01-01 08:00:00' + make_dt_interval(0, 0, id % 40 * 20) AS ts", "7L AS user_id", "'view' AS event_type", "3.0D AS value", "'{}' AS props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], dbscan.connected_components

    def counted(edges, *a, **k):
        seen.append(edges.count())
        return real(edges, *a, **k)

    monkeypatch.setattr(dbscan, "connected_components", counted)
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert len({r[1] for r in rows}) == 1 and len(rows) > 300
    assert seen and max(seen) < 10 * len(rows)


def test_pair_distances_are_taken_in_the_one_join(spark, sf_dir):
    from emberwake.plans import QUERIES

    plan = QUERIES["pair_distances"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("name", ["knn", "bgmm", "hdbscan", "hierarchical", "optics"])
def test_models_refuse_no_size(spark, monkeypatch, name):
    from emberwake.operators import models

    monkeypatch.setattr(models, "SMALL", 20)
    x = np.random.default_rng(5).normal(0, 1, (60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, features array<double>")
    if name == "knn":
        got = [tuple(r) for r in models.knn(df, 3, 500).orderBy("key", "rank").select("key", "other").collect()]
        d = ((x[:, None] - x) ** 2).sum(2) + np.diag(np.full(60, np.inf))
        assert got == [(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3]]
    else:
        assert models.RUNNERS[name](df).count() == 60


def test_ward_from_centres_is_the_linkage():
    from emberwake.operators import models

    x = np.vstack([np.random.default_rng(1).normal(c, 1, (40, 5)) for c in (0, 4, 9)])
    for k in (2, 3, 7):
        assert (models._cut_tree(len(x), models.ward(x), k) == models._cut_tree(len(x), models.linkage(x), k)).all()


def test_ward_looks_at_few_pairs_and_in_tasks(spark, monkeypatch):
    """Clusters look through all others about once; copies, ties and chains give the tree of the linkage, in tasks too."""
    from emberwake.operators import models

    real, seen = models._listed, []
    monkeypatch.setattr(models, "_listed", lambda c, size, rows, m: (seen.append(len(c) * len(rows)), real(c, size, rows, m))[1])
    x = np.random.default_rng(3).normal(0, 1, (1500, 8))
    merges = models.ward(x)
    assert sum(seen) < 3 * len(x) ** 2 and [h for *_, h in merges] == pytest.approx([h for *_, h in models.linkage(x)])
    monkeypatch.setattr(models, "_listed", real)
    monkeypatch.setattr(models, "MANY", 10_000)
    copied = np.repeat(x[:100, :3], [1] * 99 + [300], 0)
    chain = np.cumsum(np.arange(1.0, 200))[:, None]
    close = np.repeat(x[:60, :2], [1] * 59 + [100], 0) + np.random.default_rng(4).normal(0, 1e-7, (159, 2))
    for rows in (x[:300], copied, chain, close):
        for use in (None, spark):
            got = models.ward(rows, use)
            assert [h for *_, h in got] == pytest.approx([h for *_, h in models.linkage(rows)], abs=1e-6)
            assert (models._cut_tree(len(rows), got, 5) == models._cut_tree(len(rows), models.linkage(rows), 5)).all()
    for ties in (np.eye(70), np.array([(i, j) for i in range(12) for j in range(12)], float)):
        assert len(models.ward(ties)) == len(ties) - 1
    broken = np.where(np.arange(40)[:, None] == 7, np.nan, x[:40])
    assert len(models.ward(broken)) == 39 and models.ward(x[:1]) == [] and models.ward(np.zeros((0, 0))) == []


@pytest.mark.parametrize("mutual", [True, False])
def test_order_of_reach_comes_from_lists_of_neighbours(mutual):
    """Prim's order by lists and bounds is that over all pairs, with copies (any of which may come first), ties and lone groups."""
    from emberwake.operators import models

    rng = np.random.default_rng(6)
    for x in (rng.normal(0, 1, (1, 2)), rng.normal(0, 1, (300, 3)), np.vstack([rng.normal(c, 1, (90, 4)) for c in (0, 30, 90)]), np.repeat(rng.normal(0, 1, (60, 3)), [1] * 59 + [200], 0), np.array([(i, j) for i in range(15) for j in range(15)], float)):
        n, k = len(x), min(4, len(x) - 1)
        d = ((x[:, None] - x) ** 2).sum(2)
        core = (np.sort(d + np.diag(np.full(n, np.inf)), 1)[:, k - 1] if k else np.zeros(n)) * (1 + 1e-12)
        far = np.maximum(d, core[:, None])
        far, best, here, order, reach = np.maximum(far, core) if mutual else far, np.full(n, np.inf), np.ones(n, bool), [], []
        for t in range(n):
            j = int(np.where(here, best, np.inf).argmin()) if t else 0
            order.append(j)
            reach.append(math.sqrt(best[j]))
            here[j], best = False, np.minimum(best, far[j])
        got, near, source = models._grown(x, models._listed(x, np.ones(n), np.arange(n), models.LISTED), 4, mutual)
        assert near[got] == pytest.approx(reach, abs=1e-7) and len(set(got.tolist())) == n
        assert len(np.unique(x, axis=0)) < n or got.tolist() == order
        assert all(math.sqrt(far[source[j], j]) == pytest.approx(near[j], abs=1e-7) for j in got[1:].tolist())


def test_balls_are_those_of_plain_distances():
    from emberwake.operators import models

    x, limit, plain = np.random.default_rng(8).normal(3, 1, (400, 5)), 1.2, []
    for p in x:
        i = min(range(len(plain)), key=lambda i: ((plain[i][0] - p) ** 2).sum(), default=None)
        if i is not None and ((plain[i][0] - p) ** 2).sum() <= limit * limit:
            plain[i] = (plain[i][0] + (p - plain[i][0]) / (plain[i][1] + 1), plain[i][1] + 1)
        else:
            plain.append((p, 1))
    c, w = models._absorbed(x, np.ones(400), limit)
    assert w.tolist() == [n for _, n in plain] and c == pytest.approx(np.array([m for m, _ in plain]))


def test_mixture_added_up_in_tasks_is_the_same(spark, monkeypatch):
    from emberwake.operators import models

    x = np.vstack([np.random.default_rng(c).normal(c, 1, (80, 3)) for c in (0, 5, 11)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, features array<double>")
    there = {r.key: r.label for r in models.bgmm(df, 3, 12).collect()}
    monkeypatch.setattr(models, "HEAVY", 0)
    assert {r.key: r.label for r in models.bgmm(df, 3, 12).collect()} == there and len(set(there.values())) >= 3
    assert len({there[i] for i in range(80)} & {there[i] for i in range(160, 240)}) == 0


def test_models_on_the_driver_keep_no_blocks_of_distances():
    """Distances to the kth other row take memory for a block, those of all pairs for one matrix."""
    import tracemalloc

    from emberwake.operators import models

    x = np.random.default_rng(2).random((3000, 8))
    for make, most in ((lambda: models._core(x, 4), 30e6), (lambda: models._distances(x), 3000 * 3000 * 8 + 30e6)):
        tracemalloc.start()
        try:
            make()
            assert tracemalloc.get_traced_memory()[1] < most
        finally:
            tracemalloc.stop()


def test_suite_makes_the_balls_of_birch_once(spark, monkeypatch):
    from emberwake.operators import models as md

    made, (arg, make) = [], md.SHARED.get("birch", ("balls", None))
    monkeypatch.setitem(md.SHARED, "birch", (arg, lambda p: (made.append(arg), make(p))[1]))
    df = spark.createDataFrame(_spots(40), "key long, features array<double>")
    got = {r.run_id: r for r in md.suite(df, (2, 3), ("birch",)).collect()}
    assert list(got) == ["birch-2", "birch-3"] and made == ["balls"]
    rows = [(r.key, r.label, r.features) for r in df.join(md.birch(df, 3), "key").collect()]
    assert got["birch-3"].n_clusters == 3 and got["birch-3"].silhouette == pytest.approx(brute_silhouette(rows))


def _spots(n, dims=5, seed=3):
    """Rows around spots that differ in the last fields only, some copies, some far rows."""
    rng = random.Random(seed)
    rows = [(i, [0.0] * (dims - 2) + [6.0 * (i % 3) + rng.gauss(0, 0.3), rng.gauss(0, 0.3)]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(5)] + [(n + 10 + i, [50.0 + 9 * i] * dims) for i in range(6)]
    return [(i * 7919 % 100003, f) for i, f in rows]


@pytest.mark.parametrize("size", [64 << 20, 40 * 50])
def test_dbscan_knee_is_that_of_all_pairs(spark, size, monkeypatch):
    """In one pass and in several; no pair of near rows is joined by place."""
    from emberwake.operators import models as md

    monkeypatch.setattr(md, "eps_pairs", lambda *a, **k: pytest.fail("pairs are written"), raising=False)
    rows = _spots(150)
    far = {i: sorted(math.dist(f, g) for j, g in rows if j != i)[3] for i, f in rows}
    each = sorted(far.values())
    at = 0.9 * (len(each) - 1)
    eps = each[int(at)] + (at - int(at)) * (each[int(at) + 1] - each[int(at)])
    near = {i: [j for j, g in rows if math.dist(f, g) <= eps] for i, f in rows}
    core = {i for i in near if len(near[i]) >= 5}
    want = {i: i for i in core}
    for _ in rows:
        want = {i: min(want[j] for j in near[i] if j in core) for i in core}
    want |= {i: min((want[j] for j in near[i] if j in core), default=-1) for i in near if i not in core}
    df = spark.createDataFrame(rows, "key long, features array<double>")
    got = {r.key: r.label for r in md.dbscan_knee(df, pass_bytes=size).collect()}
    assert got == want and -1 in got.values() and len(set(got.values())) > 3


def test_dbscan_knee_of_few_rows_is_noise(spark):
    from emberwake.operators import models as md

    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "key long, features array<double>")
    assert {r.label for r in md.dbscan_knee(df).collect()} == {-1}


def test_spectral_line_is_the_power_iteration(spark):
    """Against a dense iteration over the same graph; the clusters are stretches of the line."""
    import numpy as np

    from emberwake.operators import models as md

    rows = sorted(_spots(60))
    df = spark.createDataFrame(rows, "key long, features array<double>")
    at = {k: i for i, (k, _) in enumerate(rows)}
    a = np.zeros((len(rows), len(rows)))
    for r in md.knn(df, 4).collect():
        a[at[r.key], at[r.other]] = a[at[r.other], at[r.key]] = math.exp(-r.distance)
    line, before = np.random.default_rng(md.SEED).standard_normal(len(rows)), np.inf
    line /= np.abs(line).sum()
    for _ in range(20):
        new = a @ line / a.sum(1)
        new /= np.abs(new).sum()
        change = np.abs(new - line).sum()
        if abs(before - change) < 1e-5 / len(rows):
            break
        line, before = new, change
    got = {r.key: r.line for r in md.power_line(df, 4).collect()}
    assert [got[k] for k, _ in rows] == pytest.approx(line.tolist(), abs=1e-12)
    of = {r.key: r.label for r in md.spectral(df, 3, 4).collect()}
    order = [of[k] for k in sorted(got, key=got.get)]
    assert len(of) == len(rows) and len(set(order)) == 3 and sum(x != y for x, y in zip(order, order[1:])) == 2


def test_spectral_of_one_row_is_noise(spark):
    from emberwake.operators import models as md

    assert [r.label for r in md.spectral(spark.createDataFrame([(5, [1.0])], "key long, features array<double>")).collect()] == [-1]


@pytest.mark.parametrize("dims,size", [(3, 1 << 26), (12, 1 << 26), (12, 8 * 12 * 50)])
def test_indices_of_several_runs_are_those_of_each(spark, dims, size):
    """Few and many clusters, a lone row, noise, copies, one cluster; distances are taken once for all runs."""
    rng = random.Random(5)
    f = [[rng.gauss(i % 4, 1) for _ in range(dims)] for i in range(160)]
    f[7] = f[3]
    runs = [[i % 4 for i in range(160)], [i // 2 if i else 500 for i in range(160)], [-1 if i % 9 == 0 else None if i % 9 == 1 else i % 3 for i in range(160)], [0] * 160, [i % 4 for i in range(160)]]
    copies = [[1] * 160] * 4 + [[i % 3 for i in range(160)]]
    points = spark.createDataFrame(list(enumerate(f)), "key long, features array<double>")
    labels = spark.createDataFrame([(i, r, runs[r][i], copies[r][i]) for r in range(5) for i in range(160) if copies[r][i]], "key long, run int, label long, n long")
    got = score.indices(points, labels, 5, pass_bytes=size)
    for r, e in enumerate(got):
        rows = [(len(runs) * i + c, l, f[i]) for i, l in enumerate(runs[r]) if l is not None and l >= 0 for c in range(copies[r][i])]
        df = spark.createDataFrame(rows, "key long, label long, features array<double>")
        k = len({l for _, l, _ in rows})
        assert (e["n_clusters"], e["n_noise"]) == (k, sum(n for l, n in zip(runs[r], copies[r]) if l is None or l < 0))
        assert e["inertia"] == pytest.approx(score.inertia(df).first()[0])
        want = [None] * 3 if k < 2 else [brute_silhouette(rows), score.calinski_harabasz(df).first()[0], score.davies_bouldin(df).first()[0]]
        assert [e["silhouette"], e["calinski_harabasz"], e["davies_bouldin"]] == [x if x is None else pytest.approx(x) for x in want]
        sizes = [sum(l == m for _, m, _ in rows) for l in {l for _, l, _ in rows}]
        assert e["cluster_balance"] == min(sizes) / max(sizes)


@pytest.mark.parametrize("apart", [0.3, 30.0])
def test_silhouettes_apart_are_those_of_all_pairs(spark, apart):
    """Bounds leave open what they must: clusters that overlap, far ones, a lone row, noise."""
    rng = random.Random(9)
    f = [[apart * (i % 40 % 7) + rng.gauss(0, 1), apart * (i % 40 // 7) + rng.gauss(0, 1), rng.uniform(0, 9)] for i in range(700)]
    runs = [[i % 40 for i in range(700)], [-1 if i % 5 == 0 else 900 if i == 1 else i % 2 for i in range(700)]]
    df = spark.createDataFrame([(x, [r[i] for r in runs]) for i, x in enumerate(f)], "features array<double>, l array<long>")
    want = [brute_silhouette([(i, l, f[i]) for i, l in enumerate(r) if l >= 0]) for r in runs]
    assert score.silhouettes_apart(df, [1, 0]) == pytest.approx(want[::-1])


def test_grid_search_of_large_components_is_the_same(spark):
    df = _odd_points(spark)
    grid = [0.9], [0.4, 3.0], [4]
    few = dbscan.grid_search(df, *grid).collect()
    many = dbscan.grid_search(df, *grid, most=20).collect()
    assert [tuple(r) for r in few] == [pytest.approx(tuple(r)) for r in many] and len({r.silhouette for r in few}) == 2


def test_suite_shares_what_k_leaves_alone(spark, monkeypatch):
    """Rows of the suite are the indices of each run by itself; the tree and the line are made once for all k."""
    from emberwake.operators import models as md

    made = []
    for name in ("spectral", "hierarchical"):
        arg, make = md.SHARED[name]
        monkeypatch.setitem(md.SHARED, name, (arg, lambda p, _m=make, _a=arg: (made.append(_a), _m(p))[1]))
    df = spark.createDataFrame(_spots(40), "key long, features array<double>")
    got = {r.run_id: r for r in md.suite(df, (2, 3), ("spectral", "hierarchical", "dbscan_knee")).collect()}
    assert list(got) == ["spectral-2", "spectral-3", "hierarchical-2", "hierarchical-3", "dbscan_knee"] and made == ["line", "tree"]
    for name, labels in (("hierarchical-3", md.hierarchical(df, 3)), ("dbscan_knee", md.dbscan_knee(df))):
        rows = [(r.key, r.label, r.features) for r in df.join(labels, "key").where("label >= 0").collect()]
        assert got[name].n_clusters == len({l for _, l, _ in rows}) and got[name].silhouette == pytest.approx(brute_silhouette(rows))
