import json
import os

from pyspark.sql import functions as F

from emberwake.plans import pipelines, views
from emberwake.sources import io
from emberwake.streaming import sessions as st


def test_detections_json(spark, tmp_path):
    rows = [{"latitude": "40.5", "longitude": -120, "acq_date": "2020-01-02", "acq_time": 30, "confidence": "high", "frp": 1.5, "instrument": "MODIS"}, {"latitude": None, "longitude": 1, "acq_date": "2020-01-02", "acq_time": "1230", "confidence": 80, "frp": 0}]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    got = io.scan_detections_json(spark, str(tmp_path / "d.json")).orderBy("latitude").collect()
    assert got[0].latitude is None and got[1].confidence is None and str(got[1].acq_datetime) == "2020-01-02 00:30:00"


def test_zones_geojson_and_sinks(spark, tmp_path):
    square = [[[-120, 40], [-119, 40], [-119, 41], [-120, 41], [-120, 40]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"HUC12": "1"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"huc_12": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "z.json").write_text(json.dumps(doc))
    z = io.zone_areas(io.scan_zones_geojson(spark, str(tmp_path / "z.json"))).orderBy("huc12").collect()
    assert [r.huc12 for r in z] == ["1", "2"] and abs(z[1].area_km2 - 2 * z[0].area_km2) < 1e-6 and 9000 < z[0].area_km2 < 9500
    df = io.scan_zones_geojson(spark, str(tmp_path / "z.json"))
    io.sink_geojson_polygons(df, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {x["properties"]["huc12"] for x in lines} == {"1", "2"}
    assert df.select(io.wkt(F.col("polygons")).alias("w")).first().w.startswith("MULTIPOLYGON (((")
    io.sink_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert io.sink_json(df.agg(F.count("*").alias("n")), tmp_path / "s.json") == {"n": 2}
    assert "| huc12 |" in io.sink_report({"zones": df.select("huc12")}, tmp_path / "r.md")


def test_stage_is_not_made_twice(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert io.stage(spark, str(tmp_path), "a", make).count() == io.stage(spark, str(tmp_path), "a", make).count() == 3
    assert len(calls) == 1 and io.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a")]).endswith("/a")


def test_pipelines(spark, sf_dir, tmp_path):
    raw = views.detections(spark, sf_dir)
    z = views.zone_boxes(spark, sf_dir)
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))
    zones = z.select(F.col("zone_id").cast("string").alias("huc12"), F.array(F.array(ring)).alias("polygons"))
    a = pipelines.pipeline_a(spark, raw, zones, str(tmp_path / "a"))
    assert a["zones"].count() == zones.count() and a["episodes"].count() > 0
    assert a["zones"].agg(F.max("hsbf")).first()[0] <= 1
    b = pipelines.pipeline_b(spark, raw, zones, str(tmp_path / "b"))
    assert b["zones"].where("episode_count > 0").count() > 0
    c = pipelines.pipeline_c(spark, b["zones"], str(tmp_path / "c"), ["episode_count", "mean_burned_area", "mean_frp", "hsbf"], ks=(3,), algorithms=("kmeans",))
    assert c["runs"].count() == 1


def test_sessions_on_a_stream_agree_with_batch(spark, sf_dir, tmp_path):
    d = views.detections(spark, sf_dir).withColumn("acq_datetime", F.col("acq_datetime").cast("timestamp"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = st.sessions(stream, "user_id", "12 hours", late="1 hour").writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select user_id, start_time, n from found").collect()}
    want = {tuple(r) for r in st.sessions(d, "user_id", "12 hours").select("user_id", "start_time", "n").collect()}
    assert got and got <= want


def test_discard_deletes_the_files_of_a_cut(spark):
    from emberwake.session import cut, discard, tidy

    kept, gone = cut(spark.range(50)), tidy(spark.range(70).repartition(3))
    file = gone._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert gone.count() == 70 and os.path.isdir(file)
    discard(gone)
    assert not os.path.exists(file) and kept.count() == 50
