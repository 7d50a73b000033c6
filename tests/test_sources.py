"""Readers and writers on small files made here."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trackgrid import sources
from trackgrid.operators import raster


def png(path, v):
    h, w = v.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + v[i].tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_rasters(spark, tmp_path):
    v = np.arange(64, dtype=np.uint8).reshape(8, 8)
    png(tmp_path / "my_region_17_5_6.png", v)
    (tmp_path / "bad_1_2.png").write_bytes(b"nothing")
    df = sources.read_rasters(spark, str(tmp_path))
    names = {r["t"] and tuple(r["t"]): r["missing"] for r in df.select("missing", sources.parse_tile_name(F.col("origin")).alias("t")).collect()}
    assert names == {("my_region", 17, 5, 6): False, None: True}
    cells = raster.to_cells(df)
    assert {(r["r"], r["c"]): r["v"] for r in cells.collect()} == {(i, j): int(v[i, j]) for i in range(8) for j in range(8)}
    assert raster.pack(cells, ["origin"], 8).first()["data"] == v.tobytes()


def test_named_files(spark, tmp_path):
    for n in ("m@3.5@60.0@2.5@61.0.tif", "2.5@60.5.png", "1700000000123@2.0@59.0.png", "a@b@c@d.png"):
        (tmp_path / n).write_bytes(b"x")
    m = sources.scan_named_images(spark, str(tmp_path), "map").collect()
    assert len(m) == 1 and (m[0]["lon_min"], m[0]["lat_max"], m[0]["center_lon"]) == (2.5, 61.0, 3.0)
    assert sources.scan_named_images(spark, str(tmp_path), "query").first()["lat"] == 60.5
    assert sources.scan_named_images(spark, str(tmp_path), "frame").first()["stamp"] == "1700000000123"
    assert sources.scan_distractors(spark, str(tmp_path)).filter("lat IS NULL AND role = 'distractor'").count() == 4


def test_tables(spark, tmp_path):
    (tmp_path / "poses.csv").write_text("filepath,x,y,z,roll,pitch,yaw,undulation,landcover\na/b.png,1.5,2,nan,,x,0.1,7,forest\n")
    r = sources.read_poses(spark, str(tmp_path / "poses.csv")).first()
    assert (r["x"], r["z"], r["roll"], r["pitch"], r["landcover"]) == (1.5, None, None, None, "forest")
    (tmp_path / "man.csv").write_text("image_id,path,lat\n,dir/q1.jpg,5\nid2,dir/q2.jpg,bad\n")
    got = {r["image_id"]: r["lat"] for r in sources.read_manifest(spark, str(tmp_path / "man.csv"), ["lat"]).collect()}
    assert got == {"q1": 5.0, "id2": None}
    (tmp_path / "state.csv").write_text("t_sec,lat,lon,sigma_pos_m,map_accepted,obstructed\n0,1,2,3,1,0\n")
    assert sources.read_state_log(spark, str(tmp_path / "state.csv")).first()["map_accepted"] is True
    (tmp_path / "short.csv").write_text("t_sec,lat\n0,1\n")
    with pytest.raises(ValueError):
        sources.read_state_log(spark, str(tmp_path / "short.csv"))
    spark.createDataFrame([(1, "m1"), (2, "m2")], "vec_id long, model_name string").write.parquet(str(tmp_path / "g"))
    with pytest.raises(Exception, match="another model"):
        sources.read_gallery(spark, str(tmp_path / "g"), "m1").collect()
    spark.range(2).select(F.col("id").alias("vec_id"), F.lit("m").alias("model_name")).write.parquet(str(tmp_path / "g2"))
    for name, ids in (("less", [0]), ("twice", [0, 1, 1]), ("other", [0, 2])):
        spark.createDataFrame([(i, 1.0) for i in ids], "vec_id long, lat double").write.parquet(str(tmp_path / name))
        with pytest.raises(Exception, match="rows"):
            sources.read_gallery(spark, str(tmp_path / "g2"), "m", str(tmp_path / name)).collect()
    diag = sources.coerce_diag(spark.createDataFrame([("", "-1", "True")], "a string, b string, f string"), ["a", "b"], ["f"]).first()
    assert (diag["a"], diag["b"], diag["f"]) == (None, -1.0, True)


def test_json(spark, tmp_path):
    truth = {"video": "v", "segments": [{"id": "s1", "start_s": 0, "end_s": 5}, {"id": "s2", "start_s": 5, "end_s": 9}], "expected_dead_reckoning_segments": ["s2"], "track_thresholds": {"max_sigma_pos_m": 60}, "landmarks": [{"id": "l", "t_sec": 1, "lat": 2, "lon": 3}]}
    (tmp_path / "t.json").write_text(json.dumps(truth, indent=1))
    seg, marks = sources.read_landmarks(spark, str(tmp_path / "t.json"))
    assert {r["segment_id"]: (r["dead_reckoning"], r["max_sigma_m"]) for r in seg.collect()} == {"s1": (False, 60.0), "s2": (True, 60.0)}
    assert marks.first()["t"] == 1.0
    (tmp_path / "rules.json").write_text(json.dumps({"class_mapping": {"land:wood": 2, "road.class:track": 4, "road:*": 5}}))
    rules = {(r["layer"], r["attr"], r["value"]): r["class_id"] for r in sources.read_class_rules(spark, str(tmp_path / "rules.json")).collect()}
    assert rules == {("land", None, "wood"): 2, ("road", "class", "track"): 4, ("road", None, "*"): 5}
    anchors = {"video": "v", "anchors": [{"anchor_index": 0, "frame_index": 9, "detections": [{"prompt": "p", "instances": [{"index": 0, "score": 0.5, "accepted": True}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(anchors))
    assert sources.read_anchor_index(spark, str(tmp_path / "a.json"), "v").first()["score"] == 0.5
    with pytest.raises(Exception, match="another video"):
        sources.read_anchor_index(spark, str(tmp_path / "a.json"), "w").collect()
    for run, ok in (("s1__base", True), ("s1__fast", False)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "summary.json").write_text(json.dumps({"passed": ok, "median": 3.5}))
    found = sources.read_run_summaries(spark, str(tmp_path / "runs"), "passed boolean, median double")
    want = spark.createDataFrame([("s1__base",), ("s1__fast",), ("s2__base",)], "run string")
    got = {r["run"]: (r["passed"], r["config"]) for r in sources.with_expected_runs(want, found).collect()}
    assert got == {"s1__base": (True, "base"), "s1__fast": (False, "fast"), "s2__base": (False, None)}


def test_vectors(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 0, 1, 2, 3)
    poly = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    multi = struct.pack(">BII", 0, 6, 1) + struct.pack(">BIII", 0, 3, 1, 4) + b"".join(struct.pack(">2d", *p) for p in ring)
    rows = [(1, bytearray(line), "road"), (2, bytearray(poly), None), (3, bytearray(multi), "x"), (4, bytearray(struct.pack("<BI2d", 1, 1, 5, 6)), "pt"), (5, None, "none")]
    spark.createDataFrame(rows, "id int, geometry binary, class string").write.parquet(str(tmp_path / "l.parquet"))
    got = {r["attrs"]["id"]: r for r in sources.read_layer(spark, str(tmp_path / "l.parquet"), "water").collect()}
    assert len(got) == 4 and got["4"]["parts"] is None and "class" not in got["2"]["attrs"]
    assert [tuple(p) for p in got["1"]["parts"][0]] == [(0.0, 1.0), (2.0, 3.0)]
    assert [got[k]["kind"] for k in "1234"] == ["LineString", "Polygon", "MultiPolygon", "Point"]
    mercator = {r["attrs"]["id"]: r for r in sources.read_layer(spark, str(tmp_path / "l.parquet"), "water", 3857).collect()}
    assert abs(mercator["2"]["parts"][0][1][0] * 111319.49079 - 4) < 1e-6
    with pytest.raises(Exception, match="unknown CRS"):
        sources.read_layer(spark, str(tmp_path / "l.parquet"), "water", 32637).collect()
    assert [tuple(p) for p in got["2"]["parts"][0]] == ring == [tuple(p) for p in got["3"]["parts"][0]]
    features = [{"type": "Feature", "properties": {"class": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert sorted(len(r["parts"]) for r in sources.read_geojson(spark, str(tmp_path / "f.geojson"), "l").collect()) == [1, 2]
    p = lambda *xy: [{"lat": y, "lon": x} for x, y in xy]
    osm = {"elements": [
        {"type": "way", "id": 1, "tags": {"natural": "water", "water": "Pond", "building": "yes"}, "geometry": p((0, 0), (1, 0), (1, 1), (0, 0))}, {"type": "way", "id": 2, "geometry": p((0, 0), (1, 0))}, {"type": "way", "id": 3, "geometry": p((0, 0))},
        {"type": "relation", "id": 4, "members": [{"role": "outer", "geometry": p((0, 0), (1, 0), (1, 1))}, {"role": "", "geometry": p((0, 0), (1, 0), (1, 1))}, {"role": "inner", "geometry": p((0, 0), (1, 0), (1, 1))}]}, {"type": "relation", "id": 5, "members": []},
    ]}
    (tmp_path / "o.json").write_text(json.dumps(osm))
    water = {r["feature_id"]: (r["kind"], len(r["parts"])) for r in sources.read_osm_dump(spark, str(tmp_path / "o.json"), "water").collect()}
    assert water == {1: ("Polygon", 1), 2: ("LineString", 1), 4: ("MultiPolygon", 2)}
    assert sources.read_osm_dump(spark, str(tmp_path / "o.json"), "water").filter("feature_id = 1").first()["class"] == "pond"
    assert sources.resolve_layer(spark, str(tmp_path), "f").count() == 2 and sources.resolve_layer(spark, str(tmp_path), "none") is None
    assert 2 not in {r["feature_id"] for r in sources.read_osm_dump(spark, str(tmp_path / "o.json"), "buildings").collect()}


def test_layer_in_the_crs_of_its_footer(spark, tmp_path):
    """A projected file, CRS84, no CRS, no entry, a folder of files, and a CRS without a code."""
    wkb = struct.pack("<BII4d", 1, 2, 2, 111_319.49079327358, 0.0, 222_638.98158654716, 0.0)
    plain = struct.pack("<BII4d", 1, 2, 2, 1.0, 0.0, 2.0, 0.0)

    def write(name, geometry, crs, entry=True):
        geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": [], **crs}}}
        table = pa.table({"id": [1], "geometry": pa.array([geometry], pa.binary())})
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)} if entry else {}), tmp_path / name)

    write("water.parquet", wkb, {"crs": {"name": "WGS 84 / Pseudo-Mercator", "id": {"authority": "EPSG", "code": 3857}}})
    write("degrees.parquet", plain, {"crs": {"name": "WGS 84 (CRS84)", "id": {"authority": "OGC", "code": "CRS84"}}})
    write("unset.parquet", plain, {"crs": None})
    write("bare.parquet", plain, {}, entry=False)
    write("parts.parquet/part-0.parquet", wkb, {"crs": {"id": {"authority": "EPSG", "code": 3857}}})
    write("odd.parquet", plain, {"crs": {"name": "a local grid"}})
    for name in ("water", "degrees", "unset", "bare", "parts"):
        points = sources.resolve_layer(spark, str(tmp_path), name).first()["parts"][0]
        assert [p["x"] for p in points] == pytest.approx([1.0, 2.0]) and [p["y"] for p in points] == pytest.approx([0.0, 0.0]), name
    with pytest.raises(ValueError, match="a local grid"):
        sources.resolve_layer(spark, str(tmp_path), "odd")
    assert sources.resolve_layer(spark, str(tmp_path), "water", 4326).first()["parts"][0][0]["x"] > 1000


def test_hgt_and_report(spark, tmp_path):
    v = np.zeros((1201, 1201), ">i2")
    v[0, 0], v[3, 7] = -32768, 250
    (tmp_path / "N55E038.hgt").write_bytes(v.tobytes())
    (tmp_path / "N01E001.hgt").write_bytes(b"short")
    df = sources.read_hgt(spark, str(tmp_path))
    assert df.count() == 1201 * 1201 and df.filter("elev IS NULL").collect()[0]["row"] == 0
    r = df.filter("elev > 0").first()
    assert (r["row"], r["col"], r["elev"], r["dem_id"]) == (3, 7, 250.0, "N55E038") and abs(r["north"] - 56 - 1 / 2400) < 1e-9
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sources.write_report(rows, rows, str(tmp_path / "rep"), ["k"])
    assert spark.read.parquet(str(tmp_path / "rep/rows")).count() == 2
    assert [r[0] for r in spark.read.text(str(tmp_path / "rep/summary_md")).collect()][:2] == ["| k | v |", "|---|---|"]
