"""Column functions and selections against plain arithmetic."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgrid.functions import gates, geo
from trackgrid.operators import aggregates, features, joins, retrieval, selection, windows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_frames(spark):
    enu = geo.to_enu(55.1, 38.2, 700.0, 55.0, 38.0, 130.0)
    r = one(spark, e=enu, w=geo.to_wgs84(enu["x_e"], enu["y_n"], enu["z_u"], 55.0, 38.0, 130.0))
    assert np.allclose(r["w"], (55.1, 38.2, 700.0)) and math.isclose(r["e"]["y_n"], 11132.0)
    lat, lon, h = math.radians(47.3), math.radians(8.5), 612.0
    n = geo.WGS84_A / math.sqrt(1 - geo.WGS84_F * (2 - geo.WGS84_F) * math.sin(lat) ** 2)
    x, y = ((n + h) * math.cos(lat) * f for f in (math.cos(lon), math.sin(lon)))
    z = (n * (1 - geo.WGS84_F) ** 2 + h) * math.sin(lat)
    r = one(spark, g=geo.ecef_to_wgs84(x, y, z), d=geo.dist_ecef_m([x, y, z], [x, y + 3, z + 4]), m=geo.dist_ecef_m([x, y, z], [float("nan"), 0.0, 0.0]))
    assert np.allclose(r["g"], (47.3, 8.5, 612.0), atol=1e-6) and math.isclose(r["d"], 5.0) and r["m"] == math.inf
    r = one(spark, c=geo.cov_to_deg(F.array(*map(F.lit, (4.0, 1.0, 1.0, 9.0))), 60.0))["c"]
    k = geo.M_PER_DEG
    assert np.allclose(r, (9 / k**2, 2 / k**2, 2 / k**2, 16 / k**2))
    r = one(spark, p=geo.geo_to_pixel(55.5, 38.25, 38.0, 55.0, 39.0, 56.0, 400, 200), g=geo.pixel_to_geo(100.0, 100.0, 38.0, 55.0, 39.0, 56.0, 400, 200), b=geo.bbox_around(0.0, 10.0, 2 * k), c=geo.clip_window(-3, 5, 900, 50, 400, 40))
    assert tuple(r["p"]) == (100.0, 100.0) and tuple(r["g"]) == (55.5, 38.25) and np.allclose(r["b"], (9, -1, 11, 1)) and tuple(r["c"]) == (0, 5, 400, 40)
    r = one(spark, k=geo.parse_tile_key(F.lit("17/5/6"), "/"), a=geo.norm_epoch_s(F.lit("1700000000123"), 0.0), b=geo.norm_epoch_s(F.lit("x"), 7.0), c=geo.norm_epoch_s(F.lit("1700000000"), 0.0))
    assert tuple(r["k"]) == (17, 5, 6) and (r["a"], r["b"], r["c"]) == (1700000000.123, 7.0, 1700000000.0)


def test_camera(spark):
    r = one(spark, a=geo.raycast_ground(0.0, 0.0, -90.0, 500.0), b=geo.raycast_ground(0.1, 0.0, -45.0, 500.0), c=geo.raycast_ground(0.0, 0.0, 5.0, 500.0))
    assert np.allclose(r["a"], (0, 0), atol=1e-6) and np.allclose(r["b"], (500, 0.1 * 500 / math.sin(math.radians(45)))) and r["c"] is None
    h = geo.h_nadir(-60.0, 500.0, 800.0, 400, 400, 300.0, 300.0, 320.0, 240.0)
    p = geo.h_apply(F.col("h"), 320.0, 240.0)
    q = spark.range(1).select(h.alias("h")).select("h", p.alias("p")).first()
    assert np.allclose(q["p"], (200, 200), atol=1e-6)  # the optical axis hits the view centre
    r = one(spark, v=geo.view_to_platform(55.0, 38.0, 0.0, 500.0, -45.0), n=geo.view_to_platform(55.0, 38.0, 1.0, 500.0, -90.0), s=geo.h_scale(F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0)))))
    assert math.isclose(r["v"]["lat"], 55 - 500 / geo.M_PER_DEG) and tuple(r["n"]) == (55.0, 38.0) and r["s"] == 2.0


def test_gates(spark):
    r = one(spark, a=gates.gate_peak(0.06, 0.5), b=gates.gate_peak(0.2, 0.1, "masks"), c=gates.gate_detection(0.1, 0.2, 0.2, 0.5, 0.6, 0.7), d=gates.gate_detection(0.9, 0.9, 0.2, 0.5, 0.6, 0.7), m=gates.mask_unreliable(F.lit("flow"), 0.2, 0.1, 0), t=gates.track_confidence(80, 1.0, 0.0, F.lit(False)))
    assert tuple(r["a"]) == (True, 50.0) and r["b"]["accepted"] and math.isclose(r["b"]["sigma_m"], 107.5) and r["c"] is None and r["d"]["reason"] == "centre_too_far_right" and r["m"] and math.isclose(r["t"], 0.95)
    assert one(spark, g=gates.gate_fix(9, 9, 0.5, 1.6, 1.0, F.lit(True)))["g"] == "scale_change" and one(spark, g=gates.gate_fix_rigid(0.25, 5.0, F.lit(False), 0.5, 0.5))["g"] == "low_inlier_ratio"
    for rgb in [(255, 255, 250), (10, 60, 200), (200, 30, 30), (0, 0, 0), (90, 120, 40)]:
        c = one(spark, c=gates.hsv(*map(F.lit, rgb)))["c"]
        h, s, v = colorsys.rgb_to_hsv(*(x / 255 for x in rgb))
        assert abs(c["h"] - h * 180) <= 0.51 or c["h"] == 0 and h * 180 > 179.4
        assert abs(c["s"] - s * 255) <= 0.51 and c["v"] == v * 255
    assert one(spark, s=gates.snow_pixel(F.lit(250), F.lit(250), F.lit(250)))["s"] and one(spark, s=gates.sky_pixel(F.lit(80), F.lit(120), F.lit(250)))["s"] and one(spark, s=gates.keep_water(F.lit(20), F.lit(60), F.lit(120)))["s"]


def test_features(spark):
    roads = spark.createDataFrame([("Motorway",), ("footway",), (None,), ("odd",)], "class string")
    assert sorted(r["width_m"] for r in features.road_widths(roads).collect()) == [2.5, 2.5, 7.0]
    rows = spark.createDataFrame([("land_use", {"class": "meadow"}), ("land_cover", {"subtype": "Forest"}), ("water", {}), ("land_use", {"class": "zoo"})], "layer string, attrs map<string,string>")
    assert [r[0] for r in rows.select(features.classify_features_v7(F.col("layer"), F.col("attrs"), 1, 2, 5)).collect()] == [300, 200, 101, None]
    kinds = spark.createDataFrame([("water", "LineString"), ("transportation", "LineString"), ("water", "Polygon")], "layer string, kind string")
    assert features.valid_kinds(kinds).count() == 2
    cells = spark.createDataFrame([(0, 1), (5, 1), (6, 9)], "r int, v int")
    schema = spark.createDataFrame([(1, True), (9, False)], "id int, stable boolean")
    assert [r["v"] for r in features.stable_classes(cells, schema, 10, 0.3).orderBy("r").collect()] == [0, 1, 0]
    assert [r["v"] for r in features.remap_classes(cells, {1: 4}).orderBy("r").collect()] == [4, 4, 0]


@pytest.mark.parametrize("parts", [1, 2, 17])
def test_selections_do_not_depend_on_partitions(spark, parts):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x")).repartition(parts)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(selection.split_random(df, "id", 0.3, 1).filter("split = 'train'")) == ids(selection.split_random(df.coalesce(1), "id", 0.3, 1).filter("split = 'train'"))
    assert selection.split_random(df, "id", 0.3, 1).filter("split = 'train'").count() == 30
    assert len(ids(selection.sample_per_key(df, "k", 4, "id"))) == 12
    assert ids(selection.sample_indices(df, ["k"], ["id"], 3)) == ids(selection.sample_indices(df.coalesce(1), ["k"], ["id"], 3)) and len(ids(selection.sample_indices(df, ["k"], ["id"], 3))) == 9
    assert len(ids(selection.jittered_indices(df, ["k"], ["id"], 5))) == 15
    assert ids(selection.worst_n(df, "x", 3, "id")) == ids(df.orderBy(F.desc("x")).limit(3))
    assert [r["index"] for r in retrieval.with_index(df, ["x"]).orderBy("x").collect()] == list(range(100))
    assert ids(selection.region_except(df.select("id"), df.filter("k = 1").select("id"))) == [i for i in range(100) if i % 3 != 1]


def test_index_of_more_rows_than_ranges_are_drawn_from(spark):
    """The limits of ranges are drawn at random, for the rows and for their counts: a second column keeps Spark from sharing the draw."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("x"), F.col("id").alias("y")).repartition(7)
    got = retrieval.with_index(df, ["x"]).collect()
    assert len(got) == 60_000 and all(r["index"] == r["x"] == r["y"] * 7919 % 60_000 for r in got)


def test_nearest_of_far_anchors(spark):
    """With a weight the key decides between anchors that are nearly as near, as in the query's SQL."""
    rows = spark.createDataFrame([(1, 5_000_001), (1, 5_000_000), (1, 9_000_000), (2, 5_000_002)], "g int, k long")
    anchors = spark.createDataFrame([(1, 0), (1, 10_000_000), (2, 5_000_000), (2, 5_000_003)], "g int, k long")
    pick = lambda w: {(r["g"], r["k"]): r["anchor"] for r in joins.nearest_asof(rows, anchors, ["g"], weight=w).collect()}
    assert pick(None) == {(1, 5_000_001): 10_000_000, (1, 5_000_000): 0, (1, 9_000_000): 10_000_000, (2, 5_000_002): 5_000_003}
    assert pick(1e6) == pick(None) | {(1, 5_000_001): 0}


def test_small_tables(spark):
    seg = spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 6.0), (1, 6.0, 7.0)], "k int, start double, end double")
    assert selection.overlapping(seg, ["k"]).count() == 1
    marks = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 3.0)], "k int, i int, t double")
    assert selection.not_increasing(marks, ["k"], "i", "t").count() == 1
    runs = spark.createDataFrame([("a", 10, 5.0, None, 2.0)], "run string, n_frames int, fps double, lat double, lon double")
    assert [(r["frame_idx"], r["t_sec"], r["lat"], r["lon"]) for r in selection.frame_index(runs, 4, 55.0, 38.0).collect()] == [(0, 0.0, 55.0, 2.0), (4, 0.8, 55.0, 2.0), (8, 1.6, 55.0, 2.0)]
    grid = spark.createDataFrame([("a", 0.5, 9, float("nan")), ("b", 0.5, 9, 2.0), ("c", 0.9, 1, 7.0)], "c string, rate double, inl int, res double")
    assert [r["c"] for r in selection.rank_grid(grid, "rate", "inl", "res", ["c"]).orderBy("rank").collect()] == ["c", "b", "a"]
    tie = spark.createDataFrame([("a", 0.9, 3.0), ("b", 0.8, 1.0), ("c", 0.1, 0.0)], "c string, gate double, residual double")
    assert [(r["c"], r["margin"]) for r in selection.tiebreak_rank(tie, 0.5, "c").orderBy("rank").collect()] == [("b", 2.0), ("a", -3.0), ("c", None)]
    assert selection.discover(marks.select(F.lit("p").alias("path")), marks.select(F.lit("q").alias("path"))).count() == 2
    assert joins.param_grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    assert joins.attach_tiebreak(grid, tie.withColumn("valid", F.lit(1.0)).limit(0), ["c"]).first()["residual"] == 999.0
    lat = aggregates.latency_stats(spark.createDataFrame([(1, float(i)) for i in range(1, 101)], "k int, ms double"), ["k"]).first()
    assert (lat["median_ms"], lat["p95_ms"]) == (50.5, 96.0)
    times = spark.createDataFrame([(1.0, 0.0), (3.0, 5.0)], "a double, b double")
    assert {r["stage"]: r["median_ms"] for r in aggregates.timing_stats(times, ["a", "b"]).collect()} == {"a": 2.0, "b": 5.0}
    diag = spark.createDataFrame([(1, 0, "TRACK", "", 5.0, 0.5, "t1"), (1, 1, "WEAK", "x", -1.0, float("nan"), "t2")], "k int, frame int, state string, reason string, inliers double, ratio double, tile string")
    r = aggregates.diag_summary(diag, ["k"]).first()
    assert (r["track_pct"], r["rejects"], r["median_inliers"], r["median_ratio"], r["tile_changes"]) == (50.0, 1, 2.5, 0.5, 1)
    cov = aggregates.sigma_coverage(spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 9.0, 2.0)], "k int, i int, error double, sigma double"), ["k"], "i").first()
    assert (cov["covered"], cov["monotone"]) == (0.5, True)
    frames = spark.createDataFrame([(1, True, 0.0), (1, False, 0.8)], "k int, fallback boolean, score double")
    assert math.isclose(aggregates.gated_score(frames, ["k"]).first()["score"], 0.25 * 0.8)
    pairs = spark.createDataFrame([(1, 0.5, 3.0, 1.0), (1, 0.7, 500.0, 0.0)], "k int, ratio double, residual double, cheirality double")
    assert tuple(aggregates.pair_summary(pairs, ["k"]).first())[1:] == (0.6, 3.0, 0.5, 2)
    step = aggregates.motion_steps(spark.createDataFrame([(2.0, -4.0, 0.1, 0.5, 9)], "tx double, ty double, theta double, dt double, num_inliers int")).first()
    assert (step["vx"], step["vy"], step["yaw_rate"], step["valid"]) == (-4.0, 8.0, -0.2, True)
    m = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0, True), (1, 1.0, 0.0, 1.0, 0.0, False)], "k int, x0 double, y0 double, x1 double, y1 double, inlier boolean")
    h = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "k int, h array<double>")
    q = aggregates.match_quality(m, h, ["k"]).first()
    assert (q["num_inliers"], q["inlier_ratio"], q["reproj_px"]) == (1, 0.5, 5.0)
    top = spark.createDataFrame([("reference", True, True), ("distractor", False, False)], "top1_role string, exact boolean, inside boolean")
    assert tuple(retrieval.top1_shares(top).first()) == (50.0, 50.0, 50.0, 50.0)
    hop = spark.createDataFrame([(None,), (10.0,), (9000.0,)], "d double")
    assert tuple(retrieval.hop_consistency(hop, F.col("d")).first()) == (50.0, False)
    rr = spark.createDataFrame([(1, 1, 2, 90.0), (1, 2, 1, 5.0)], "query_id int, rank int, new_rank int, error double")
    assert tuple(retrieval.rerank_summary(rr, 25.0).first())[:3] == (0.0, 100.0, 100.0)
    edges = windows.segment_edges(marks, ["k"], ["i"], "t").first()
    assert (edges["first"], edges["last"]) == (1.0, 3.0)
    assert selection.first_sequence(marks, ["k"], "i").count() == 1 and selection.preview_rank(grid.select("c", F.lit(2).alias("n_classes"), F.col("rate").alias("non_background_ratio")), 1, "c").first()["c"] == "a"
    both = joins.pair_tiles(marks.select("i", "t"), seg.select(F.lit(7).alias("i")), ["i"])
    assert both.filter("missing_image").count() == 3 and both.filter("missing_mask").count() == 3
    assert joins.tile_window(spark.createDataFrame([(5, 6)], "x int, y int"), 1).count() == 9


def test_table_functions(spark):
    from trackgrid.functions import udtf

    udtf.register(spark)
    assert spark.sql("SELECT * FROM tile_window(5, 6, 2)").count() == 25
    box = spark.createDataFrame([("a", 37.0, 54.0, 39.0, 56.0)], "region string, w double, s double, e double, n double")
    want = {(r["x"], r["y"]) for r in joins.tiles_in_bbox(box, 7).collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM tiles_in_bbox(37.0D, 54.0D, 39.0D, 56.0D, 7)").collect()} == want


def test_many_ranges_equal_few(spark):
    log = spark.range(200).select("id", (F.col("id") * 0.37).alias("t"), (F.col("id") % 4).alias("k"), (F.col("id") % 50 / 10 + 54).alias("lat"), (F.col("id") % 70 / 10 + 37).alias("lon"))
    seg = spark.range(10).select((F.col("id") * 7.4).alias("start"), (F.col("id") * 7.4 + 7).alias("end"), F.col("id").alias("segment_id"))
    pick = lambda most: sorted((r["id"], r["segment_id"]) for r in joins.assign_segments(log, seg, most=most).collect())
    assert pick(100) == pick(3) and len(pick(3)) > 100
    ends = spark.createDataFrame([(0, 73.6)], "id long, t double")
    assert joins.assign_segments(ends, seg, most=3).count() == joins.assign_segments(ends, seg).count() == 1
    maps = spark.createDataFrame([(1, 0, 37.5, 54.2, 39.1, 56.0), (2, 1, 37.0, 54.0, 40.0, 55.0), (3, 2, 37.0, 54.0, 40.0, 55.0)], "map_id int, ord int, w double, s double, e double, n double")
    best = lambda most: sorted(map(tuple, joins.best_covering(maps, log, ["k"], most).collect()))
    assert best(100) == best(1) and len(best(1)) == 4
