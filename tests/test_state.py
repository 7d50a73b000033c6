"""Keyed state: analytic track scenarios, folds against plain loops, streams against batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgrid import streaming
from trackgrid.operators import aggregates, joins, state, windows

ROWS = "track int, t double, vx double, vy double, yaw_rate double, alt double, alt_sigma double, fix_x double, fix_y double, fix_sigma double, truth_x double, truth_y double"


def scenario(track, seconds, scale=1.0, fixes=lambda t: True, fix_every=2.0, jump=None, seed=1, speed=70.0):
    """Flight to the north at constant speed; vx is the raw velocity, smaller by `scale`."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(int(seconds * 10)):
        t = i / 10
        y = speed * t
        fix = i == 0 or (i % int(fix_every * 10) == 0 and fixes(t))
        off = jump[1] if jump and abs(t - jump[0]) < 0.05 else 0.0
        noise = 0.0 if i == 0 else 1.0  # tracks start at a known state
        rows.append((
            track, t, speed / scale + noise * rng.normal(0, 1.5), noise * rng.normal(0, 1.5), rng.normal(0, 0.002), None, None,
            noise * rng.normal(0, 20) + off if fix else None, y + noise * rng.normal(0, 20) if fix else None, 20.0 if fix else None, 0.0, y,
        ))
    return rows


def test_track_filter_scenarios(spark):
    rows = scenario(1, 60) + scenario(2, 70, fixes=lambda t: t < 30 or t > 60, seed=2) + scenario(3, 40, jump=(20.0, 5000.0), seed=3)
    rows += scenario(4, 300, scale=1.5, seed=11) + [(5, i / 10, None, None, None, None, None, None, None, None, 0.0, 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    known = (5000.0, 5000.0, 100.0, 50.0, 50.0, 50.0, math.radians(10), math.radians(30), 0.3)  # the heading is known roughly
    cfg = state.FilterConfig(sigma0=known, sigma_v=1.5, sigma_yaw_rate=math.radians(0.5), sigma_heading=math.radians(20))
    out = state.filter_tracks(df, ["track"], cfg=cfg).toPandas().sort_values(["track", "t"])
    out["error"] = np.hypot(out.x_e - out.truth_x, out.y_n - out.truth_y)
    one, two, three, four, five = (out[out.track == k].reset_index(drop=True) for k in range(1, 6))
    late = one[one.t > 5]
    assert (late.error < 3 * late.sigma_pos).mean() >= 0.95 and late.error.median() < 50
    assert (one.fix_ok == False).sum() <= 2  # noqa: E712
    gap = two[(two.t > 31) & (two.t < 60)]
    assert (gap.sigma_pos.diff().dropna() > -1e-6).all() and two.error.iloc[-1] < 100
    assert two.sigma_pos.iloc[-1] < gap.sigma_pos.iloc[-1]
    hit = three[np.isclose(three.t, 20.0)]
    assert not hit.fix_ok.iloc[0] and three.error[three.t > 5].max() < 100
    assert abs(four.scale.iloc[-1] - 1.5) < 0.03
    assert (five.sigma_pos.diff().dropna() >= -1e-9).all()
    again = state.filter_tracks(df.repartition(1).orderBy(F.rand(5)), ["track"], cfg=cfg).toPandas().sort_values(["track", "t"])
    assert np.allclose(again.x_e, out.x_e)


def test_hysteresis_equals_the_automaton_and_the_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, float(i), rng.random() < 0.5) for k in range(3) for i in range(200)]
    want = {}
    for k in range(3):
        on = up = down = 0
        for key, t, f in rows:
            if key == k:
                up, down = (up + 1, 0) if f else (0, down + 1)
                on = 1 if f and up >= 2 else 0 if not f and down >= 3 else on
                want[k, t] = bool(on)
    df = spark.createDataFrame(rows, "k int, t double, f boolean")
    got = {(r["k"], r["t"]): r["is_on"] for r in windows.hysteresis(df.repartition(5), "f", 2, 3, ["k"], ["t"]).collect()}
    assert got == want
    for part, cond in enumerate(("t < 77", "t >= 77")):
        df.filter(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema("k int, t double, f boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    streaming.write_state_stream(streaming.hysteresis_stream(source, "k", "f", 2, 3), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    seen = {(r["k"], r["t"]): r["is_on"] for r in out}
    assert len(out) + max(r["late"] for r in out) >= 200
    if not any(r["late"] for r in out):  # files come in any order of equal stamps
        assert seen == want


def test_streams_equal_batches(spark, tmp_path):
    rows = scenario(1, 20) + scenario(2, 15, seed=4)
    df = spark.createDataFrame(rows, ROWS)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    streaming.write_state_stream(streaming.filter_tracks_stream(source, "track"), f"{tmp_path}/f", f"{tmp_path}/cf").awaitTermination()
    a = spark.read.parquet(f"{tmp_path}/f").toPandas().sort_values(["track", "t"])
    b = state.filter_tracks(df, ["track"]).toPandas().sort_values(["track", "t"])
    assert len(a) == len(b) and np.allclose(a.y_n, b.y_n)
    modes = "track int, t double, mode string, obstructed boolean"
    rows = [(k, i * 0.7, "TRACK" if i % 9 else "WEAK", i % 5 == 0) for k in range(2) for i in range(50)]
    plan = spark.createDataFrame(rows, modes)
    plan.coalesce(1).write.parquet(f"{tmp_path}/in2")
    source = spark.readStream.schema(modes).parquet(f"{tmp_path}/in2")
    streaming.write_state_stream(streaming.schedule_stream(source, "track"), f"{tmp_path}/s", f"{tmp_path}/cs").awaitTermination()
    key = lambda r: (r["track"], r["t"], r["runs"])
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/s").collect())) == sorted(map(key, state.thin_schedule(plan, ["track"]).collect()))


def test_ordered_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Rows up to 3 s late, in four deliveries and two runs; one row behind the watermark is dropped and counted."""
    rows = [(r[0], r[1] + 10, *r[2:]) for r in scenario(1, 40) + scenario(2, 30, seed=4) + scenario(3, 25, seed=5)]
    rng = random.Random(1)
    came = sorted(rows, key=lambda r: r[1] + rng.random() * 3)
    end = max(r[1] for r in rows)
    closing = (9, end + 100.0, *[None] * (len(rows[0]) - 2))
    late = (1, 0.5, *rows[0][2:])
    parts = [came[len(came) * i // 4 : len(came) * (i + 1) // 4] for i in range(4)]
    runs = [parts[:2], [*parts[2:], [closing], [late, (9, end + 300.0, *closing[2:])]]]
    dropped = 0
    for run in runs:
        for part in run:
            spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with streaming.typed_state(spark):
            q = streaming.write_state_stream(streaming.filter_tracks_ordered(source, "track", 3.0), f"{tmp_path}/out", f"{tmp_path}/cp")
            q.awaitTermination()
        dropped += streaming.late_rows(q)
    got = spark.read.parquet(f"{tmp_path}/out").filter("track < 9").toPandas().sort_values(["track", "t"]).reset_index(drop=True)
    want = state.filter_tracks(spark.createDataFrame(rows, ROWS), ["track"]).toPandas().sort_values(["track", "t"]).reset_index(drop=True)
    assert dropped == 1 and len(got) == len(want) == len(rows)
    assert np.allclose(got[["x_e", "y_n", "sigma_pos"]], want[["x_e", "y_n", "sigma_pos"]])
    assert got.fix_ok.astype(object).where(got.fix_ok.notna(), None).tolist() == want.fix_ok.astype(object).where(want.fix_ok.notna(), None).tolist()


def test_ordered_stream_of_many_tracks_in_few_groups(spark, tmp_path):
    """The tracks of a group step together, and each one goes on where its own state is; a track may begin late."""
    rows = [(k, r[1] + 10 + k % 3, *r[2:]) for k in range(12) for r in scenario(k, 12, seed=k)]
    rows.sort(key=lambda r: r[1] + r[0] % 5 * 0.5)
    closing = (99, max(r[1] for r in rows) + 100.0, *[None] * (len(rows[0]) - 2))
    for part in (rows[:70], [*rows[70:], closing]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with streaming.typed_state(spark):
        streaming.write_state_stream(streaming.filter_tracks_ordered(source, "track", 4.0, groups=2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").filter("track < 99").toPandas().sort_values(["track", "t"])
    want = state.filter_tracks(spark.createDataFrame(rows, ROWS), ["track"]).toPandas().sort_values(["track", "t"])
    assert len(got) == len(want) == len(rows) and np.allclose(got[["track", "t", "x_e", "y_n", "sigma_pos"]], want[["track", "t", "x_e", "y_n", "sigma_pos"]])


def test_history_stream(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streaming.history_stream(source, "k", "ts", 20, 10).writeStream.format("memory").queryName("h").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("h").filter("n = 10").count() >= 10


def test_folds(spark):
    rows = [(1, i, c, s) for i, (c, s) in enumerate([(0.7, True), (0.7, True), (0.7, True), (0.7, True), (0.1, False), (0.1, False), (0.2, True), (0.2, True), (0.9, True)])]
    df = spark.createDataFrame(rows, "k int, i int, confidence double, success boolean")
    got = [r["state"] for r in state.streak_states(df, ["k"], ["i"]).orderBy("i").collect()]
    assert got == ["RELOCALIZE", "WEAK", "TRACK", "TRACK", "TRACK", "WEAK", "WEAK", "RELOCALIZE", "RELOCALIZE"]
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 10.0, 0.0, 1.6), (1, 2, 20.0, 0.0, 1.4), (1, 3, 9000.0, 0.0, 1.4)], "k int, i int, x double, y double, scale double")
    assert [r["gate_reason"] for r in state.gate_vs_last(df, ["k"], ["i"]).orderBy("i").collect()] == [None, "scale_change", None, "jump"]
    pts = [(1, f, f, 100.0 + f % 3, 0.0) for f in range(6)] + [(1, 6, 6, 9000.0, 0.0), (1, 7, 7, 9001.0, 0.0), (2, 0, 0, 0.0, 0.0)]
    seed = state.bootstrap_seed(spark.createDataFrame(pts, "k int, frame int, ord int, x double, y double"), ["k"], 8, 50.0).collect()
    assert len(seed) == 1 and seed[0]["n_frames"] == 6 and math.isclose(seed[0]["seed_x"], 101.0)


def test_fuse_channels(spark):
    motion = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 0.0) for i in range(5)], "k int, frame int, t double, vx double, vy double, yaw_rate double")
    fixes = [(1, 0, "appearance", 0.0, 0.0, 10.0), (1, 2, "appearance", 5.0, 0.0, 10.0), (1, 2, "structural", 3000.0, 0.0, 10.0), (1, 3, "appearance", 2.0, 0.0, 10.0), (1, 3, "structural", 4.0, 0.0, 10.0)]
    out = state.fuse_channels(spark.createDataFrame(fixes, "k int, frame int, channel string, x double, y double, sigma double"), motion, ["k"]).orderBy("t", "ord").collect()
    by = {(r["frame"], r["ord"]): r for r in out}
    assert len(out) == 10 and by[2, 1]["reject_code"] == by[2, 2]["reject_code"] == "consistency_reject" and by[2, 1]["fix_ok"] is None
    assert by[3, 1]["fix_ok"] and by[3, 2]["fix_ok"] and abs(out[-1]["x_e"]) < 15


def test_interpolation_equals_numpy(spark):
    t = [0.0, 1.0, 4.0, 4.5]
    v = [1.0, 3.0, -1.0, 7.0]
    x = [-0.5, 0.0, 0.25, 1.0, 2.0, 4.25, 4.5, 5.0]
    log = spark.createDataFrame([(1, a) for a in x], "k int, t double")
    truth = spark.createDataFrame([(1, a, b) for a, b in zip(t, v)], "k int, t double, v double")
    got = {r["t"]: r["true_v"] for r in joins.interp_asof(log, truth, ["v"], ["k"]).collect()}
    for a in x:
        assert got[a] is None if not 0 <= a <= 4.5 else math.isclose(got[a], np.interp(a, t, v))


@pytest.mark.parametrize("n", [5, 40])
def test_robust_fit(spark, n):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(n, 2)) * 50
    q = p @ np.array([[0.8, 0.6], [-0.6, 0.8]]) + [3, -4]
    q[0] += 500
    df = spark.createDataFrame([(1, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q))], "k int, i int, x0 double, y0 double, x1 double, y1 double")
    r = aggregates.rigid_fit_ransac(df, ["k"], 1.0).first()
    assert r["num_inliers"] == n - 1 and math.isclose(r["theta"], math.atan2(0.6, 0.8), abs_tol=1e-6) and r["rms"] < 1e-4
