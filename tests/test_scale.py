"""Steps whose work must not pile up in one task: the same results, and plans that deal it."""

import random

from pyspark.sql import functions as F

from trackgrid.operators import aggregates, joins, raster


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_times_are_counted_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 - 5.0).alias("a"), F.lit(None).cast("double").alias("b"))
    out = aggregates.timing_stats(df, ["a", "b"])
    assert [(r["stage"], r["median_ms"], round(r["p95_ms"], 6)) for r in out.collect()] == [("a", 497.5, 944.35)]
    assert "percentile(" not in plan(out) and "median(" not in plan(out)


def test_changes_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if i % 9 else None, i, rng.choice([1, 2, 3, None])) for i in range(300)]
    want: dict = {}
    for k in ("a", "b", None):
        own = [v for key, _, v in rows if key == k]
        want[k] = sum(x is not None and y is not None and x != y for x, y in zip(own, own[1:]))
    df = spark.createDataFrame(rows, "k string, frame int, tile int").repartition(5)
    for most in (7, 1000):
        assert {r["k"]: r["changes"] for r in aggregates.changes(df, ["k"], "frame", "tile", most).collect()} == want


def test_hypotheses_are_not_copies_of_all_points(spark):
    rows = [(k, i, float(i % 7), float(i * i % 11), float(i % 7) + 3 + 400 * (i % 5 == 0), float(i * i % 11) - 2) for k in (1, 2) for i in range(60)] + [(3, 0, 1.0, 1.0, 2.0, 2.0)]
    out = aggregates.rigid_fit_ransac(spark.createDataFrame(rows, "k int, i int, x0 double, y0 double, x1 double, y1 double"), ["k"], 1.0)
    got = {r["k"]: (r["num_inliers"], round(r["tx"], 6), round(r["ty"], 6)) for r in out.collect()}
    assert got[1] == got[2] == (48, 3.0, -2.0) and got[3] == (1, 1.0, 1.0)
    assert "explode(sequence(" not in plan(out) and "explode([0,1,2" not in plan(out)


def test_points_of_one_place_are_looked_up_once(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("f"), (F.col("id") % 2 * 5.0).alias("x"), F.lit(0.0).alias("y"))
    df = df.withColumn("f", F.when(F.col("x") > 0, F.col("f") + 10).otherwise(F.col("f")))
    for r, n in ((4.0, 3), (5.0, 6)):
        out = joins.radius_neighbors(df, r, "id", "f")
        assert out.count() == 3000 and out.filter(f"n_frames <> {n}").count() == 0
    made = plan(out).split("Generate")[-1]
    assert "Aggregate [x" in made[: made.find("Aggregate") + 20]


def test_quads_of_tiles_of_few_files(spark, monkeypatch):
    monkeypatch.setattr(joins, "MANY", 50)
    tiles = spark.range(400).select(F.lit("a").alias("region"), (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y")).coalesce(1)
    out = joins.tile_quads(tiles.unionByName(tiles))
    assert out.count() == 19 * 19 and "RepartitionByExpression [region" in plan(out)


def test_masks_of_tiles_of_few_files(spark, monkeypatch):
    monkeypatch.setattr(joins, "MANY", 100, raising=False)
    k = F.col("id").cast("double")
    tiles = spark.range(20).select("id", k.alias("w"), F.lit(0.0).alias("s"), (k + 1).alias("e"), F.lit(1.0).alias("n")).coalesce(1)
    at = lambda x, y: F.struct((k + x).alias("x"), F.lit(float(y)).alias("y"))
    shapes = spark.range(20).select("id", F.array(F.array(at(0, 0), at(0.5, 0), at(0.5, 1), at(0, 1))).alias("parts"), F.lit(1).alias("cls"))
    out = raster.burn_polygons(tiles, shapes, 8, ["id"])
    assert out.count() == 20 * 32 and out.filter("c > 3").count() == 0 and "RepartitionByExpression [id" in plan(out)


def test_segments_that_lines_share(spark):
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    lines = spark.range(500).select(F.lit(1).alias("g"), F.lit(1.0).alias("width_m"), F.array(F.array(at(0, 0), at(9, 0))).alias("parts"))
    cells = spark.range(100).select(F.lit(1).alias("g"), F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c"))
    out = joins.cells_near_lines(cells.withColumn("x", F.col("c").cast("double")).withColumn("y", F.col("r").cast("double")), lines, ["g"])
    assert out.count() == 20 and plan(out).count("Aggregate") == 2


def test_layers_have_more_files_for_more_features(spark, monkeypatch):
    from trackgrid import queries_files

    files, write = [], queries_files._text
    monkeypatch.setattr(queries_files, "LAYER_ROWS", 5, raising=False)
    monkeypatch.setattr(queries_files, "_text", lambda df, key, path: files.append(df.count()) or write(df, key, path))
    assert queries_files.resolve_layer(spark, "/root/testdata/sf0.001").count() == 150 + 100 and files[0] > 20


def test_template_cells_go_to_the_blocks_that_offsets_reach(spark):
    rng = random.Random(6)
    every = spark.createDataFrame([(r, c) for r in range(16) for c in range(16)], "r int, c int")
    assert joins.reached_blocks(every, 4, 16).count() == 24 * 24  # nine blocks each would be 2304 rows
    for most, side in ((4, 16), (3, 1), (0, 4)):
        cells = lambda n: [(rng.randint(0, 1), rng.randint(0, 1), rng.randint(-20, 40), rng.randint(-20, 40), rng.randint(1, 3) * 1.0) for _ in range(n)]
        one, two = cells(150), cells(150)
        want = {}
        for k, cls, r, c, w in one:
            for k2, cls2, r2, c2, _ in two:
                if (k, cls) == (k2, cls2) and max(abs(r2 - r), abs(c2 - c)) <= most:
                    want[k, r2 - r, c2 - c] = want.get((k, r2 - r, c2 - c), 0) + w
        made = [spark.createDataFrame(x, "pair_id int, cls int, r int, c int, w double") for x in (one, two)]
        got = joins.offset_votes(*made, most, side=side).select("pair_id", "dr", "dc", "votes").collect()
        assert {(x[0], x[1], x[2]): x[3] for x in got} == want and len(got) == len(want)


def test_class_edges_are_counted_where_they_are_made(spark):
    rng = random.Random(7)
    cells = [(k, rng.randrange(9), rng.randrange(9), rng.randint(0, 2)) for k in range(6) for _ in range(rng.randint(1, 30))]
    cells = list({(k, r, c): (k, r, c, v) for k, r, c, v in cells}.values())
    sizes = [(9, 9), (9, 300_000)]  # the second in bands
    for height, width in sizes:
        want = set()
        for k, cls in {(k, v) for k, _, _, v in cells if v}:
            own = {(r, c) for k2, r, c, v in cells if (k2, v) == (k, cls)}
            edge = {(r + i, c + j) for r, c in own for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < height and 0 <= c + j < width} - own
            want |= {(k, cls, *x) for x in edge if len(edge) >= 24}
        out = raster.class_edges(spark.createDataFrame(cells, "k int, r int, c int, v int"), ["k"], height, width, 24)
        assert {(x["k"], x["cls"], x["r"], x["c"]) for x in out.collect()} == want and out.count() == len(want)
        if height * width < 1 << 20:
            assert plan(out).count("MapInArrow") == 1 and "Join" not in plan(out)
