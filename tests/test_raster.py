"""Raster cells against NumPy."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackgrid.operators import aggregates, joins, raster

RNG = np.random.default_rng(3)


def cells_of(spark, v, key=1, name="k"):
    rows = [(key, r, c, int(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1])]
    return spark.createDataFrame(rows, f"{name} int, r int, c int, v int").repartition(3)


def grid(df, shape, value=None):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["r"], r["c"]] = r[value] if value else 1
    return out


def moved(m, i, j, fill):
    out = np.full_like(m, fill)
    h, w = m.shape
    out[max(0, -i) : h - max(0, i), max(0, -j) : w - max(0, j)] = m[max(0, i) : h - max(0, -i), max(0, j) : w - max(0, -j)]
    return out


@pytest.mark.parametrize("kind", ["rect", "ellipse"])
def test_morphology(spark, kind):
    m = RNG.random((12, 14)) < 0.6
    steps = raster.neighbourhood(kind, 3)
    own = cells_of(spark, m).filter("v = 1").select("k", "r", "c")
    want = np.any([moved(m, -i, -j, False) for i, j in steps], axis=0)
    assert (grid(raster.dilate(own, ["k"], 12, 14, 3, kind), m.shape) == want).all()
    want = np.all([moved(m, i, j, True) for i, j in steps], axis=0)
    assert (grid(raster.erode(own, ["k"], 12, 14, 3, kind), m.shape) == want).all()
    band = grid(raster.edge_band(own, ["k"], 12, 14, 2.0, 1.0), m.shape)
    full = raster.neighbourhood("rect", 3)
    assert (band == (np.any([moved(m, i, j, False) for i, j in full], axis=0) & ~np.all([moved(m, i, j, True) for i, j in full], axis=0))).all()
    a, b = cells_of(spark, m), cells_of(spark, ~m)
    assert grid(raster.raster_and(a, b, ["k"]), m.shape).sum() == 0
    assert (grid(raster.raster_or(a, b, ["k"]), m.shape, "v") == 1).all()


@pytest.mark.parametrize("kind, k", [("rect", 3), ("rect", 4), ("ellipse", 5)])
def test_morphology_in_bands(spark, kind, k):
    """Bands with halos, stacks of rasters, rasters over several batches, null keys, repeated rows and cells outside."""
    masks = {"a": RNG.random((40, 30)) < 0.6, "b": RNG.random((40, 30)) < 0.1, None: RNG.random((40, 30)) < 0.9}
    rows = [(name, int(r), int(c)) for name, m in masks.items() for r, c in zip(*np.nonzero(m))]
    cells = spark.createDataFrame([*rows, *rows[:50], ("a", -1, 3), ("b", 2, 30), ("b", None, 3)], "k string, r int, c long").repartition(3)
    steps = raster.neighbourhood(kind, k)
    want = {}
    for name, m in masks.items():
        on = np.any([moved(m, -i, -j, False) for i, j in steps], axis=0)
        want[name] = np.all([moved(on, i, j, True) for i, j in steps], axis=0)
    work = lambda on, inside: raster._shrunk(raster._grown(on, inside, k, kind), inside, k, kind)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for most in (90, 700, 1 << 20):
            got = raster._stencil(cells, ["k"], 40, 30, 2 * k, work, most)
            assert got.schema == cells.schema
            got = sorted(got.collect(), key=str)
            assert got == sorted(((name, int(r), int(c)) for name, m in want.items() for r, c in zip(*np.nonzero(m))), key=lambda x: str(Row(k=x[0], r=x[1], c=x[2])))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_resample_and_hash(spark):
    v = RNG.integers(0, 255, (16, 18))
    c = cells_of(spark, v)
    near = grid(raster.resample(c, ["k"], 16, 18, 7, 30, "nearest"), (7, 30), "v")
    assert (near == v[np.arange(7) * 16 // 7][:, np.arange(30) * 18 // 30]).all()
    small = v.reshape(8, 2, 9, 2).mean(axis=(1, 3))
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    want = f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
    assert raster.dhash(c, ["k"], 16, 18).first()["dhash"] == want


def test_correlation_search(spark):
    scene, size = RNG.random((24, 26)) < 0.4, 12
    template = scene[7 : 7 + size, 5 : 5 + size].copy()
    template[RNG.random(template.shape) < 0.05] ^= True
    rows = lambda m: spark.createDataFrame([(1, 2, int(r), int(c), 1.0) for r, c in zip(*np.nonzero(m))], "pair_id int, cls int, r int, c int, w double")
    got = raster.mask_match(rows(template), rows(scene), size, 24, 26, 2, least=20).first()
    ncc = np.zeros((13, 15))
    t = template - template.mean()
    for i in range(13):
        for j in range(15):
            s = scene[i : i + size, j : j + size] - scene[i : i + size, j : j + size].mean()
            ncc[i, j] = (t * s).sum() / np.sqrt((t * t).sum() * (s * s).sum())
    assert (got["dr"], got["dc"]) == (7, 5) == np.unravel_index(ncc.argmax(), ncc.shape)
    assert abs(got["peak"] - ncc.max()) < 1e-9
    far = ncc.copy()
    far[5:10, 3:8] = -2
    assert abs(got["margin"] - (ncc.max() - far.max())) < 1e-9


def test_shift_and_overlap(spark):
    m = RNG.random((20, 20)) < 0.15
    one = cells_of(spark, m, name="tile_id").filter("v = 1").select("tile_id", "r", "c")
    other = one.withColumn("r", F.col("r") + 3).withColumn("c", F.col("c") - 2)
    r = raster.tile_shift(other, one, 5, 1).first()
    assert (r["dx"], r["dy"], r["response"]) == (-2, 3, 1.0)
    assert raster.edge_overlap(one, one, ["tile_id"]).first()["edge_overlap"] == 1.0
    assert raster.edge_overlap(one.limit(0), one, ["tile_id"]).first()["flagged"]


def test_texture(spark):
    flat, rough = np.full((32, 32), 7), RNG.integers(0, 255, (32, 32))
    c = cells_of(spark, flat, 1).unionByName(cells_of(spark, rough, 2)).unionByName(cells_of(spark, flat[:4, :4], 3)).withColumn("valid", F.lit(True))
    got = {r["k"]: r for r in raster.texture_votes(raster.texture_metrics(c, ["k"], 32, 32)).collect()}
    assert got[1]["raw_obstructed"] and not got[2]["raw_obstructed"] and got[3]["votes"] == 0 and got[3]["std"] is None
    p = np.bincount(rough.ravel(), minlength=256) / rough.size
    assert abs(got[2]["entropy"] + (p[p > 0] * np.log2(p[p > 0])).sum()) < 1e-9 and abs(got[2]["std"] - rough.std()) < 1e-9
    lap = np.abs(rough[:-2, 1:-1] + rough[2:, 1:-1] + rough[1:-1, :-2] + rough[1:-1, 2:] - 4 * rough[1:-1, 1:-1])
    mask = raster.texture_mask(cells_of(spark, rough), ["k"], 75)
    assert mask.count() == (lap >= np.percentile(lap, 75)).sum()


def test_classes_and_patches(spark):
    v = np.zeros((12, 12), int)
    v[2:9, 2:9] = 3
    edges = raster.class_edges(cells_of(spark, v), ["k"], 12, 12, 10)
    assert edges.count() == 9 * 9 - 7 * 7 and raster.class_edges(cells_of(spark, v), ["k"], 12, 12, 50).count() == 0
    tiles = spark.createDataFrame([("a_b", x, y) for x in range(2) for y in range(2)] + [("z", 0, 0)], "region string, x int, y int")
    c = tiles.crossJoin(cells_of(spark, v).drop("k"))
    r = raster.make_patches(tiles, c, 12, 0.1, 0.9).collect()
    assert len(r) == 1 and r[0]["classes_present"] == [0, 3] and abs(r[0]["non_background_ratio"] - 49 / 144) < 1e-9
    hsv = cells_of(spark, v).select("k", F.lit(10).alias("h"), F.lit(20).alias("s"), F.col("v").alias("v"))
    f = np.array(raster.visual_feature(hsv, "k").first()["feature"])
    assert len(f) == 194 and abs((f * f).sum() - 1) < 1e-9
    best = raster.burn(spark.createDataFrame([(1, 0, 0, 3), (1, 0, 0, 4), (1, 0, 1, 9)], "k int, r int, c int, cls int"), [4, 3, 1, 2], ["k"]).collect()
    assert [(b["r"], b["c"], b["v"]) for b in best] == [(0, 0, 4)]
    assert aggregates.class_iou(cells_of(spark, v), cells_of(spark, v), ["k"], 10).first()["iou"] == 1.0


def test_visual_feature_of_many(spark):
    """Values against NumPy; arrays aren't filled element by element in a lambda, which took minutes."""
    k = F.col("k")
    cells = spark.range(40 * 30).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).alias("i")).select("k", ((k * 7 + F.col("i") * 31) % 180).alias("h"), ((k + F.col("i") * 9) % 256).alias("s"), (k * F.col("i") % 256).alias("v"))
    df = raster.visual_feature(cells, "k")
    rows = cells.toPandas()
    for r in df.collect():
        own = rows[rows.k == r["k"]]
        f = np.bincount(own.h * 12 // 180 * 16 + own.s * 4 // 256 * 4 + own.v * 4 // 256, minlength=194) / len(own)
        f[192:] = own.v.mean() / 255, own.v.std(ddof=0) / 255
        assert np.allclose(r["feature"], f / np.sqrt((f * f).sum()), atol=1e-9)
    assert df.count() == 40 and "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()


def plain_canny(v, low, high):
    h, w = v.shape
    at = lambda r, c: int(v[min(max(r, 0), h - 1), min(max(c, 0), w - 1)])
    m, grad = {}, {}
    for r in range(h):
        for c in range(w):
            x = sum(k * (at(r + i, c + 1) - at(r + i, c - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            y = sum(k * (at(r + 1, c + j) - at(r - 1, c + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            m[r, c], grad[r, c] = abs(x) + abs(y), (x, y)
    level = {}
    for (r, c), (x, y) in grad.items():
        n, angle = m[r, c], np.degrees(np.arctan2(abs(y), abs(x)))
        near = lambda i, j: m.get((r + i, c + j), 0)  # noqa: B023, E731
        if angle < 22.5:
            top = n > near(0, -1) and n >= near(0, 1)
        elif angle > 67.5:
            top = n > near(-1, 0) and n >= near(1, 0)
        else:
            s = -1 if (x < 0) != (y < 0) else 1
            top = n > near(-1, -s) and n > near(1, s)
        if top and n > low:
            level[r, c] = n > high
    found = todo = [p for p, strong in level.items() if strong]
    found = set(found)
    while todo:
        r, c = todo.pop()
        new = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & set(level) - found
        found |= new
        todo += new
    return found


def test_canny(spark):
    """Edges against loops over pixels, in whole rasters and in bands of rows that edges cross."""
    rng = np.random.default_rng(5)
    images = [np.kron(rng.integers(0, 256, (6, 5)), np.ones((4, 4), int)), rng.integers(0, 256, (24, 20)), np.add.outer(np.arange(24) * 9, np.arange(20)) % 256]
    images.append(np.where(np.arange(20)[None] >= 9, np.linspace(60, 25, 24).astype(int)[:, None], 0))  # strong at the top only
    cells = spark.createDataFrame([(k, r, c, int(v)) for k, image in enumerate(images) for (r, c), v in np.ndenumerate(image)], "k int, r int, c int, v int")
    want = {(k, *p) for k, image in enumerate(images) for p in plain_canny(image, 80, 160)}
    assert len({p for p in want if p[0] == 3}) > 16
    for most in (raster.MOST, 60):
        got = raster.canny(cells.unionByName(cells.limit(9)), ["k"], 24, 20, most=most).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_visual_feature_with_edges(spark):
    """All 195 numbers against NumPy and colorsys; a cell of no color, one without neighbours."""
    import colorsys

    rng = np.random.default_rng(6)
    images = [np.stack([rng.integers(0, n, (12, 10)) for n in (180, 256, 256)]), np.stack([np.kron(rng.integers(0, n, (3, 2)), np.ones((4, 5), int)) for n in (180, 256, 256)]), np.full((3, 12, 10), 7)]
    cells = spark.createDataFrame([(k, r, c, *map(int, image[:, r, c])) for k, image in enumerate(images) for r in range(12) for c in range(10)], "k int, r int, c int, h int, s int, v int")
    got = {r["k"]: np.array(r["feature"]) for r in raster.visual_feature(cells, "k", 12, 10).collect()}
    for k, (h, s, v) in enumerate(images):
        rgb = np.array([[colorsys.hsv_to_rgb(a / 180, b / 255, c / 255) for a, b, c in zip(*x)] for x in zip(h, s, v)])
        gray = np.floor(np.floor(rgb * 255 + 0.5 + 1e-9) @ (9798, 19235, 3735) / 32768 + 0.5).astype(int)
        f = np.bincount((h * 12 // 180 * 16 + s * 4 // 256 * 4 + v * 4 // 256).ravel(), minlength=195) / 1.0
        f /= np.sqrt((f * f).sum())
        f[192:] = gray.mean() / 255, gray.std() / 255, len(plain_canny(gray, 80, 160)) / 120
        assert (f[194] > 0) == (k < 2) and np.allclose(got[k], f / np.sqrt((f * f).sum()), atol=1e-9)


def test_polygons_and_lines(spark):
    square = [[(0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5)], [(1.6, 1.6), (3.4, 1.6), (3.4, 3.4), (1.6, 3.4)]]
    poly = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in square])], "k int, parts array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([(1, r, c, c + 0.5 - 0.25, r + 0.5 - 0.25) for r in range(6) for c in range(6)], "k int, r int, c int, x double, y double")
    inside = {(r["r"], r["c"]) for r in joins.cells_in_polygons(cells, poly, ["k"]).collect()}
    assert inside == {(r, c) for r in range(1, 5) for c in range(1, 5)} - {(2, 2), (2, 3), (3, 2), (3, 3)}
    line = spark.createDataFrame([(1, 1.0, [[{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 6.0}]])], "k int, width_m double, parts array<array<struct<x:double,y:double>>>")
    near = {(r["r"], r["c"]) for r in joins.cells_near_lines(cells, line, ["k"]).collect()}
    assert near == {(r, c) for r in range(6) for c in range(6) if r + 0.25 <= 1 or 6 - (c + 0.25) <= 1}


def test_sampling(spark):
    v = np.arange(16).reshape(4, 4)
    pts = spark.createDataFrame([(1, 0.2, 0.4), (1, 9.0, -5.0), (2, 1.0, 1.0)], "k int, px double, py double")
    got = [r["v"] for r in joins.sample_raster(pts, cells_of(spark, v), "k", 4, 4).orderBy("k", "px").collect()]
    assert got == [0, 3, 0]
    snow = cells_of(spark, v).withColumn("white", F.col("v") > 11)
    assert raster.snow_mask(snow, F.col("white"), ["k"], 4, 4).count() == 4


def test_buffered_burn_and_cleaning(spark):
    tile = spark.createDataFrame([(1, 38.0, 55.0, 38.002, 55.001)], "k int, w double, s double, e double, n double")
    pts = [{"x": 38.0002, "y": 55.0001}, {"x": 38.0018, "y": 55.0008}]
    line = spark.createDataFrame([(1, [pts], 4, 12.0)], "k int, parts array<array<struct<x:double,y:double>>>, cls int, width_m double")
    got = grid(raster.burn_buffered(tile, line, 16, ["k"]), (16, 16))
    kx, ky = 111320 * np.cos(np.radians(55.0005)), 111320
    a, b = (np.array([(p["x"] - 38) * kx, (p["y"] - 55) * ky]) for p in pts)
    want = np.zeros((16, 16))
    for r in range(16):
        for c in range(16):
            p = np.array([(c + 0.5) / 16 * 0.002 * kx, (1 - (r + 0.5) / 16) * 0.001 * ky])
            t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
            want[r, c] = np.linalg.norm(p - a - t * (b - a)) <= 12.0
    assert (got == want).all() and want.sum() > 10
    v = np.zeros((12, 12), int)
    v[2:9, 2:9], v[10, 1:11], v[0, 11], v[10, 4] = 3, 4, 3, 0
    out = grid(raster.open_close(cells_of(spark, v), [4], ["k"], 12, 12), (12, 12), "v")
    assert (out[3:8, 3:8] == 3).all() and (out[10, 1:11] == v[10, 1:11]).all() and out[0, 11] == 0
