"""Shapes of very different sizes and rings of many vertices: scan lines, bands and levelled cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgrid.operators import joins, raster

RINGS = "k int, cls int, parts array<array<struct<x:double,y:double>>>"


def ring(n, x=0.0, y=0.0, r=1.0, seed=0):
    rng = np.random.default_rng(seed)
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = r * rng.uniform(0.6, 1.0, n)
    return [(float(u), float(v)) for u, v in zip(x + far * np.cos(a), y + far * np.sin(a))]


def inside(rings, x, y):
    """Even-odd test of many points, edge by edge of the rows that they lie in."""
    out = np.zeros(len(x), bool)
    for p in rings:
        a, b = np.array(p), np.roll(np.array(p), -1, axis=0)
        for i in range(len(x)):
            on = (a[:, 1] > y[i]) != (b[:, 1] > y[i])
            s, t = a[on], b[on]
            out[i] ^= bool(np.count_nonzero(x[i] < (t[:, 0] - s[:, 0]) * (y[i] - s[:, 1]) / (t[:, 1] - s[:, 1]) + s[:, 0]) % 2)
    return out


@pytest.mark.parametrize("n", [3, 40, 100_000])
def test_scan_lines_and_bands(spark, n):
    parts = [ring(n, r=0.9), ring(max(3, n // 10), 0.1, 0.1, 0.4, seed=1), [(0.5, 0.5), (0.5, 0.5)], [(0.2, -0.9)]]
    shapes = spark.createDataFrame([(1, 7, parts), (1, 7, [[]])], RINGS)
    tiles = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0)], "k int, w double, s double, e double, n double")
    size = 48
    r, c = np.divmod(np.arange(size * size), size)
    x, y = -1 + (c + 0.5) / size * 2, 1 - (r + 0.5) / size * 2
    want = {(int(a), int(b)) for a, b, on in zip(r, c, inside(parts, x, y)) if on}
    assert want and {(q["r"], q["c"]) for q in raster.burn_polygons(tiles, shapes, size, ["k"]).collect()} == want
    cells = spark.createDataFrame([(1, int(a), int(b), float(u), float(v)) for a, b, u, v in zip(r, c, x, y)], "k int, r int, c int, x double, y double")
    found = joins.cells_in_polygons(cells, shapes, ["k"])
    assert set(found.columns) == {"k", "r", "c", "x", "y", "cls"} and {(q["r"], q["c"]) for q in found.collect()} == want
    box = {c: F.lit(v) for c, v in zip("wsen", (-1.0, -1.0, 1.0, 1.0))}
    edges = sum(map(len, parts))
    assert joins.with_bands(shapes.limit(1), box).select(F.max(F.size("_edges"))).first()[0] <= 5 * edges + 10


def test_one_large_shape_among_small_ones(spark):
    rng = np.random.default_rng(3)
    houses = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 4000, (1500, 2)))]
    shapes = [(1, i, [[(a, b), (a + 8, b), (a + 8, b + 8), (a, b + 8)]]) for i, a, b in houses] + [(1, -1, [ring(60, 2000, 2000, 1900)])]
    x, y = rng.uniform(0, 4000, (2, 4000))
    cells = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, id int, x double, y double")
    got = sorted((r["id"], r["cls"]) for r in joins.cells_in_polygons(cells, spark.createDataFrame(shapes, RINGS), ["k"]).collect())
    want = [(i, -1) for i in np.flatnonzero(inside(shapes[-1][2], x, y))]
    want += [(i, h) for h, a, b in houses for i in np.flatnonzero((x >= a) & (x < a + 8) & (y >= b) & (y < b + 8))]
    assert got == sorted((int(a), int(b)) for a, b in want)
    boxes = spark.createDataFrame([(h, a, b, a + 8, b + 8) for h, a, b in houses] + [(-1, 100.0, 100.0, 3900.0, 3900.0)], "id int, w double, s double, e double, n double")
    axes = [(F.col("x"), F.col("w"), F.col("e")), (F.col("y"), F.col("s"), F.col("n"))]
    held = joins.in_cells(cells.select("x", "y"), boxes, [], axes)
    assert held.count() < 4 * 4000 + 1500 * 40  # no square of the large one holds all cells, none is met often
    assert held.filter("id = -1 AND x BETWEEN w AND e AND y BETWEEN s AND n").count() == int(((x >= 100) & (x <= 3900) & (y >= 100) & (y <= 3900)).sum())


def test_one_long_segment_among_short_ones(spark):
    short = [(i, float(i), i + 0.8) for i in range(3000)]
    segments = spark.createDataFrame([*short, (-1, 10.0, 2900.0), (-2, 5.0, 5.0)], "segment_id int, start double, end double")
    t = np.random.default_rng(4).uniform(-5, 3005, 5000)
    log = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)] + [(5000, 2999.8), (5001, 5.0)], "id int, t double")
    pick = lambda most: sorted((r["id"], r["segment_id"]) for r in joins.assign_segments(log, segments, most=most).collect())
    assert pick(10) == pick(50_000) and len(pick(10)) > 5000
    held = joins.in_cells(log, segments, [], [(F.col("t"), F.col("start"), F.col("end"))])
    assert held.count() < 6 * 5000  # each row meets few segments that don't hold it
    assert joins.in_cells(log, segments.limit(0), [], [(F.col("t"), F.col("start"), F.col("end"))]).count() == 0


def test_points_on_edges(spark):
    """Points on eastern and southern edges are inside, on western and northern ones outside; of a hole's the other way round."""
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = spark.createDataFrame([(1, 7, [box(0.0, 10.0), box(4.0, 6.0)])], RINGS)
    at = {"w": (0.0, 5.0), "e": (10.0, 5.0), "s": (3.0, 0.0), "n": (3.0, 10.0), "hw": (4.0, 5.0), "he": (6.0, 5.0), "hs": (5.0, 4.0), "hn": (5.0, 6.0), "in": (2.0, 2.0)}
    cells = spark.createDataFrame([(1, k, *p) for k, p in at.items()], "k int, id string, x double, y double")
    assert {r["id"] for r in joins.cells_in_polygons(cells, shapes, ["k"]).collect()} == {"e", "s", "hw", "hn", "in"}
