"""More registered queries: raster cells and keyed state, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import gates
from .operators import aggregates, raster, state
from .queries import CELLS, DENSE, LOG, _cells, _log, _measured, _places, _query, _r, _table


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Rasters


@_query("""
    WITH t AS (SELECT s_suppkey AS id, 20 + s_suppkey % 40 * 0.2 AS w, 45 + s_suppkey % 30 * 0.2 AS s FROM supplier),
    g AS (SELECT *, unnest(range(16)) AS r FROM t), k AS (SELECT *, unnest(range(16)) AS c FROM g),
    p AS (SELECT *, 111320.0 * cos(radians(s + 0.05)) AS kx, 111320.0 AS ky FROM k),
    q AS (SELECT id, r, c, (c + 0.5) / 16 * 0.1 * kx AS x, (0.1 - (r + 0.5) / 16 * 0.1) * ky AS y, 0.02 * kx AS x0, 0.03 * ky AS y0, (0.08 - 0.01 * (id % 4)) * kx AS x1, 0.07 * ky AS y1 FROM p),
    d AS (SELECT *, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM q)
    SELECT id, r, c FROM d WHERE sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2)) <= 650""")
def burn_buffered(spark, d):
    k = F.col("s_suppkey")
    t = _table(spark, d, "supplier").select(k.alias("id"), (20 + k % 40 * 0.2).alias("w"), (45 + k % 30 * 0.2).alias("s"))
    t = t.withColumn("e", F.col("w") + 0.1).withColumn("n", F.col("s") + 0.1)
    at = lambda x, y: F.struct((F.col("w") + x).alias("x"), (F.col("s") + y).alias("y"))
    lines = t.select("id", F.array(F.array(at(0.02, 0.03), at(0.08 - 0.01 * (F.col("id") % 4), 0.07))).alias("parts"), F.lit(1).alias("cls"), F.lit(650.0).alias("width_m"))
    return _long(raster.burn_buffered(t, lines, 16, ["id"]).select("id", "r", "c"), "r", "c")


_OFFSETS = "a AS (SELECT -1 AS i UNION ALL SELECT 0 UNION ALL SELECT 1), o AS (SELECT a.i, b.i AS j FROM a, a b)"


@_query(f"""
    WITH s AS (SELECT raster, r, c FROM {CELLS} WHERE v <= 1), {_OFFSETS},
    dil AS (SELECT DISTINCT raster, r + i AS r, c + j AS c FROM s, o WHERE r + i BETWEEN 0 AND 15 AND c + j BETWEEN 0 AND 15),
    ero AS (SELECT raster, r - i AS r, c - j AS c, count(*) AS n FROM s, o WHERE r - i BETWEEN 0 AND 15 AND c - j BETWEEN 0 AND 15 GROUP BY ALL)
    SELECT raster, r, c FROM dil EXCEPT SELECT raster, r, c FROM ero WHERE n = (CASE WHEN r IN (0, 15) THEN 2 ELSE 3 END) * (CASE WHEN c IN (0, 15) THEN 2 ELSE 3 END)""")
def edge_band(spark, d):
    return _long(raster.edge_band(_cells(spark, d).filter("v <= 1"), ["raster"], 16, 16, 4.0, 2.0).select("raster", "r", "c"), "r", "c")


@_query(f"""SELECT raster, round(avg(CASE WHEN v = 1 THEN 1.0 ELSE 0 END), 6) AS edge_overlap, avg(CASE WHEN v = 1 THEN 1.0 ELSE 0 END) < 0.45 AS flagged FROM {CELLS} WHERE v IN (1, 2) GROUP BY 1""")
def edge_overlap(spark, d):
    c = _cells(spark, d)
    return raster.edge_overlap(c.filter("v IN (0, 1)"), c.filter("v IN (1, 2)"), ["raster"], 0.45).withColumn("edge_overlap", _r("edge_overlap"))


@_query(f"""
    WITH s AS (SELECT raster, r * 8 // 16 AS r, c * 9 // 16 AS c, avg(v) AS v FROM {CELLS} GROUP BY ALL),
    m AS (SELECT *, v > lag(v) OVER (PARTITION BY raster, r ORDER BY c) AS more FROM s)
    SELECT raster, lpad(lower(to_hex(coalesce(bit_or(CASE WHEN more THEN CAST(1 AS UBIGINT) << CAST(64 - r * 8 - c AS UBIGINT) END), CAST(0 AS UBIGINT)))), 16, '0') AS dhash FROM m GROUP BY 1""")
def dhash(spark, d):
    return raster.dhash(_cells(spark, d), ["raster"], 16, 16)


_QUADS = f"""c AS (SELECT 0 AS region, raster % 20 AS x, raster // 20 AS y, r, c, v FROM {CELLS}), t AS (SELECT DISTINCT region, x, y FROM c),
    q AS (SELECT a.region, a.x, a.y FROM t a JOIN t b ON b.x - a.x IN (0, 1) AND b.y - a.y IN (0, 1) GROUP BY ALL HAVING count(*) = 4),
    m AS (SELECT q.x AS px, q.y AS py, c.r + 16 * (c.y - q.y) AS r, c.c + 16 * (c.x - q.x) AS c, v FROM q JOIN c ON c.x - q.x IN (0, 1) AND c.y - q.y IN (0, 1))"""


def _tiled(spark, d):
    c, k = _cells(spark, d), F.col("raster")
    return c.select(F.lit(0).alias("region"), (k % 20).alias("x"), F.floor(k / 20).alias("y"), "r", "c", "v")


@_query(f"""
    WITH {_QUADS} SELECT px, py, round(count_if(v <> 0) / 1024, 6) AS non_background_ratio, array_to_string(list_sort(list_distinct(list(v))), ',') AS classes FROM m GROUP BY ALL
        HAVING count_if(v <> 0) / 1024 BETWEEN 0.01 AND 0.9""")
def make_patches(spark, d):
    c = _tiled(spark, d)
    out = raster.make_patches(c.select("region", "x", "y"), c, 16, 0.01, 0.9)
    return out.select("px", "py", _r("non_background_ratio").alias("non_background_ratio"), F.array_join(F.transform("classes_present", lambda v: v.cast("string")), ",").alias("classes"))


@_query(f"WITH {_QUADS} SELECT px, py, count(*) AS n, CAST(sum(r * 32 + c) AS BIGINT) AS places, CAST(sum((r * 32 + c) * v) AS BIGINT) AS weighted FROM m GROUP BY ALL")
def patch_cells(spark, d):
    c = _tiled(spark, d)
    at = F.col("r") * 32 + F.col("c")
    return raster.patch_cells(c.select("region", "x", "y"), c, 16).groupBy("px", "py").agg(F.count("*").alias("n"), F.sum(at).alias("places"), F.sum(at * F.col("v")).alias("weighted"))


@_query(f"""
    WITH s AS (SELECT raster, r, c FROM {CELLS} WHERE (raster * 37 + r * 11 + c * 5) % 3 > 0), {_OFFSETS},
    dil AS (SELECT DISTINCT raster, r + i AS r, c + j AS c FROM s, o WHERE r + i BETWEEN 0 AND 15 AND c + j BETWEEN 0 AND 15),
    ero AS (SELECT raster, r - i AS r, c - j AS c, count(*) AS n FROM dil, o WHERE r - i BETWEEN 0 AND 15 AND c - j BETWEEN 0 AND 15 GROUP BY ALL)
    SELECT raster, r, c FROM ero WHERE n = (CASE WHEN r IN (0, 15) THEN 2 ELSE 3 END) * (CASE WHEN c IN (0, 15) THEN 2 ELSE 3 END)""")
def snow_mask(spark, d):
    """Bright grey cells, closed."""
    k = (F.col("raster") * 37 + F.col("r") * 11 + F.col("c") * 5) % 3
    cells = _cells(spark, d).withColumns({"red": F.when(k > 0, 240).otherwise(90), "green": F.when(k > 0, 235).otherwise(80), "blue": F.lit(238)})
    return _long(raster.snow_mask(cells, gates.snow_pixel("red", "green", "blue"), ["raster"], 16, 16).select("raster", "r", "c"), "r", "c")


@_query(f"""
    WITH s AS (SELECT raster, v AS cls, r, c FROM {CELLS} WHERE v > 0), {_OFFSETS},
    e AS (SELECT DISTINCT raster, cls, r + i AS r, c + j AS c FROM s, o WHERE r + i BETWEEN 0 AND 15 AND c + j BETWEEN 0 AND 15 EXCEPT SELECT raster, cls, r, c FROM s)
    SELECT raster, cls, count(*) AS n, CAST(sum(r * 16 + c) AS BIGINT) AS places FROM e GROUP BY ALL HAVING count(*) >= 10""")
def class_edges(spark, d):
    out = raster.class_edges(_cells(spark, d), ["raster"], 16, 16, 10)
    return out.groupBy("raster", F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.sum(F.col("r") * 16 + F.col("c")).alias("places"))


_LAPLACE = f"""g AS (SELECT raster, r + i AS r, c + j AS c, v * k AS l FROM {DENSE}, (VALUES (0, 0, -4), (0, 1, 1), (1, 0, 1), (0, -1, 1), (-1, 0, 1)) AS s(i, j, k)),
    l AS (SELECT raster, r, c, abs(sum(l)) AS laplacian FROM g GROUP BY ALL HAVING count(*) = 5)"""


@_query(f"""
    WITH {_LAPLACE}, p AS (SELECT raster, quantile_cont(laplacian, 0.7) AS p FROM l GROUP BY 1)
    SELECT raster, r, c, CAST(laplacian AS BIGINT) AS laplacian FROM l JOIN p USING (raster) WHERE laplacian >= p""")
def texture_mask(spark, d):
    return _long(raster.texture_mask(_cells(spark, d, 8, 120), ["raster"], 70.0).select("raster", "r", "c", "laplacian"), "r", "c", "laplacian")


@_query(f"""
    WITH b AS (SELECT raster, r, c, v * 20 AS v FROM {DENSE}), n AS (SELECT raster, count(*) AS n, stddev_pop(v) AS sd FROM b GROUP BY 1),
    h AS (SELECT raster, -sum(k / n * log2(k / n)) AS entropy FROM (SELECT raster, v, count(*) AS k FROM b GROUP BY ALL) JOIN n USING (raster) GROUP BY 1),
    g AS (SELECT raster, r + i AS r, c + j AS c, v * -j * (2 - abs(i)) AS gx, v * -i * (2 - abs(j)) AS gy FROM b, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS e(j)),
    m AS (SELECT raster, r, c, sqrt(pow(sum(gx), 2) + pow(sum(gy), 2)) AS m FROM g GROUP BY ALL HAVING count(*) = 9),
    e AS (SELECT raster, count(*) AS e FROM m SEMI JOIN b USING (raster, r, c) WHERE m > 40 GROUP BY 1),
    f AS (SELECT raster, avg(CASE WHEN s < 8 THEN 1.0 ELSE 0 END) AS f FROM (SELECT raster, r // 4 AS i, c // 4 AS j, stddev_pop(v) AS s, count(*) AS k FROM b GROUP BY ALL) WHERE k >= 16 GROUP BY 1),
    x AS (SELECT raster, n, sd, entropy, coalesce(e, 0) / n AS ed, f FROM n LEFT JOIN h USING (raster) LEFT JOIN e USING (raster) LEFT JOIN f USING (raster)),
    y AS (SELECT raster, n, CASE WHEN n >= 64 THEN sd END AS sd, CASE WHEN n >= 64 THEN entropy END AS entropy, CASE WHEN n >= 64 THEN ed END AS ed, CASE WHEN n >= 64 THEN f END AS f FROM x),
    z AS (SELECT *, coalesce((sd < 20)::INT, 0) + coalesce((entropy < 5.5)::INT, 0) + coalesce((ed < 0.05)::INT, 0) + coalesce((f > 0.6)::INT, 0) AS votes FROM y)
    SELECT raster, n, round(sd, 6) AS std, round(entropy, 6) AS entropy, round(ed, 6) AS edge_density, round(f, 6) AS low_var_patch_frac, votes, votes >= 3 AS raw_obstructed FROM z""")
def texture_votes(spark, d):
    cells = _cells(spark, d, 8, 120).withColumn("v", F.col("v") * 20).withColumn("valid", F.lit(True))
    out = raster.texture_votes(raster.texture_metrics(cells, ["raster"], 8, 8, 2))
    return out.select("raster", "n", *[_r(c).alias(c) for c in ("std", "entropy", "edge_density", "low_var_patch_frac")], "votes", "raw_obstructed")


_MATCH = f"""
    t AS (SELECT raster AS id, v AS cls, r, c, 1.0 + v % 2 AS w FROM {CELLS} WHERE raster % 2 = 0 AND v > 0 AND r < 8 AND c < 8), s AS (SELECT raster - 1 AS id, v AS cls, r, c FROM {CELLS} WHERE raster % 2 = 1 AND v > 0),
    k AS (SELECT id, cls, count(*) AS st, max(w) AS w FROM t GROUP BY ALL HAVING count(*) >= 2),
    m AS (SELECT t.id, t.cls, s.r - t.r AS dr, s.c - t.c AS dc, count(*) AS sts FROM t JOIN s ON t.id = s.id AND t.cls = s.cls JOIN k ON k.id = t.id AND k.cls = t.cls
        WHERE s.r - t.r BETWEEN 0 AND 8 AND s.c - t.c BETWEEN 0 AND 8 GROUP BY ALL),
    x AS (SELECT m.*, k.st, k.w, (SELECT count(*) FROM s WHERE s.id = m.id AND s.cls = m.cls AND s.r BETWEEN dr AND dr + 7 AND s.c BETWEEN dc AND dc + 7) AS ss FROM m JOIN k USING (id, cls)),
    n AS (SELECT *, sqrt((64 * st - st * st) * (64 * ss - ss * ss)) AS under FROM x),
    v AS (SELECT id, dr, dc, round(sum(w * CASE WHEN under > 0 THEN (64 * sts - st * ss) / under ELSE 0 END) / (SELECT sum(w) FROM k WHERE k.id = n.id), 9) AS votes FROM n GROUP BY id, dr, dc),
    p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, dr, dc) = 1),
    q AS (SELECT v.id, max(v.votes) AS second FROM v JOIN p ON v.id = p.id AND greatest(abs(v.dr - p.dr), abs(v.dc - p.dc)) > 2 GROUP BY 1),
    f AS (SELECT p.id, dr, dc, votes AS peak, votes - coalesce(second, 0) AS margin FROM p LEFT JOIN q USING (id))"""


def _match_cells(spark, d):
    c = _cells(spark, d).filter("v > 0").withColumn("cls", F.col("v"))
    t = c.filter("raster % 2 = 0 AND r < 8 AND c < 8").select(F.col("raster").alias("id"), "cls", "r", "c", (1.0 + F.col("cls") % 2).alias("w"))
    return t, c.filter("raster % 2 = 1").select((F.col("raster") - 1).alias("id"), "cls", "r", "c", F.lit(1.0).alias("w"))


@_query(f"WITH {_MATCH} SELECT id, CAST(dr AS BIGINT) AS dr, CAST(dc AS BIGINT) AS dc, round(peak, 6) AS peak, round(margin, 6) AS margin FROM f")
def mask_match(spark, d):
    t, s = _match_cells(spark, d)
    return _long(raster.mask_match(t, s, 8, 16, 16, 2, "id", 2), "dr", "dc").select("id", "dr", "dc", _r("peak").alias("peak"), _r("margin").alias("margin"))


@_query(f"""
    WITH {_MATCH}, i AS (SELECT DISTINCT raster - raster % 2 AS id FROM {CELLS}), nt AS (SELECT id, count(*) AS nt FROM t GROUP BY 1), ns AS (SELECT id, count(*) AS ns FROM s GROUP BY 1),
    z AS (SELECT i.id, coalesce(nt, 0) AS nt, coalesce(ns, 0) AS ns, CASE WHEN nt >= 3 AND ns >= 7 THEN dr END AS dr, CASE WHEN nt >= 3 AND ns >= 7 THEN dc END AS dc, f.peak, f.margin FROM i LEFT JOIN nt USING (id) LEFT JOIN ns USING (id) LEFT JOIN f USING (id))
    SELECT id, round(51 - (dr + 4) / 16.0, 6) AS lat, round(20 + (dc + 4) / 16.0, 6) AS lon, CASE WHEN nt < 3 THEN 'too_few_template_cells' WHEN ns < 7 THEN 'too_few_scene_features' WHEN peak IS NULL THEN 'no_valid_channels' WHEN (peak < 0.1 OR margin < 0.02) AND peak <= 0.1 THEN 'peak_too_weak'
        WHEN peak < 0.1 OR margin < 0.02 THEN 'low_margin' END AS reject_reason FROM z""")
def match_report(spark, d):
    t, s = _match_cells(spark, d)
    pairs = _cells(spark, d).select((F.col("raster") - F.col("raster") % 2).alias("id")).distinct()
    pairs = pairs.withColumns({"w": F.lit(20.0), "s": F.lit(50.0), "e": F.lit(21.0), "n": F.lit(51.0)})
    return raster.match_report(pairs, t, s, 8, 16, 16, 2, "id", 2, 3, 7).select("id", _r("lat").alias("lat"), _r("lon").alias("lon"), "reject_reason")


@_query(f"""
    WITH m AS (SELECT raster, r, c FROM {CELLS} WHERE v IN (1, 2)), i AS (SELECT raster, r, c FROM {CELLS} WHERE v IN (1, 3)),
    t AS (SELECT raster, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 6) AS fg_share, round(avg(CASE WHEN v IN (1, 2) AND raster % 10 > 0 THEN 1.0 ELSE 0 END), 6) AS edge_share FROM {CELLS} GROUP BY 1),
    k AS (SELECT raster FROM t WHERE edge_share >= 0.005 AND fg_share >= 0.02),
    o AS (SELECT m.raster, i.r - m.r AS dy, i.c - m.c AS dx, count(*) AS votes FROM m JOIN i ON m.raster = i.raster AND abs(i.r - m.r) <= 4 AND abs(i.c - m.c) <= 4 SEMI JOIN k ON k.raster = m.raster GROUP BY ALL),
    p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY raster ORDER BY votes DESC, abs(dy), abs(dx), dy DESC, dx DESC) = 1)
    SELECT t.raster, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, round(sqrt(dx * dx + dy * dy), 6) AS shift_mag, round(coalesce(votes / (SELECT count(*) FROM m WHERE m.raster = t.raster), 0), 6) AS response, CASE WHEN dx IS NULL THEN 'no_signal' ELSE 'ok' END AS status
    FROM t LEFT JOIN p USING (raster)""")
def tile_shift(spark, d):
    c = _cells(spark, d)
    share = lambda on: F.round(F.avg(F.when(on, 1.0).otherwise(0.0)), 6)
    tiles = c.groupBy("raster").agg(share(F.col("v") > 0).alias("fg_share"), share(F.col("v").isin(1, 2) & (F.col("raster") % 10 > 0)).alias("edge_share"))
    out = raster.tile_shift(c.filter("v IN (1, 3)"), c.filter("v IN (1, 2)"), 4, 1, "raster", tiles)
    return _long(out.select("raster", "dx", "dy", _r("shift_mag").alias("shift_mag"), _r("response").alias("response"), "status"), "dx", "dy")


_SIDE = "CASE a.way WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END"


@_query(f"""
    WITH RECURSIVE x AS (SELECT raster, r, c, (raster * 7 + r * 31 + c * 3) % 180 AS h, (r * 16 + c) % 256 AS s, (raster * 5 + r * c) % 256 AS v FROM {CELLS}),
    w AS (SELECT *, h // 30 AS k, (2 * v * (255 - s) + 255) // 510 AS p, (2 * v * (7650 - s * (h % 30)) + 7650) // 15300 AS q, (2 * v * (7650 - s * (30 - h % 30)) + 7650) // 15300 AS t FROM x),
    g AS (SELECT raster, r, c, (9798 * [v, q, p, p, t, v][k + 1] + 19235 * [t, v, v, q, p, p][k + 1] + 3735 * [p, p, t, v, v, q][k + 1] + 16384) // 32768 AS g FROM w),
    o AS (SELECT a.i, b.i AS j, b.i * (2 - abs(a.i)) AS dx, a.i * (2 - abs(b.i)) AS dy FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(i)),
    d AS (SELECT a.raster, a.r, a.c, CAST(sum(dx * b.g) AS BIGINT) AS x, CAST(sum(dy * b.g) AS BIGINT) AS y FROM g a CROSS JOIN o JOIN g b ON b.raster = a.raster AND b.r = greatest(0, least(15, a.r + i)) AND b.c = greatest(0, least(15, a.c + j)) GROUP BY ALL),
    m AS (SELECT *, abs(x) + abs(y) AS m, CASE WHEN abs(y) * 32768 < abs(x) * 13573 THEN 0 WHEN abs(y) * 32768 > abs(x) * 79109 THEN 1 WHEN (x < 0) = (y < 0) THEN 2 ELSE 3 END AS way FROM d),
    l AS (SELECT a.raster, a.r, a.c, a.m > 160 AS strong FROM m a LEFT JOIN m b ON b.raster = a.raster AND b.r = a.r - (a.way > 0)::INT AND b.c = a.c - {_SIDE} LEFT JOIN m n ON n.raster = a.raster AND n.r = a.r + (a.way > 0)::INT AND n.c = a.c + {_SIDE}
        WHERE a.m > 80 AND a.m > coalesce(b.m, 0) AND (a.m > coalesce(n.m, 0) OR (a.way < 2 AND a.m = n.m))),
    e AS (SELECT raster, r, c FROM l WHERE strong UNION SELECT l.raster, l.r, l.c FROM e JOIN l ON l.raster = e.raster AND abs(l.r - e.r) <= 1 AND abs(l.c - e.c) <= 1),
    b AS (SELECT raster, CAST(h * 12 // 180 * 16 + s * 4 // 256 * 4 + v * 4 // 256 AS BIGINT) AS i, count(*) AS n FROM x GROUP BY ALL),
    f AS (SELECT raster, i, n / sqrt(sum(n * n) OVER (PARTITION BY raster)) AS f FROM b UNION ALL SELECT raster, 192, avg(g) / 255 FROM g GROUP BY 1 UNION ALL SELECT raster, 193, stddev_pop(g) / 255 FROM g GROUP BY 1
        UNION ALL SELECT g.raster, 194, count(e.r) / count(*) FROM g LEFT JOIN e USING (raster, r, c) GROUP BY 1)
    SELECT raster, i, round(f / sqrt(sum(f * f) OVER (PARTITION BY raster)), 6) AS f FROM f""")
def visual_feature(spark, d):
    k, r, c = F.col("raster"), F.col("r"), F.col("c")
    cells = _cells(spark, d).select("raster", "r", "c", ((k * 7 + r * 31 + c * 3) % 180).alias("h"), ((r * 16 + c) % 256).alias("s"), ((k * 5 + r * c) % 256).alias("v"))
    out = raster.visual_feature(cells, "raster", 16, 16).select("raster", F.posexplode("feature").alias("i", "f")).filter("f > 0 OR i >= 192")
    return _long(out.withColumn("f", _r("f")), "i")


# Motion and keyed state


@_query(f"""
    WITH p AS (SELECT track, event_id, (event_id % 21 - 10) / 20.0::DOUBLE AS xn, value / 200 AS yn FROM {LOG}),
    g AS (SELECT track, 100 * (yn * s + c) / (yn * c - s) AS x, 100 * xn / (yn * c - s) AS y FROM p, (SELECT cos(radians(-70.0)) AS c, sin(radians(-70.0)) AS s) WHERE yn * c - s > 1e-6),
    n AS (SELECT track, count(*) AS num_tracked, (SELECT count(*) FROM g WHERE g.track = p.track) AS num_grounded FROM p GROUP BY track)
    SELECT track, num_tracked, num_grounded, CASE WHEN num_grounded >= 8 THEN -20.0::DOUBLE END AS vx, CASE WHEN num_grounded >= 8 THEN 10.0::DOUBLE END AS vy, CASE WHEN num_grounded >= 8 THEN 0.0::DOUBLE END AS yaw_rate,
        num_grounded >= 8 AS valid, CASE WHEN num_grounded < 8 THEN 'too_few_grounded' END AS reject_reason FROM n""")
def ground_motion(spark, d):
    """Points on the ground that all move by the same two metres forward and one to the left, seen by the camera before and after."""
    import math

    from .functions import geo

    c, s = math.cos(math.radians(-70)), math.sin(math.radians(-70))
    log = _log(spark, d).select("track", "event_id", ((F.col("event_id") % 21 - 10) / 20.0).alias("xn0"), (F.col("value") / 200).alias("yn0"))
    at = geo.raycast_ground("xn0", "yn0", -70.0, 100.0)
    log = log.withColumn("g", at).withColumn("x", (F.col("g.x") + 2) / 100).withColumn("y", (F.col("g.y") - 1) / 100)
    # the ray (ahead, right) = (x, y) per metre of height, back in the camera's frame
    yn = (c + s * F.col("x")) / (c * F.col("x") - s)
    log = log.withColumn("yn1", yn).withColumn("xn1", F.col("y") * (F.col("yn1") * c - s))
    log = log.withColumns({"pitch_deg": F.lit(-70.0), "agl": F.lit(100.0), "dt": F.lit(0.1)})
    out = aggregates.ground_motion(log, ["track"], 0.01, 8, "event_id")
    return out.select("track", "num_tracked", "num_grounded", *[_r(x, 4).alias(x) for x in ("vx", "vy", "yaw_rate")], "valid", "reject_reason")


@_query(f"""
    WITH RECURSIVE l AS (SELECT event_id, track, value AS x, event_id % 90 AS y, 1 + event_id % 3 * 0.3 AS s, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS n FROM {LOG}),
    f AS (SELECT track, event_id, n, x, y, s, NULL::VARCHAR AS reason FROM l WHERE n = 1 UNION ALL
        SELECT track, event_id, n, CASE WHEN why IS NULL THEN lx ELSE x END, CASE WHEN why IS NULL THEN ly ELSE y END, CASE WHEN why IS NULL THEN ls ELSE s END, why FROM
        (SELECT f.track, l.event_id, l.n, f.x, f.y, f.s, l.x AS lx, l.y AS ly, l.s AS ls, CASE WHEN greatest(l.s / f.s, f.s / l.s) > 1.5 THEN 'scale_change' WHEN sqrt(pow(l.x - f.x, 2) + pow(l.y - f.y, 2)) > 60 THEN 'jump' END AS why
            FROM f JOIN l ON l.track = f.track AND l.n = f.n + 1))
    SELECT event_id, reason FROM f""")
def gate_vs_last(spark, d):
    k = F.col("event_id")
    log = _log(spark, d).select("event_id", "track", "t", F.col("value").alias("x"), (k % 90).cast("double").alias("y"), (1 + k % 3 * 0.3).alias("scale"))
    return state.gate_vs_last(log, ["track"], ["t", "event_id"], 1.5, 60.0).select("event_id", F.col("gate_reason").alias("reason"))


@_query()
def fuse_channels(spark, d):
    """Motion and two channels of fixes of each track: counts of rows, accepted fixes and reject codes."""
    log = _log(spark, d).withColumn("frame", F.col("event_id"))
    motion = log.select("track", "frame", "t", (50 + F.col("value") / 50).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("yaw_rate"))
    x = (F.col("t") - 170406) * 50
    fix = lambda name, dx: log.filter("accepted").select("track", "frame", F.lit(name).alias("channel"), (x + dx).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("sigma"))
    fixes = fix("appearance", 0.0).unionByName(fix("structural", F.col("value") * 2))
    out = state.fuse_channels(fixes, motion, ["track"])
    return out.groupBy("track").agg(F.count("*").alias("n"), F.count_if("fix_ok").alias("accepted"), F.count_if(F.col("reject_code") == "consistency_reject").alias("disagreed"), F.count_if(F.col("reject_code") == "ekf_gate").alias("gated"))


def _fixes_sql(rows: str) -> str:
    """The track filter over rows (id, track, t, ord, fx, fy, fs) without motion, in SQL: then east and north are a place and
    a rate each, with the same variances (a, b, c), and no other state touches them. Adds x, y, var, fix_ok, fix_d2."""
    r = f"r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, ord) AS n FROM {rows})"
    dt, s = "(r.t - s.t)", "(g.a + g.fs * g.fs)"
    return f"""{r},
    s AS (SELECT id, track, n, t, coalesce(fx, 0.0) AS x, 0.0::DOUBLE AS vx, coalesce(fy, 0.0) AS y, 0.0::DOUBLE AS vy,
        CASE WHEN fx IS NULL THEN 25e6 ELSE fs * fs END AS a, 0.0::DOUBLE AS b, 2500.0::DOUBLE AS c,
        CASE WHEN fx IS NOT NULL THEN true END AS fix_ok, CASE WHEN fx IS NOT NULL THEN 0.0::DOUBLE END AS fix_d2 FROM r WHERE n = 1
    UNION ALL SELECT id, track, n, t, CASE WHEN ok THEN x + a / sv * ox ELSE x END, CASE WHEN ok THEN vx + b / sv * ox ELSE vx END,
        CASE WHEN ok THEN y + a / sv * oy ELSE y END, CASE WHEN ok THEN vy + b / sv * oy ELSE vy END,
        CASE WHEN ok THEN a - a / sv * a ELSE a END, CASE WHEN ok THEN b - a / sv * b ELSE b END, CASE WHEN ok THEN c - b / sv * b ELSE c END, ok, d2
    FROM (SELECT *, d2 <= 25 AS ok FROM (SELECT *, (ox * ox + oy * oy) / sv AS d2 FROM (SELECT *, g.fx - g.x AS ox, g.fy - g.y AS oy, {s} AS sv FROM (
        SELECT r.id, r.track, r.n, r.t, r.fx, r.fy, r.fs, s.x + {dt} * s.vx AS x, s.vx, s.y + {dt} * s.vy AS y, s.vy,
            s.a + 2 * {dt} * s.b + {dt} * {dt} * s.c + pow(1.5 * {dt} * {dt}, 2) / 3 AS a, s.b + {dt} * s.c AS b, s.c + pow(1.5 * {dt}, 2) AS c
        FROM s JOIN r ON r.track = s.track AND r.n = s.n + 1) g))))"""


_FIX = "CASE WHEN accepted THEN (t - 170406) * 50 + value END AS fx, CASE WHEN accepted THEN 0.0::DOUBLE END AS fy, CASE WHEN accepted THEN 30.0::DOUBLE END AS fs"


@_query(f"""WITH RECURSIVE {_fixes_sql(f"(SELECT event_id AS id, track, t, event_id AS ord, {_FIX} FROM {LOG})")}
    SELECT id AS event_id, track, round(x, 3) + 0.0 AS x_e, round(sqrt(2 * a), 3) AS sigma_pos, fix_ok, round(fix_d2, 4) + 0.0 AS fix_d2 FROM s""")
def filter_fixes(spark, d):
    """The track filter where only fixes are known: all rows, with the accepted fixes and their distances."""
    rows = _measured(spark, d).withColumns({c: F.lit(None).cast("double") for c in ("vx", "vy", "yaw_rate")})
    out = state.filter_tracks(rows, ["track"], ("event_id",))
    return out.select("event_id", "track", _r("x_e", 3).alias("x_e"), _r("sigma_pos", 3).alias("sigma_pos"), "fix_ok", _r("fix_d2", 4).alias("fix_d2"))


@_query(f"""WITH RECURSIVE l AS (SELECT *, (t - 170406) * 50 AS place, accepted AND 2 * abs(value) > 3 * sqrt(800.0) AS apart FROM {LOG}),
    f AS (SELECT event_id * 3 AS id, track, t, event_id * 3 AS ord, NULL::DOUBLE AS fx, NULL::DOUBLE AS fy, NULL::DOUBLE AS fs, NULL AS code FROM l
        UNION ALL SELECT event_id * 3 + 1, track, t, event_id * 3 + 1, CASE WHEN NOT apart THEN place END, CASE WHEN NOT apart THEN 0.0 END, CASE WHEN NOT apart THEN 20.0 END, CASE WHEN apart THEN 'consistency_reject' END FROM l WHERE accepted
        UNION ALL SELECT event_id * 3 + 2, track, t, event_id * 3 + 2, CASE WHEN NOT apart THEN place + 2 * value END, CASE WHEN NOT apart THEN 0.0 END, CASE WHEN NOT apart THEN 20.0 END, CASE WHEN apart THEN 'consistency_reject' END FROM l WHERE accepted),
    {_fixes_sql("(SELECT id, track, t, ord, fx, fy, fs FROM f)")}
    SELECT id // 3 AS event_id, s.track, id % 3 AS ord, round(x, 3) + 0.0 AS x_e, fix_ok, coalesce(code, CASE WHEN NOT fix_ok THEN 'ekf_gate' END) AS reject_code,
        CASE WHEN NOT fix_ok THEN round(fix_d2, 4) END AS reject_value FROM s JOIN f USING (id)""")
def fuse_fixes(spark, d):
    """Two channels of fixes of a frame, the agreement gate and the filter, without motion: all rows with their reject codes."""
    none = F.lit(None).cast("double")
    log = _log(spark, d).withColumn("frame", F.col("event_id"))
    motion = log.select("track", "frame", "t", none.alias("vx"), none.alias("vy"), none.alias("yaw_rate"))
    x = (F.col("t") - 170406) * 50
    fix = lambda name, dx: log.filter("accepted").select("track", "frame", F.lit(name).alias("channel"), (x + dx).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("sigma"))
    out = state.fuse_channels(fix("appearance", 0.0).unionByName(fix("structural", F.col("value") * 2)), motion, ["track"])
    return out.select(F.col("frame").alias("event_id"), "track", F.col("ord").cast("long").alias("ord"), _r("x_e", 3).alias("x_e"), "fix_ok", "reject_code", _r("reject_value", 4).alias("reject_value"))


@_query(f"""SELECT raster, r, c, max(v) AS v FROM (SELECT raster, r, c, (v = 1)::INT AS v FROM {CELLS}
    UNION ALL SELECT l_orderkey // 24, l_suppkey % 16, l_partkey % 16, max((l_quantity > 30)::INT) FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def raster_or(spark, d):
    """Two masks of a raster that cover different cells: set where one of them is."""
    mask = lambda on: F.when(on, 1).otherwise(0)
    li = _table(spark, d, "lineitem")
    key = F.floor(F.col("l_orderkey") / 24).alias("raster"), (F.col("l_suppkey") % 16).cast("int").alias("r"), (F.col("l_partkey") % 16).cast("int").alias("c")
    other = li.groupBy(*key).agg(F.max(mask(F.col("l_quantity") > 30)).alias("v"))
    out = raster.raster_or(_cells(spark, d).withColumn("v", mask(F.col("v") == 1)), other, ["raster"])
    return out.select("raster", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v")
