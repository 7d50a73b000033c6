"""More registered queries: scalars, small joins, aggregates, windows and selections, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import gates, geo, udtf
from .operators import aggregates, features, joins, retrieval, selection, windows
from .queries import BOXES, CELLS, LOG, SEGMENTS, _boxes, _cells, _log, _points, _points_sql, _query, _r, _segments, _table

# Scalars


@_query(f"""
    SELECT id, printf('%.6e', 4.0 / pow(111320.0, 2)) AS lat_var, round(1e12 * 0.5 / (pow(111320.0, 2) * cos(radians(lat))), 6) AS cross_term,
        round(1e12 * 9.0 / pow(111320.0 * cos(radians(lat)), 2), 6) AS lon_var FROM {_points_sql()}""")
def cov_to_deg(spark, d):
    cov = F.array(*map(F.lit, (9.0, 0.5, 0.5, 4.0)))
    p = _points(spark, d).withColumn("c", geo.cov_to_deg(cov, "lat"))
    return p.select("id", F.format_string("%.6e", F.col("c")[0]).alias("lat_var"), _r(F.col("c")[1] * 1e12).alias("cross_term"), _r(F.col("c")[3] * 1e12).alias("lon_var"))


_ECEF = """(SELECT id, lat, lon, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - e2) * sin(radians(lat)) AS z FROM
    (SELECT *, 6378137.0 / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) AS n FROM (SELECT *, (2 - 1 / 298.257223563) / 298.257223563 AS e2 FROM {points})))"""


def _ecef(spark, d):
    f = geo.WGS84_F
    lat, lon = F.radians("lat"), F.radians("lon")
    p = _points(spark, d).withColumn("nn", geo.WGS84_A / F.sqrt(1 - f * (2 - f) * F.pow(F.sin(lat), 2)))
    return p.select("id", "lat", "lon", (F.col("nn") * F.cos(lat) * F.cos(lon)).alias("x"), (F.col("nn") * F.cos(lat) * F.sin(lon)).alias("y"), (F.col("nn") * (1 - f * (2 - f)) * F.sin(lat)).alias("z"))


@_query(f"SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, 0.0::DOUBLE AS h FROM {_ECEF.format(points=_points_sql())}")
def ecef_to_wgs84(spark, d):
    p = _ecef(spark, d).withColumn("g", geo.ecef_to_wgs84("x", "y", "z"))
    return p.select("id", _r("g.lat", 7).alias("lat"), _r("g.lon", 7).alias("lon"), _r("g.h", 3).alias("h"))


@_query(f"""SELECT id, CASE WHEN id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE round(sqrt(pow(x - 3500000, 2) + pow(y - 1500000, 2) + pow(z - 5000000, 2)), 3) END AS d
    FROM {_ECEF.format(points=_points_sql())}""")
def dist_ecef_m(spark, d):
    p = _ecef(spark, d).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("x")))
    m = geo.dist_ecef_m(["x", "y", "z"], [3_500_000.0, 1_500_000.0, 5_000_000.0])
    return p.select("id", F.when(m == float("inf"), m).otherwise(F.round(m, 3)).alias("d"))


@_query(f"""
    WITH p AS (SELECT id, 49 - py / 400 * 4 AS lat, 20 + px / 800 * 8 AS lon FROM (SELECT c_custkey AS id, (c_custkey * 13 % 800)::DOUBLE AS px, (c_custkey * 7 % 400)::DOUBLE AS py FROM customer))
    SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(c_custkey * 13 % 800 AS DOUBLE) AS px, CAST(c_custkey * 7 % 400 AS DOUBLE) AS py FROM p JOIN customer ON id = c_custkey""")
def pixel_to_geo(spark, d):
    k = F.col("c_custkey")
    p = _table(spark, d, "customer").withColumn("g", geo.pixel_to_geo((k * 13 % 800).cast("double"), (k * 7 % 400).cast("double"), 20.0, 45.0, 28.0, 49.0, 800.0, 400.0))
    p = p.withColumn("q", geo.geo_to_pixel("g.lat", "g.lon", 20.0, 45.0, 28.0, 49.0, 800.0, 400.0))
    return p.select(k.alias("id"), _r("g.lat").alias("lat"), _r("g.lon").alias("lon"), _r("q.px").alias("px"), _r("q.py").alias("py"))


@_query(f"""
    SELECT id, round(lon - dx, 7) AS w, round(lat - dy, 7) AS s, round(lon + dx, 7) AS e, round(lat + dy, 7) AS n,
        greatest(0, least(100, CAST(id % 300 - 100 AS INTEGER))) AS x0 FROM (SELECT *, 250.0 / 111320 AS dy, 250.0 / (111320 * cos(radians(lat))) AS dx FROM {_points_sql()})""")
def bbox_around(spark, d):
    p = _points(spark, d).withColumn("b", geo.bbox_around("lat", "lon", 500.0))
    x0 = geo.clip_window(F.col("id") % 300 - 100, 0, 50, 50, 100, 100)["x0"]
    return p.select("id", *[_r(f"b.{c}", 7).alias(c) for c in "wsen"], x0.alias("x0"))


@_query("""
    SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN floor(epoch_us(ts) / 1e3) / 1e3 WHEN 2 THEN event_id ELSE 5 END, 3) AS t FROM events""")
def norm_epoch_s(spark, d):
    e = _table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    k = F.col("event_id") % 4
    stamp = F.when(k == 0, (F.col("us") / 1e6).cast("string")).when(k == 1, F.floor(F.col("us") / 1e3).cast("string")).when(k == 2, "no number")
    back = F.when(k == 2, F.col("event_id")).otherwise(5)
    return e.select("event_id", _r(geo.norm_epoch_s(stamp, back), 3).alias("t"))


@_query(f"""
    SELECT id, round(lat - a * cos(id) / 111320, 7) AS lat, round(lon - a * sin(id) / (111320 * cos(radians(lat))), 7) AS lon FROM
        (SELECT *, CASE WHEN id % 91 >= 89.9 THEN 0 ELSE 120.0 / tan(radians(id % 91 + 0.0)) END AS a FROM {_points_sql()} WHERE id % 91 > 0)""")
def view_to_platform(spark, d):
    p = _points(spark, d).filter("id % 91 > 0")
    g = geo.view_to_platform("lat", "lon", F.col("id").cast("double"), 120.0, -(F.col("id") % 91).cast("double"))
    return p.select("id", _r(g["lat"], 7).alias("lat"), _r(g["lon"], 7).alias("lon"))


@_query("""
    WITH p AS (SELECT c_custkey AS id, (c_custkey % 41 - 20) / 20.0::DOUBLE AS xn, (c_custkey % 31 - 15) / 15.0::DOUBLE AS yn, cos(radians(-60.0)) AS c, sin(radians(-60.0)) AS s FROM customer),
    q AS (SELECT *, yn * c - s AS down, yn * s + c AS ahead FROM p)
    SELECT id, CASE WHEN down > 1e-6 THEN round(ahead * 100 / down, 4) END AS x, CASE WHEN down > 1e-6 THEN round(xn * 100 / down, 4) END AS y FROM q""")
def raycast_ground(spark, d):
    k = F.col("c_custkey")
    g = geo.raycast_ground((k % 41 - 20) / 20.0, (k % 31 - 15) / 15.0, -60.0, 100.0)
    return _table(spark, d, "customer").select(k.alias("id"), _r(g["x"], 4).alias("x"), _r(g["y"], 4).alias("y"))


@_query("""
    WITH p AS (SELECT c_custkey AS id, 100.0 + c_custkey % 200 AS agl, CASE WHEN c_custkey % 5 = 0 THEN 90.0 ELSE 30.0 + c_custkey % 50 END AS pitch FROM customer),
    q AS (SELECT *, 256 * agl / 300 AS f, CASE WHEN pitch < 89.9 THEN agl / tan(radians(pitch)) ELSE 0 END AS ahead, cos(radians(90 - pitch)) AS c, sin(radians(90 - pitch)) AS s FROM p),
    r AS (SELECT *, 0.1 * c + 0.9 * s AS down, 128 - f * ahead / agl AS py FROM q),
    t AS (SELECT *, (0.1 * -s + 0.9 * c) AS w FROM r)
    SELECT id, round((f * 0.2 + 128 * w) / w, 4) AS x, round((f * down + py * w) / w, 4) AS y FROM t""")
def h_nadir(spark, d):
    """The picture point whose ray is (0.2, 0.1, 0.9) in the camera, in the view straight down."""
    k = F.col("c_custkey")
    p = _table(spark, d, "customer").select(k.alias("id"), (100.0 + k % 200).alias("agl"), F.when(k % 5 == 0, -90.0).otherwise(-(30.0 + k % 50)).alias("pitch"))
    h = geo.h_nadir("pitch", "agl", 300.0, 256.0, 256.0, 400.0, 400.0, 320.0, 240.0)
    at = geo.h_apply("h", 320 + 400 * 0.2 / 0.9, 240 + 400 * 0.1 / 0.9)
    return p.withColumn("h", h).select("id", _r(at["x"], 4).alias("x"), _r(at["y"], 4).alias("y"))


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round(0.99993 * (0.5 * least(1.0, l_discount * 12.7123457) + 0.3 * greatest(0.0, 1 - l_tax * 401 / 20) + 0.2 * least(1.0, l_quantity / 80.0))
        * CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0.95 END * CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 1 END, 6) AS confidence FROM lineitem""")
def track_confidence(spark, d):
    c = gates.track_confidence("l_quantity", F.col("l_discount") * 12.7123457, F.col("l_tax") * 401, F.col("l_linestatus") == "O", F.col("l_returnflag") == "R")
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _r(0.99993 * c).alias("confidence"))


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN round(l_discount * 6, 9) < CASE WHEN key THEN 0.22 ELSE 0.30 END THEN 'low_inlier_ratio'
        WHEN l_quantity > CASE WHEN key THEN 18 ELSE 10 END THEN 'high_reprojection' WHEN abs(l_tax * 40 - 0.5) > 2 THEN 'out_of_map' END AS reason
    FROM (SELECT *, l_linestatus = 'O' AS key FROM lineitem)""")
def gate_fix_rigid(spark, d):
    why = gates.gate_fix_rigid(F.round(F.col("l_discount") * 6, 9), "l_quantity", F.col("l_linestatus") == "O", F.col("l_tax") * 40, F.lit(0.5))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", why.alias("reason"))


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_discount > 0.05 AND l_tax / 10 > 0.005 AS edges, round(greatest(15.0, least(200.0, 100 * (1 - l_tax / 10))), 6) AS edges_m,
        l_discount >= 0.10 AND l_tax / 10 >= 0.02 AS masks, round(200 - 185 * least(1.0, l_tax / 2), 6) AS masks_m FROM lineitem""")
def gate_peak(spark, d):
    a, b = (gates.gate_peak("l_discount", F.col("l_tax") / 10, mode) for mode in ("edges", "masks"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a["accepted"].alias("edges"), _r(a["sigma_m"]).alias("edges_m"), b["accepted"].alias("masks"), _r(b["sigma_m"]).alias("masks_m"))


_LAYERS = "CASE p_partkey % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'transportation' WHEN 2 THEN 'land_cover' WHEN 3 THEN 'land_use' ELSE 'place' END"
_KINDS = "['forest', 'wood', 'farmland', 'residential', 'crop', 'meadow', 'retail', 'other'][p_partkey // 5 % 8 + 1]"


def _layers(spark, d):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("forest", "wood", "farmland", "residential", "crop", "meadow", "retail", "other")))
    layer = F.array(*map(F.lit, ("water", "transportation", "land_cover", "land_use", "place")))[(k % 5).cast("int")]
    return _table(spark, d, "part").withColumn("layer", layer).withColumn("attrs", F.create_map(F.lit("class"), kinds[(F.floor(k / 5) % 8).cast("int")]))


@_query(f"""
    SELECT p_partkey, CASE WHEN layer = 'water' THEN 105 WHEN layer = 'transportation' THEN 102 WHEN layer = 'land_cover' AND kind IN ('forest', 'wood') THEN 200
        WHEN layer = 'land_use' AND kind IN ('farmland', 'crop', 'meadow') THEN 300 WHEN layer = 'land_use' AND kind IN ('residential', 'retail') THEN 101 END AS code
    FROM (SELECT p_partkey, {_LAYERS} AS layer, {_KINDS} AS kind FROM part)""")
def classify_features_v7(spark, d):
    return _layers(spark, d).select("p_partkey", features.classify_features_v7(F.col("layer"), F.col("attrs"), 5, 2, 1).alias("code"))


@_query("""
    WITH p AS (SELECT p_partkey, p_partkey % 6 AS k FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 7.0 WHEN 1 THEN 3.0 WHEN 3 THEN 25.0 ELSE 2.5 END::DOUBLE AS width_m FROM p WHERE k <> 2""")
def road_widths(spark, d):
    names = F.array(*map(F.lit, ("Motorway", "residential", "footway", "runway", "lane")))
    p = _table(spark, d, "part").withColumn("class", F.get(names, (F.col("p_partkey") % 6).cast("int")))
    return features.road_widths(p).select("p_partkey", "width_m")


@_query(f"""
    SELECT p_partkey FROM (SELECT p_partkey, {_LAYERS} AS layer, p_partkey // 3 % 5 AS k FROM part) WHERE k IN (0, 1) OR k IN (2, 3) AND layer = 'transportation'""")
def valid_kinds(spark, d):
    kinds = F.array(*map(F.lit, ("Polygon", "MultiPolygon", "LineString", "MultiLineString", "Point")))
    p = _layers(spark, d).withColumn("kind", kinds[(F.floor(F.col("p_partkey") / 3) % 5).cast("int")])
    return features.valid_kinds(p).select("p_partkey")


@_query("""
    SELECT l_orderkey, l_linenumber, l_partkey, s.accepted AS accepted, s.reason AS reason FROM (SELECT *, CASE WHEN l_quantity >= 10 THEN {'accepted': l_discount <= 0.05 AND l_tax <= 0.06,
        'reason': CASE WHEN l_discount > 0.05 THEN 'centre_too_far_right' WHEN l_tax > 0.06 THEN 'edge_too_far_right' END} END AS s FROM lineitem)""")
def gate_detection(spark, d):
    g = gates.gate_detection("l_quantity", "l_discount", "l_tax", 10, 0.05, 0.06)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", g["accepted"].alias("accepted"), g["reason"].alias("reason"))


_PIXELS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 7 % 256 AS r, l_suppkey * 11 % 256 AS g, l_orderkey * 5 % 256 AS b FROM lineitem)"


def _pixels(spark, d):
    li = _table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 7 % 256).alias("r"), (F.col("l_suppkey") * 11 % 256).alias("g"), (F.col("l_orderkey") * 5 % 256).alias("b"))


_HSV = f"""
    WITH p AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM {_PIXELS}),
    q AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS hue FROM p),
    c AS (SELECT *, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE round(255.0 * d / v) END AS s FROM q)"""


@_query(f"""{_HSV}
    SELECT l_orderkey, l_linenumber, l_partkey, v / 255 > 0.8 AND s / 255 < 0.15 AS snow, h BETWEEN 90 AND 130 AS sky,
        h BETWEEN 85 AND 140 AND s >= 40 AND v >= 20 OR v <= 55 AND s <= 85 AS water, b >= r + 8 AND b >= g + 5 AND v <= 210 OR v <= 45 AS margin FROM c""")
def pixel_rules(spark, d):
    """Snow, sky and both water rules on colours."""
    c = ("r", "g", "b")
    rules = {"snow": gates.snow_pixel(*c), "sky": gates.sky_pixel(*c), "water": gates.keep_water(*c), "margin": gates.keep_water_rgb(*c, 8, 5, 210, 45)}
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *[v.alias(k) for k, v in rules.items()])


@_query(f"SELECT raster, r, c, CASE WHEN v IN (1, 2, 4) AND r >= 4 THEN v ELSE 0 END AS v FROM {CELLS}")
def stable_classes(spark, d):
    schema = _cells(spark, d).select(F.col("v").alias("id")).distinct().withColumn("stable", F.col("id").isin(1, 2, 4))
    return features.stable_classes(_cells(spark, d), schema, 16, 0.25).select("raster", "r", "c", F.col("v").cast("long").alias("v"))


@_query(f"SELECT raster, r, c, CASE v WHEN 1 THEN 7 WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 0 END AS v FROM {CELLS}")
def remap_classes(spark, d):
    return features.remap_classes(_cells(spark, d), {1: 7, 2: 1, 5: 3}).select("raster", "r", "c", F.col("v").cast("long").alias("v"))


@_query(f"""SELECT event_id, event_type = 'error' OR value < 30 AND (abs(event_id % 9 - 4) > degrees(radians(2.0)) OR event_id % 130 > 60) AS unreliable FROM {LOG}""")
def mask_unreliable(spark, d):
    method = F.when(F.col("event_type") == "error", "fallback").otherwise("model")
    k = F.col("event_id")
    return _log(spark, d).select("event_id", gates.mask_unreliable(method, F.col("value") / 100, F.radians((k % 9 - 4).cast("double")), k % 130).alias("unreliable"))


@_query("""
    SELECT run, frame_idx, round(frame_idx / 25.0, 6) AS t_sec, lat, lon FROM (SELECT o_orderkey AS run, unnest(range(0, greatest(o_orderkey % 40, 1), 10)) AS frame_idx, 55.5::DOUBLE AS lat,
        CASE WHEN o_orderkey % 3 = 0 THEN 37.25 ELSE o_orderkey % 90 END::DOUBLE AS lon FROM orders)""")
def frame_index(spark, d):
    k = F.col("o_orderkey")
    runs = _table(spark, d, "orders").select(k.alias("run"), (k % 40).alias("n_frames"), F.lit(25.0).alias("fps"), F.lit(None).cast("double").alias("lat"), F.when(k % 3 != 0, (k % 90).cast("double")).alias("lon"))
    return selection.frame_index(runs, 10, 55.5, 37.25).select("run", F.col("frame_idx").cast("long").alias("frame_idx"), _r("t_sec").alias("t_sec"), "lat", "lon")


# Joins


@_query("""
    SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS missing_image, b.k IS NULL AS missing_mask FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) a
        FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k""")
def pair_tiles(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return joins.pair_tiles(o.filter("k % 3 <> 0"), o.filter("k % 5 <> 0"), ["k"]).select("k", "missing_image", "missing_mask")


_SPANS = f"""(SELECT id, lat, lon, lon - 0.3 AS w, lon + 0.3 AS e, lat - 0.2 AS s, lat + 0.2 AS n FROM {_points_sql()})"""
_TILED = """SELECT id, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM (SELECT id,
    CAST(trunc((w + 180) / 360 * 1024) AS INTEGER) AS x0, CAST(trunc((e + 180) / 360 * 1024) AS INTEGER) AS x1,
    CAST(trunc((1 - asinh(tan(radians(n))) / pi()) / 2 * 1024) AS INTEGER) AS y0, CAST(trunc((1 - asinh(tan(radians(s))) / pi()) / 2 * 1024) AS INTEGER) AS y1 FROM {spans}))"""


def _spans(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return _points(spark, d).select("id", "lat", "lon", (lon - 0.3).alias("w"), (lon + 0.3).alias("e"), (lat - 0.2).alias("s"), (lat + 0.2).alias("n"))


def _xy(df):
    return df.select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@_query(_TILED.format(spans=_SPANS))
def tiles_in_bbox(spark, d):
    return _xy(joins.tiles_in_bbox(_spans(spark, d), 10))


@_query(_TILED.format(spans=_SPANS))
def features_to_tiles(spark, d):
    return _xy(joins.features_to_tiles(_spans(spark, d), 10))


@_query(_TILED.format(spans=_SPANS))
def table_functions(spark, d):
    """The SQL table function over boxes."""
    udtf.register(spark)
    _spans(spark, d).createOrReplaceTempView("trackgrid_spans")
    return _xy(spark.sql("SELECT id, t.x, t.y FROM trackgrid_spans, LATERAL tiles_in_bbox(w, s, e, n, 10) t"))


@_query(f"""
    WITH t AS (SELECT id, CAST(trunc((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS y FROM {_points_sql()})
    SELECT id, x + i AS wx, y + j AS wy FROM t, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)""")
def tile_window(spark, d):
    t = _points(spark, d).withColumn("t", geo.deg2tile("lat", "lon", 10)).select("id", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))
    return joins.tile_window(t, 2).select("id", "wx", "wy")


@_query(f"""
    SELECT id, map_id FROM {_points_sql()} p JOIN {BOXES} b ON p.c_nationkey % 5 = b.map_id % 5 AND p.lon > (w + e) / 2 - 3 AND p.lon <= (w + e) / 2 + 3 AND p.lat >= s + 1 AND p.lat < n - 1
        AND NOT (p.lon > (w + e) / 2 - 1 AND p.lon <= (w + e) / 2 + 1 AND p.lat >= s + 1.5 AND p.lat < n - 1.5)""")
def cells_in_polygons(spark, d):
    """Points in boxes with a hole; a point on a western or northern edge is outside."""
    b = _boxes(spark, d)
    mid = (F.col("w") + F.col("e")) / 2
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda dx, dy: F.array(at(mid - dx, F.col("s") + dy), at(mid + dx, F.col("s") + dy), at(mid + dx, F.col("n") - dy), at(mid - dx, F.col("n") - dy))
    polygons = b.select("map_id", (F.col("map_id") % 5).alias("g"), F.array(ring(3, 1), ring(1, 1.5)).alias("parts"))
    cells = _points(spark, d).select("id", (F.col("c_nationkey") % 5).alias("g"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return joins.cells_in_polygons(cells, polygons, ["g"]).select("id", "map_id")


_NEAR = """
    WITH p AS (SELECT c_custkey AS id, c_nationkey AS g, c_custkey // 40 % 40 AS r, c_custkey % 40 AS c FROM customer),
    q AS (SELECT *, c::DOUBLE AS x, r::DOUBLE AS y FROM p), s AS (SELECT s_suppkey, s_nationkey AS g, s_suppkey % 40 AS x0, s_suppkey * 3 % 40 AS y0, s_suppkey * 7 % 40 AS x1, s_suppkey * 11 % 40 AS y1, 1.5 AS w FROM supplier),
    j AS (SELECT q.*, s.*, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS l FROM q JOIN s USING (g)),
    t AS (SELECT *, CASE WHEN l = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / l)) END AS t FROM j)
    SELECT DISTINCT g, r, c FROM t WHERE pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2) <= 2.25"""


@_query(_NEAR)
def cells_near_lines(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    cells = _table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.floor(k / 40) % 40).alias("r"), (k % 40).alias("c"))
    cells = cells.withColumn("x", F.col("c").cast("double")).withColumn("y", F.col("r").cast("double")).dropDuplicates(["g", "r", "c"])
    at = lambda i, j: F.struct((s * i % 40).cast("double").alias("x"), (s * j % 40).cast("double").alias("y"))
    lines = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.lit(1.5).alias("width_m"), F.array(F.array(at(1, 3), at(7, 11))).alias("parts"))
    return joins.cells_near_lines(cells, lines, ["g"]).select("g", "r", "c")


@_query("""SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END, 999.0::DOUBLE) AS residual, CASE WHEN o_orderkey % 4 > 0 THEN 0.5 ELSE 0 END::DOUBLE AS gate,
    CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END::DOUBLE AS valid FROM orders""")
def attach_tiebreak(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("residual"))
    extra = o.filter("k % 4 > 0").withColumn("gate", F.lit(0.5)).withColumn("valid", F.lit(1.0))
    return joins.attach_tiebreak(o.select("k"), extra, ["k"]).select("k", "residual", "gate", "valid")


@_query(f"""
    SELECT p.id, coalesce(c.v, 0) AS v FROM (SELECT c_custkey AS id, c_custkey % 500 AS raster, greatest(0, least(15, c_custkey % 23 - 3)) AS r, greatest(0, least(15, c_custkey % 19)) AS c FROM customer) p
        LEFT JOIN {CELLS} c ON p.raster = c.raster AND p.r = c.r AND p.c = c.c""")
def sample_raster(spark, d):
    k = F.col("c_custkey")
    p = _table(spark, d, "customer").select(k.alias("id"), (k % 500).alias("raster"), (k % 19 + 0.25).alias("px"), (k % 23 - 3 + 0.25).alias("py"))
    return joins.sample_raster(p, _cells(spark, d), "raster", 16, 16).select("id", F.col("v").cast("long").alias("v"))


@_query("SELECT n_nationkey AS k, agl, crop, count(*) OVER () AS n FROM nation, (VALUES (60.0::DOUBLE), (90.0), (120.0)) AS a(agl), (VALUES ('full'), ('half')) AS b(crop)")
def param_grid(spark, d):
    keys = [r[0] for r in _table(spark, d, "nation").select(F.col("n_nationkey").cast("long")).collect()]  # nations are few
    grid = joins.param_grid(spark, k=keys, agl=[60.0, 90.0, 120.0], crop=["full", "half"])
    return grid.withColumn("n", F.lit(grid.count()).cast("long"))


_HITS = """(SELECT q.vec_id AS query_id, g.vec_id, q.label AS own, g.label AS label, round(list_dot_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings g ON q.vec_id % 10 = 0 AND g.vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, g.vec_id) <= 5)"""


def _hits(spark, d, k=5):
    e = _table(spark, d, "embeddings")
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieval.cosine_topk(q, e.filter("vec_id % 10 <> 0"), k)
    hits = hits.join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.withColumn("error", (F.col("label") - F.col("own")).cast("double"))


@_query(f"""
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_HITS})
    SELECT query_id, rank, min(abs(label - own))::DOUBLE AS error, min(min(abs(label - own))::DOUBLE) OVER (PARTITION BY query_id ORDER BY rank) AS best_error FROM h GROUP BY query_id, rank""")
def prefix_min(spark, d):
    return retrieval.prefix_min(_hits(spark, d).withColumn("error", F.abs("error"))).select("query_id", "rank", "error", "best_error")


@_query(f"""
    WITH h AS (SELECT * FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1),
    p AS (SELECT vec_id % 3 <> 0 AS ref, coalesce(query_id // 10 = vec_id // 10 AND vec_id % 3 <> 0, false) AS exact, label = own AS inside FROM h)
    SELECT round(avg(CASE WHEN ref THEN 100.0 ELSE 0 END), 6) AS reference_pct, round(avg(CASE WHEN NOT ref THEN 100.0 ELSE 0 END), 6) AS distractor_pct,
        round(avg(CASE WHEN exact THEN 100.0 ELSE 0 END), 6) AS exact_pct, round(avg(CASE WHEN inside THEN 100.0 ELSE 0 END), 6) AS inside_pct FROM p""")
def top1_shares(spark, d):
    """Shares of first hits; exact_pair() compares tens of ids."""
    role = F.when(F.col("vec_id") % 3 != 0, "reference").otherwise("distractor")
    ten = lambda c: F.floor(F.col(c) / 10)
    p = _hits(spark, d, 1).select(role.alias("top1_role"), retrieval.exact_pair(ten("query_id"), ten("vec_id"), role).alias("exact"), (F.col("label") == F.col("own")).alias("inside"))
    out = retrieval.top1_shares(p)
    return out.select(*[_r(c).alias(c) for c in out.columns])


@_query(f"""
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, abs(label - own)::DOUBLE AS error FROM {_HITS}),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS new_rank FROM h),
    f AS (SELECT query_id, max(CASE WHEN rank = 1 THEN error END) AS b, max(CASE WHEN new_rank = 1 THEN error END) AS a FROM n GROUP BY 1)
    SELECT round(avg(CASE WHEN b <= 2 THEN 100.0 ELSE 0 END), 6) AS recall_before, round(avg(CASE WHEN a <= 2 THEN 100.0 ELSE 0 END), 6) AS recall_after,
        round(avg(CASE WHEN a <= 2 THEN 100.0 ELSE 0 END) - avg(CASE WHEN b <= 2 THEN 100.0 ELSE 0 END), 6) AS delta_pp, median(b) AS median_before, median(a) AS median_after FROM f""")
def rerank_summary(spark, d):
    hits = windows.rank_by(_hits(spark, d).withColumn("error", F.abs("error")).withColumnRenamed("rank", "first_rank"), ["query_id"], ["vec_id"])
    hits = hits.withColumnsRenamed({"rank": "new_rank", "first_rank": "rank"})
    out = retrieval.rerank_summary(hits, 2.0)
    return out.select(*[_r(c).alias(c) for c in ("recall_before", "recall_after", "delta_pp")], "median_before", "median_after")


@_query(f"""
    WITH h AS (SELECT id, sqrt(pow((lat - lag(lat) OVER o) * 111320, 2) + pow((lon - lag(lon) OVER o) * 111320 * cos(radians((lat + lag(lat) OVER o) / 2)), 2)) AS m FROM {_points_sql()} WINDOW o AS (PARTITION BY c_nationkey ORDER BY id)),
    s AS (SELECT avg(CASE WHEN m <= 900000 THEN 100.0 WHEN m IS NOT NULL THEN 0 END) AS p FROM h)
    SELECT round(p, 6) AS near_pct, p >= 70 AS consistent FROM s""")
def hop_consistency(spark, d):
    w = windows._w(["c_nationkey"], ["id"])
    p = _points(spark, d).withColumn("la", F.lag("lat").over(w)).withColumn("lo", F.lag("lon").over(w))
    out = retrieval.hop_consistency(p, geo.dist_local_m("lat", "lon", "la", "lo"), 900_000.0)
    return out.select(_r("near_pct").alias("near_pct"), "consistent")


# Aggregates


@_query("""
    WITH m AS (SELECT l_returnflag AS run, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS frame, CASE WHEN l_quantity > 30 THEN 'TRACK' WHEN l_quantity > 10 THEN 'WEAK' ELSE 'RELOCALIZE' END AS state,
        CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount > 0.08 THEN 'high' ELSE '' END AS reason, l_quantity - 10 AS inliers, l_tax AS ratio, l_suppkey % 3 AS tile FROM lineitem),
    t AS (SELECT *, coalesce(tile <> lag(tile) OVER (PARTITION BY run ORDER BY frame), false) AS moved FROM m),
    c AS (SELECT run, reason, count(*) AS n FROM m WHERE reason <> '' GROUP BY ALL)
    SELECT run, count(*) AS frames, round(100.0 * count_if(state = 'TRACK') / count(*), 6) AS track_pct, round(100.0 * count_if(state = 'WEAK') / count(*), 6) AS weak_pct,
        round(100.0 * count_if(state = 'RELOCALIZE') / count(*), 6) AS relocalize_pct, count_if(state = 'TRACK') AS track_count, count_if(state = 'WEAK') AS weak_count, count_if(state = 'RELOCALIZE') AS relocalize_count,
        count_if(reason <> '') AS rejects, median(greatest(inliers, 0))::DOUBLE AS median_inliers, median(ratio)::DOUBLE AS median_ratio, count_if(moved) AS tile_changes,
        (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM c WHERE c.run = t.run) AS by_reason FROM t GROUP BY run""")
def diag_summary(spark, d):
    li, q = _table(spark, d, "lineitem"), F.col("l_quantity")
    state = F.when(q > 30, "TRACK").when(q > 10, "WEAK").otherwise("RELOCALIZE")
    reason = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") > 0.08, "high").otherwise("")
    m = li.select(F.col("l_returnflag").alias("run"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("frame"), state.alias("state"), reason.alias("reason"), (q - 10).alias("inliers"), F.col("l_tax").alias("ratio"), (F.col("l_suppkey") % 3).alias("tile"))
    out = aggregates.diag_summary(m, ["run"])
    by = F.array_join(F.transform(F.array_sort(F.map_entries("rejects_by_reason")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("run", "frames", *[_r(c).alias(c) for c in ("track_pct", "weak_pct", "relocalize_pct")], "track_count", "weak_count", "relocalize_count", "rejects", F.col("median_inliers").cast("double").alias("median_inliers"), F.col("median_ratio").cast("double").alias("median_ratio"), "tile_changes", by.alias("by_reason"))


@_query("""SELECT stage, round(median(ms), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM
    (SELECT 'l_quantity' AS stage, l_quantity - 5 AS ms FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) WHERE ms > 0 GROUP BY 1""")
def timing_stats(spark, d):
    li = _table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity") - 5)
    out = aggregates.timing_stats(li, ["l_quantity", "l_extendedprice"])
    return out.select("stage", _r("median_ms").alias("median_ms"), _r("p95_ms").alias("p95_ms"))


@_query(f"""
    WITH r AS (SELECT event_type AS k, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {LOG})
    SELECT k, round(median(ms), 6) AS median_ms, count(*) AS n, round(max(CASE WHEN i = floor(n * 0.95) THEN ms END), 6) AS p95_ms, round(1000 / median(ms), 6) AS fps FROM r GROUP BY 1""")
def latency_stats(spark, d):
    out = aggregates.latency_stats(_log(spark, d).select(F.col("event_type").alias("k"), F.col("value").alias("ms")), ["k"])
    return out.select("k", _r("median_ms").alias("median_ms"), "n", _r("p95_ms").alias("p95_ms"), _r("fps").alias("fps"))


@_query("""
    SELECT k, count(*) AS num_matches, count_if(l_discount < 0.06) AS num_inliers, round(avg(CASE WHEN l_discount < 0.06 THEN 1.0 ELSE 0 END), 6) AS inlier_ratio,
        round(avg(CASE WHEN l_discount < 0.06 THEN sqrt(pow(2 * l_quantity + 3 - l_quantity * 2 - l_tax, 2) + pow(2 * l_linenumber - 1 - l_linenumber, 2)) END), 6) AS reproj_px
    FROM (SELECT *, l_orderkey % 300 AS k FROM lineitem) GROUP BY 1""")
def match_quality(spark, d):
    li = _table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 300)
    m = li.select("k", F.col("l_quantity").cast("double").alias("x0"), F.col("l_linenumber").cast("double").alias("y0"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("x1"), F.col("l_linenumber").cast("double").alias("y1"), (F.col("l_discount") < 0.06).alias("inlier"))
    h = li.select("k").distinct().withColumn("h", F.array(*[F.lit(float(x)) for x in (2, 0, 3, 0, 2, -1, 0, 0, 1)]))
    out = aggregates.match_quality(m, h, ["k"])
    return out.select("k", "num_matches", "num_inliers", _r("inlier_ratio").alias("inlier_ratio"), _r("reproj_px").alias("reproj_px"))


@_query(f"""SELECT event_id, round(-value / dt, 6) AS vx, round(-(value + 1) / dt, 6) AS vy, round(-0.01 * value / dt, 6) AS yaw_rate, n >= 8 AND dt > 0 AS valid FROM
    (SELECT event_id, value, 0.1 * (event_id % 5 + 1) AS dt, event_id % 20 AS n FROM {LOG})""")
def motion_steps(spark, d):
    fits = _log(spark, d).select("event_id", F.col("value").alias("tx"), (F.col("value") + 1).alias("ty"), (F.col("value") * 0.01).alias("theta"), (0.1 * (F.col("event_id") % 5 + 1)).alias("dt"), (F.col("event_id") % 20).alias("num_inliers"))
    out = aggregates.motion_steps(fits)
    return out.select("event_id", *[_r(c).alias(c) for c in ("vx", "vy", "yaw_rate")], "valid")


@_query(f"""SELECT track, round(pow(1 - avg(CASE WHEN flag THEN 1.0 ELSE 0 END), 2) * coalesce(avg(CASE WHEN NOT flag THEN value END), 0), 6) AS score FROM {LOG} GROUP BY 1""")
def gated_score(spark, d):
    return aggregates.gated_score(_log(spark, d).select("track", F.col("flag").alias("fallback"), F.col("value").alias("score")), ["track"]).withColumn("score", _r("score"))


@_query("""SELECT l_returnflag AS k, median(l_discount)::DOUBLE AS ratio, round(median(CASE WHEN l_extendedprice / 100 < 100 THEN l_extendedprice / 100 END), 6) AS residual, round(avg(l_tax), 6) AS cheirality, count(*) AS pairs FROM lineitem GROUP BY 1""")
def pair_summary(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("ratio"), (F.col("l_extendedprice") / 100).alias("residual"), F.col("l_tax").alias("cheirality"))
    out = aggregates.pair_summary(li, ["k"])
    return out.select("k", F.col("ratio").cast("double").alias("ratio"), _r("residual").alias("residual"), _r("cheirality").alias("cheirality"), "pairs")


@_query(f"""
    WITH r AS (SELECT track, event_id, value, 20 + event_id % 7 + event_id // 1000 AS sigma FROM {LOG}),
    f AS (SELECT *, coalesce(sigma < lag(sigma) OVER (PARTITION BY track ORDER BY event_id), false) AS fell FROM r)
    SELECT track, round(avg(CASE WHEN value < 3 * sigma THEN 1.0 ELSE 0 END), 6) AS covered, NOT bool_or(fell) AS monotone FROM f GROUP BY 1""")
def sigma_coverage(spark, d):
    k = F.col("event_id")
    log = _log(spark, d).select("track", "event_id", F.col("value").alias("error"), (20 + k % 7 + F.floor(k / 1000)).alias("sigma"))
    return aggregates.sigma_coverage(log, ["track"], "event_id").withColumn("covered", _r("covered"))


# Windows and selections


@_query(f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM {LOG}")
def rank_by(spark, d):
    return windows.rank_by(_log(spark, d), ["event_type"], [F.desc("value"), "event_id"]).select("event_id", "rank")


@_query(f"SELECT track, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM {LOG} GROUP BY 1")
def segment_edges(spark, d):
    return windows.segment_edges(_log(spark, d), ["track"], ["event_id"], "value")


@_query("SELECT 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n, true AS again FROM orders UNION ALL SELECT 'val', count(*) - CAST(floor(count(*) * 0.8) AS BIGINT), true FROM orders")
def split_random(spark, d):
    """Sizes of both sides, and whether another partitioning gives the same rows."""
    o = _table(spark, d, "orders").select("o_orderkey")
    one, two = selection.split_random(o, "o_orderkey", 0.8, 7), selection.split_random(o.repartition(5), "o_orderkey", 0.8, 7)
    both = one.join(two.withColumnRenamed("split", "other"), "o_orderkey")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.bool_and(F.col("split") == F.col("other")).alias("again"))


@_query(f"SELECT track, least(count(*), 3) AS n, least(count(*), 3) AS distinct_ids FROM {LOG} GROUP BY 1")
def sample_per_key(spark, d):
    return selection.sample_per_key(_log(spark, d), "track", 3, "event_id").groupBy("track").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"))


@_query(f"""
    SELECT track, count(*) AS rows, least(count(*), 4) AS strata, count(*) >= 4 AS whole FROM {LOG} GROUP BY 1""")
def jittered_indices(spark, d):
    log = _log(spark, d)
    out = selection.jittered_indices(log, ["track"], ["event_id"], 4).groupBy("track").agg(F.count_distinct("stratum").alias("strata"))
    rows = log.groupBy("track").agg(F.count("*").alias("rows"))
    return rows.join(out, "track").select("track", "rows", "strata", (F.col("rows") >= 4).alias("whole"))


_PREVIEW = f"(SELECT raster AS patch_id, round(avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0 END), 6) AS non_background_ratio, count(DISTINCT v) AS n_classes FROM {CELLS} GROUP BY 1)"


@_query(f"SELECT patch_id, round(2 * n_classes - abs(non_background_ratio - 0.45), 6) AS preview_score FROM {_PREVIEW} ORDER BY 2 DESC, 1 LIMIT 20")
def preview_rank(spark, d):
    h = aggregates.class_hist(_cells(spark, d), ["raster"]).select(F.col("raster").alias("patch_id"), "non_background_ratio", F.size("pixel_hist").alias("n_classes"))
    return selection.preview_rank(h, 20, "patch_id").select("patch_id", _r("preview_score").alias("preview_score"))


@_query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS o_totalprice FROM orders) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def worst_n(spark, d):
    o = _table(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")))
    return selection.worst_n(o, "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


_GRID = """(SELECT l_suppkey AS k, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END), 6) AS rate, median(l_quantity) AS inliers, round(avg(l_tax), 6) AS residual FROM lineitem GROUP BY 1)"""


@_query(f"SELECT k, row_number() OVER (ORDER BY rate DESC, inliers DESC, CASE WHEN k % 5 > 0 THEN residual END NULLS LAST, k) AS rank FROM {_GRID}")
def rank_grid(spark, d):
    g = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.round(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)), 6).alias("rate"), F.median("l_quantity").alias("inliers"), F.round(F.avg("l_tax"), 6).alias("residual")
    )
    g = g.withColumn("residual", F.when(F.col("k") % 5 > 0, F.col("residual")).otherwise(F.lit(float("inf"))))
    return selection.rank_grid(g, "rate", "inliers", "residual", ["k"]).select("k", "rank")


@_query(f"""
    WITH c AS (SELECT k, residual, rate AS gate FROM {_GRID}), r AS (SELECT *, row_number() OVER w AS rank, lead(residual) OVER w - residual AS margin FROM c
        WINDOW w AS (ORDER BY CASE WHEN gate >= 0.5 THEN 0 ELSE 1 END, CASE WHEN gate >= 0.5 THEN residual END NULLS LAST, gate DESC, k))
    SELECT k, rank, round(margin, 6) AS margin FROM r""")
def tiebreak_rank(spark, d):
    g = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)), 6).alias("gate"), F.round(F.avg("l_tax"), 6).alias("residual"))
    return selection.tiebreak_rank(g, 0.5, "k").select("k", "rank", _r("margin").alias("margin"))


@_query(f"""
    WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY track ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM {LOG})
    SELECT event_id FROM r WHERE list_contains(list_transform(range(0, 4), lambda j: CAST(floor((n - 1) * (0.05 + 0.3 * j)) AS BIGINT)), i)""")
def sample_indices(spark, d):
    return selection.sample_indices(_log(spark, d), ["track"], ["event_id"], 4).select("event_id")


@_query("SELECT c_nationkey AS region FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def region_except(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_nationkey").alias("region"))
    s = _table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select("s_nationkey")
    return selection.region_except(c, s, _table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@_query("SELECT 'tiles/' || (c_custkey % 700) AS path FROM customer UNION SELECT 'tiles/' || (s_suppkey % 900) FROM supplier")
def discover(spark, d):
    path = lambda name, k, n: _table(spark, d, name).select(F.concat(F.lit("tiles/"), F.col(k) % n).alias("path"))
    return selection.discover(path("customer", "c_custkey", 700), path("supplier", "s_suppkey", 900))


@_query(f"""
    SELECT a.segment_id FROM (SELECT segment_id, start - 6 * (segment_id % 3) AS start, "end" FROM {SEGMENTS}) a
        WHERE EXISTS (SELECT 1 FROM (SELECT segment_id, start - 6 * (segment_id % 3) AS start, "end" FROM {SEGMENTS}) b WHERE (b.start, b."end") < (a.start, a."end") AND b."end" > a.start)""")
def overlapping(spark, d):
    s = _segments(spark, d).withColumn("start", F.col("start") - 6 * (F.col("segment_id") % 3)).withColumn("g", F.lit(0))
    return selection.overlapping(s, ["g"]).select("segment_id")


@_query(f"SELECT event_id FROM {LOG} QUALIFY t <= lag(t) OVER (PARTITION BY track ORDER BY value, event_id)")
def not_increasing(spark, d):
    return selection.not_increasing(_log(spark, d).withColumn("place", F.struct("value", "event_id")), ["track"], "place", "t").select("event_id")
