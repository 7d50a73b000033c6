"""Registered queries of the readers and writers: files that Spark derives from the provided tables, then read again."""

from __future__ import annotations

import struct
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources, streaming
from .queries import CELLS, LOG, _cells, _log, _points, _points_sql, _query, _r, _table


#: Features of a GeoJSON file, about.
LAYER_ROWS = 10_000


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a temporary one only where Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/files-{uuid.uuid4().hex}"


def _text(df: DataFrame, key: str, path: str) -> str:
    """Texts (key, value) in one file a key, below path/key=...; -> path."""
    df.select(key, "value").repartition(key).write.partitionBy(key).text(path)
    return path


def _json(rows: DataFrame, key: str, path: str, **fields: Column) -> str:
    """One JSON object of aggregated fields for each key, each in its own file; -> path."""
    objects = rows.groupBy(key).agg(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"))
    return _text(objects, key, path)


@_query("SELECT c_nationkey AS nation, true AS missing FROM customer GROUP BY 1")
def read_rasters(spark, d):
    """Files that are no images stay, as missing."""
    path = _text(_table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("value")), "c_nationkey", _folder(spark))
    out = sources.read_rasters(spark, f"{path}/*")
    return out.select(F.regexp_extract("origin", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), "missing")


@_query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'north_' || (o_custkey % 7) END AS region, CASE WHEN o_orderkey % 5 > 0 THEN 17 END AS z,
        CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 900 END AS x, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 800 END AS y FROM orders""")
def parse_tile_name(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat_ws("_", F.lit("north"), c % 7, F.lit(17), k % 900, c % 800)
    o = _table(spark, d, "orders").withColumn("path", F.concat(F.lit("d/"), F.when(k % 5 > 0, name).otherwise("loose_17_name"), F.lit(".png")))
    o = o.withColumn("t", sources.parse_tile_name(F.col("path")))
    return o.select("o_orderkey", "t.region", F.col("t.z").alias("z"), F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


@_query(f"""
    SELECT 'map' AS kind, 'm' || id AS name, NULL AS stamp, round(lon + 0.05, 4) AS lon, round(lat - 0.1, 4) AS lat FROM {_points_sql()} WHERE id % 4 = 0
    UNION ALL SELECT 'query', NULL, NULL, lon, lat FROM {_points_sql()} WHERE id % 4 = 1 UNION ALL SELECT 'frame', NULL, 't' || id, lon, lat FROM {_points_sql()} WHERE id % 4 = 2""")
def named_images(spark, d):
    num = lambda c: F.format_string("%.3f", F.col(c) if isinstance(c, str) else c)
    p, at = _points(spark, d), F.lit("@")
    k = F.col("id") % 4
    fields = F.when(k == 0, F.concat(F.lit("m"), "id", at, num(F.col("lon") + 0.1), at, num(F.col("lat") - 0.2), at, num("lon"), at, num("lat")))
    fields = fields.when(k == 1, F.concat(num("lon"), at, num("lat"))).when(k == 2, F.concat(F.lit("t"), "id", at, num("lon"), at, num("lat"))).otherwise("a@b@c@d")
    files = p.select(F.concat(F.lit("x/y/"), fields, F.lit(".png")).alias("path"))
    none = F.lit(None).cast("string")
    m = sources.named_images(files, "map").select(F.lit("map").alias("kind"), "name", none.alias("stamp"), _r("center_lon", 4).alias("lon"), _r("center_lat", 4).alias("lat"))
    q = sources.named_images(files, "query").select(F.lit("query"), none, none, "lon", "lat")
    f = sources.named_images(files, "frame").select(F.lit("frame"), none, "stamp", "lon", "lat")
    return m.union(q).union(f)


@_query("""SELECT 'd/' || s_suppkey || '.png' AS filepath, s_suppkey::DOUBLE AS x, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS y, NULL::DOUBLE AS z,
    CASE WHEN s_suppkey % 2 = 0 THEN 1.5 END::DOUBLE AS roll, CASE WHEN s_suppkey % 4 = 0 THEN 'forest' END AS landcover FROM supplier""")
def read_poses(spark, d):
    s, k = _table(spark, d, "supplier"), F.col("s_suppkey")
    rows = s.select(
        F.concat(F.lit("d/"), k, F.lit(".png")).alias("filepath"), k.alias("x"), F.when(k % 3 > 0, F.col("s_acctbal").cast("string")).otherwise("nan").alias("y"), F.lit("-").alias("z"),
        F.when(k % 2 == 0, "1.5").alias("roll"), F.lit("").alias("pitch"), F.lit("0").alias("yaw"), F.lit("0").alias("undulation"), F.when(k % 4 == 0, "forest").alias("landcover"),
    )
    path = _folder(spark)
    rows.write.option("header", True).csv(path)
    return sources.read_poses(spark, path).select("filepath", "x", "y", "z", "roll", "landcover")


@_query("SELECT c_nationkey AS nation, 'distractor' AS role, true AS placeless FROM customer GROUP BY 1")
def scan_distractors(spark, d):
    path = _text(_table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("value")), "c_nationkey", _folder(spark))
    files = sources.list_files(spark, path, "*.txt")
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("long")
    return sources.distractors(files).select(nation.alias("nation"), "role", (F.col("lat").isNull() & F.startswith("image_id", F.lit("part-"))).alias("placeless"))


@_query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'q' || p_partkey ELSE 'id' || p_partkey END AS image_id, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS lat FROM part")
def read_manifest(spark, d):
    p, k = _table(spark, d, "part"), F.col("p_partkey")
    rows = p.select(
        F.when(k % 3 > 0, F.concat(F.lit("id"), k)).alias("image_id"), F.concat(F.lit("dir/q"), k, F.lit(".jpg")).alias("path"),
        F.when(k % 4 > 0, F.col("p_retailprice").cast("string")).otherwise("bad").alias("lat"),
    )
    path = _folder(spark)
    rows.write.option("header", True).csv(path)
    return sources.read_manifest(spark, path, ["lat"]).select("image_id", "lat")


def _wkb_box(w: pa.Array, s: pa.Array) -> pa.Array:
    """Squares of one degree as WKB polygons."""
    out = []
    for x, y in zip(w.to_pylist(), s.to_pylist()):
        ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
        out.append(struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<2d", *p) for p in ring))
    return pa.array(out, pa.binary())


@_query(f"""
    SELECT 'water' AS layer, id::VARCHAR AS id, 'Polygon' AS kind, 5 AS n_points, round(lon, 6) AS x, round(lat, 6) AS y FROM {_points_sql()} WHERE id % 3 > 0
    UNION ALL SELECT 'transportation', id::VARCHAR, CASE WHEN id % 2 = 0 THEN 'LineString' ELSE 'MultiPolygon' END, 4 - id % 2, round(lon, 6), round(lat, 6) FROM {_points_sql()}""")
def resolve_layer(spark, d):
    """A GeoParquet layer, and a GeoJSON one in web mercator."""
    p, path = _points(spark, d), _folder(spark)
    box = F.arrow_udf(_wkb_box, "binary")
    geometry = F.when(F.col("id") % 3 > 0, box(F.col("lon").cast("double"), F.col("lat").cast("double")))
    p.select("id", geometry.alias("geometry")).write.parquet(f"{path}/water.parquet")
    x, y = F.radians("lon") * 6_378_137.0, F.log(F.tan(F.radians(F.col("lat") / 2 + 45))) * 6_378_137.0
    at = lambda i: F.concat(F.lit("["), (x + i).cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), F.concat_ws(",", *[at(i) for i in range(4)]), F.lit("]"))
    ring = F.concat(F.lit("[[["), F.concat_ws(",", *[at(i) for i in range(3)]), F.lit("]]]"))
    kind = F.when(F.col("id") % 2 == 0, "LineString").otherwise("MultiPolygon")
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"'), "id", F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'),
        F.when(F.col("id") % 2 == 0, line).otherwise(ring), F.lit("}}"),
    )
    crs = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},"features":['
    parts = max(16, -(-p.count() // LAYER_ROWS))  # a file is read whole by one task
    files = p.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("b"), feature.alias("f")).groupBy("b").agg(F.concat(F.lit(crs), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    _text(files, "b", f"{path}/transportation.geojson")
    both = sources.resolve_layer(spark, path, "water").unionByName(sources.resolve_layer(spark, path, "transportation"))
    first = F.flatten("parts")
    return both.select("layer", F.col("attrs")["id"].alias("id"), "kind", F.size(first).cast("long").alias("n_points"), _r(first[0]["x"]).alias("x"), _r(first[0]["y"]).alias("y"))


@_query("""
    SELECT o_orderkey AS feature_id, CASE o_orderkey % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'pond' WHEN o_orderkey % 5 = 1 THEN 'river' ELSE 'lake' END AS "class"
    FROM orders UNION ALL SELECT NULL, 'buildings', count_if(o_orderkey % 5 = 2 AND o_orderkey % 3 > 0)::VARCHAR FROM orders""")
def read_osm_dump(spark, d):
    k = F.col("o_orderkey")
    point = lambda i, j: F.struct(F.lit(float(i)).alias("lat"), F.lit(float(j)).alias("lon"))
    square = F.array(point(0, 0), point(0, 1), point(1, 1), point(0, 0))
    tags = F.when(k % 5 == 0, F.create_map(F.lit("natural"), F.lit("water"), F.lit("water"), F.lit("Pond"))).when(k % 5 == 1, F.create_map(F.lit("waterway"), F.lit("stream")))
    tags = tags.when(k % 5 == 2, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map(F.lit("landuse"), F.lit("meadow")))
    element = F.struct(
        F.when(k % 3 < 2, "way").otherwise("relation").alias("type"), k.alias("id"), tags.alias("tags"),
        F.when(k % 3 == 0, F.slice(square, 1, 3)).when(k % 3 == 1, square).alias("geometry"),
        F.when(k % 3 == 2, F.array(F.struct(F.lit("outer").alias("role"), square.alias("geometry")), F.struct(F.lit("inner").alias("role"), square.alias("geometry")))).alias("members"),
    )
    rows = _table(spark, d, "orders").select(F.floor(k / 500).alias("b"), element.alias("e"))
    path = _json(rows, "b", _folder(spark), elements=F.collect_list("e"))
    water = sources.read_osm_dump(spark, f"{path}/*", "water").select("feature_id", "kind", "class")
    houses = sources.read_osm_dump(spark, f"{path}/*", "buildings").filter("size(parts) = 1")
    return water.unionByName(houses.agg(F.lit(None).cast("long").alias("feature_id"), F.lit("buildings").alias("kind"), F.count("*").cast("string").alias("class")))


@_query("""
    SELECT 'v' || n_regionkey AS video, 's' || n_nationkey AS id, 10.0::DOUBLE * n_nationkey AS t, 10.0::DOUBLE * n_nationkey + 5 AS t_end, n_nationkey % 4 = 0 AS dead_reckoning, 60.0::DOUBLE AS sigma FROM nation
    UNION ALL SELECT 'v' || n_regionkey, 'l' || n_nationkey, n_nationkey, NULL, NULL, 5 FROM nation""")
def read_landmarks(spark, d):
    k, n = F.col("n_nationkey"), _table(spark, d, "nation")
    segment = F.struct(F.concat(F.lit("s"), k).alias("id"), (10.0 * k).alias("start_s"), (10.0 * k + 5).alias("end_s"))
    landmark = F.struct(F.concat(F.lit("l"), k).alias("id"), k.cast("double").alias("t_sec"), F.lit(5.0).alias("sigma_m"))
    path = _json(
        n, "n_regionkey", _folder(spark), video=F.concat(F.lit("v"), F.first("n_regionkey")), segments=F.collect_list(segment), landmarks=F.collect_list(landmark),
        track_thresholds=F.struct(F.lit(60.0).alias("max_sigma_pos_m")), expected_dead_reckoning_segments=F.collect_list(F.when(k % 4 == 0, F.concat(F.lit("s"), k))),
    )
    seg, land = sources.read_landmarks(spark, f"{path}/*")
    out = seg.select("video", F.col("segment_id").alias("id"), F.col("start").alias("t"), F.col("end").alias("t_end"), "dead_reckoning", F.col("max_sigma_m").alias("sigma"))
    return out.union(land.select("video", "id", "t", F.lit(None).cast("double"), F.lit(None).cast("boolean"), "sigma_m"))


@_query(f"SELECT event_id, round(value, 6) AS sigma_pos_m, accepted AS map_accepted, CASE WHEN event_id % 3 > 0 THEN flag END AS obstructed FROM {LOG}")
def read_state_log(spark, d):
    log, path = _log(spark, d), _folder(spark)
    flag = F.when(F.col("event_id") % 3 > 0, F.col("flag").cast("int").cast("string")).otherwise("?")
    rows = log.select("event_id", F.col("t").alias("t_sec"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.col("value").alias("sigma_pos_m"), F.col("accepted").cast("int").alias("map_accepted"), flag.alias("obstructed"))
    rows.write.option("header", True).csv(path)
    return sources.read_state_log(spark, path).select(F.col("event_id").cast("long").alias("event_id"), _r("sigma_pos_m").alias("sigma_pos_m"), "map_accepted", "obstructed")


@_query("SELECT vec_id, len(embedding) AS n, 'm' AS model_name, vec_id::DOUBLE / 10 AS lat FROM embeddings")
def read_gallery(spark, d):
    e, path = _table(spark, d, "embeddings"), _folder(spark)
    e.select("vec_id", "embedding", F.lit("m").alias("model_name")).write.parquet(f"{path}/rows")
    e.select("vec_id", (F.col("vec_id") / 10).alias("lat")).write.parquet(f"{path}/places")
    out = sources.read_gallery(spark, f"{path}/rows", "m", f"{path}/places")
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), "model_name", "lat")


@_query("""
    SELECT printf('N%02dE%03d', 40 + n_regionkey, 30 + n_regionkey) AS dem_id, 1201 * 1201 AS n, 1201 AS n_void, (1201 * 1200) * sum(n_nationkey)::DOUBLE AS total,
        round(30 + n_regionkey - 0.5 / 1200, 6) AS west, round(41 + n_regionkey + 0.5 / 1200, 6) AS north FROM nation GROUP BY n_regionkey""")
def read_hgt(spark, d):
    """One elevation tile a region: the sum of its nations' keys everywhere, voids in the first column."""
    height = F.lpad(F.hex(F.sum("n_nationkey")), 4, "0")
    row = F.concat(F.lit("8000"), F.repeat(height, F.lit(1200)))
    name = F.format_string("dem/N%02dE%03d.hgt", 40 + F.col("n_regionkey"), 30 + F.col("n_regionkey"))
    files = _table(spark, d, "nation").groupBy("n_regionkey").agg(name.alias("path"), F.unhex(F.repeat(row, F.lit(1201))).alias("content"))
    cells = sources.hgt_cells(files.select("path", "content"))
    return cells.groupBy("dem_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("elev").isNull()).alias("n_void"), F.sum(F.col("elev").cast("double")).alias("total"), _r(F.max("west")).alias("west"), _r(F.max("north")).alias("north")
    )


@_query("""
    SELECT c_custkey AS "index", c_nationkey AS anchor_index, 'truck' AS prompt, c_custkey % 3 > 0 AS accepted, CASE WHEN c_custkey % 3 = 0 THEN 'far' END AS reason FROM customer""")
def read_anchor_index(spark, d):
    k, c = F.col("c_custkey"), _table(spark, d, "customer")
    one = F.struct(k.alias("index"), (k % 3 > 0).alias("accepted"), F.when(k % 3 == 0, "far").alias("reason"), F.lit(0.5).alias("score"))
    anchor = F.struct(F.first("c_nationkey").alias("anchor_index"), F.array(F.struct(F.lit("truck").alias("prompt"), F.collect_list(one).alias("instances"))).alias("detections"))
    path = _json(c, "c_nationkey", _folder(spark), video=F.lit("v"), anchors=F.array(anchor))
    out = sources.read_anchor_index(spark, f"{path}/*", "v")
    return out.select(F.col("index").cast("long").alias("index"), F.col("anchor_index").cast("long").alias("anchor_index"), "prompt", "accepted", "reason")


@_query("""
    SELECT 'land_use' AS layer, CASE WHEN p_size % 2 = 0 THEN 'kind' END AS attr, lower(p_type) || p_size AS value, max(p_size % 7) AS class_id FROM part GROUP BY ALL""")
def read_class_rules(spark, d):
    p = _table(spark, d, "part")
    key = F.concat(F.lit("land_use"), F.when(F.col("p_size") % 2 == 0, ".kind").otherwise(""), F.lit(":"), F.lower("p_type"), "p_size")
    rules = p.groupBy(key.alias("key")).agg(F.max(F.col("p_size") % 7).alias("id")).withColumn("b", F.pmod(F.xxhash64("key"), F.lit(4)))
    path = _json(rules, "b", _folder(spark), class_mapping=F.map_from_entries(F.collect_list(F.struct("key", "id"))))
    return sources.read_class_rules(spark, f"{path}/*").withColumn("class_id", F.col("class_id").cast("long"))


@_query("""
    SELECT 'seq' || s || '__' || o_orderstatus AS run, 'seq' || s AS sequence, o_orderstatus AS config, CASE WHEN s % 5 > 0 THEN round(avg(o_totalprice), 4) END AS median_m,
        CASE WHEN s % 5 > 0 THEN max(o_totalprice) > 200000 ELSE false END AS passed FROM (SELECT *, o_custkey // 60 AS s FROM orders) GROUP BY s, o_orderstatus""")
def read_run_summaries(spark, d):
    o = _table(spark, d, "orders").withColumn("s", F.floor(F.col("o_custkey") / 60)).withColumn("run", F.concat(F.lit("seq"), "s", F.lit("__"), "o_orderstatus"))
    path = _json(o.filter("s % 5 > 0"), "run", _folder(spark), median_m=F.round(F.avg("o_totalprice"), 4), passed=F.max("o_totalprice") > 200000)
    found = sources.read_run_summaries(spark, path, "median_m double, passed boolean", "*.txt").select("run", "median_m", "passed")
    out = sources.with_expected_runs(o.select("run").distinct(), found)
    return out.select("run", F.split("run", "__")[0].alias("sequence"), F.split("run", "__")[1].alias("config"), "median_m", "passed")


@_query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE round(value, 6) END AS inliers, CASE WHEN event_id % 4 > 0 THEN event_id % 4 = 1 END AS ok FROM {LOG}")
def coerce_diag(spark, d):
    k = F.col("event_id")
    text = _log(spark, d).select("event_id", F.when(k % 3 == 0, "").when(k % 3 == 1, "-1").otherwise(F.col("value").cast("string")).alias("inliers"), F.when(k % 4 == 0, " ").when(k % 4 == 1, "Yes").otherwise("no").alias("ok"))
    return sources.coerce_diag(text, ["inliers"], ["ok"]).select("event_id", _r("inliers").alias("inliers"), "ok")


@_query(f"""
    SELECT 'rows' AS part, count(*) AS n, round(sum(value), 2) AS total FROM {LOG} UNION ALL SELECT 'csv', count(DISTINCT event_type), round(sum(value), 2) FROM {LOG}
    UNION ALL SELECT 'json', count(DISTINCT event_type), round(sum(value), 2) FROM {LOG} UNION ALL SELECT 'md', count(DISTINCT event_type) + 2, NULL FROM {LOG}""")
def write_report(spark, d):
    log, path = _log(spark, d), _folder(spark)
    summary = log.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    sources.write_report(log.select("event_id", "event_type", "value"), summary, path, ["event_type"])
    count = lambda df, part, c: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), _r(F.sum(F.col(c).cast("double")), 2).alias("total"))
    out = count(spark.read.parquet(f"{path}/rows"), "rows", "value").unionByName(count(spark.read.option("header", True).csv(f"{path}/summary_csv"), "csv", "total"))
    out = out.unionByName(count(spark.read.json(f"{path}/summary_json"), "json", "total"))
    return out.unionByName(spark.read.text(f"{path}/summary_md").agg(F.lit("md").alias("part"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


def _stream(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """A table as a stream of its Parquet files, and a folder for what is made of it."""
    path = _folder(spark)
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in"), path


def _streamed(df: DataFrame, path: str) -> DataFrame:
    """All rows that a stream gives for what is there now."""
    streaming.write_state_stream(df, f"{path}/out", f"{path}/state").awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


@_query(f"SELECT event_id, track, round(value, 6) AS value FROM {LOG} WHERE accepted")
def write_state_stream(spark, d):
    df, path = _stream(spark, _log(spark, d))
    return _streamed(df.filter("accepted").select("event_id", "track", "value"), path).withColumn("value", _r("value"))


@_query(f"""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS n, value > 60 AS f FROM {LOG}),
    s AS (SELECT *, CASE WHEN sum(f::INT) OVER (PARTITION BY track ORDER BY n ROWS 1 PRECEDING) = 2 THEN 1 WHEN sum((NOT f)::INT) OVER (PARTITION BY track ORDER BY n ROWS 2 PRECEDING) = 3 THEN 0 END AS turn FROM l)
    SELECT event_id, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY track ORDER BY n), 0) = 1 AS is_on FROM s""")
def hysteresis_stream(spark, d):
    df, path = _stream(spark, _log(spark, d).select("event_id", "track", "t", (F.col("value") > 60).alias("f")))
    return _streamed(streaming.hysteresis_stream(df, "track", "f", 2, 3, ("event_id",)), path).select("event_id", "is_on")


@_query(f"""
    WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS n,
        t - last_value(CASE WHEN accepted THEN t END IGNORE NULLS) OVER (PARTITION BY track ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {LOG}),
    m AS (SELECT *, CASE WHEN value < 60 AND coalesce(gap, 1e9) < 5 THEN 4.0 WHEN value < 200 AND coalesce(gap, 1e9) < 30 THEN 1.0 ELSE 0.5 END AS period FROM l),
    f AS (SELECT track, event_id, n, period, NOT flag AS runs, CASE WHEN NOT flag THEN t END AS last FROM m WHERE n = 1
        UNION ALL SELECT m.track, m.event_id, m.n, m.period, NOT m.flag AND (f.last IS NULL OR m.t - f.last >= m.period), CASE WHEN NOT m.flag AND (f.last IS NULL OR m.t - f.last >= m.period) THEN m.t ELSE f.last END FROM f JOIN m ON m.track = f.track AND m.n = f.n + 1)
    SELECT event_id, CASE period WHEN 4.0 THEN 'TRACK' WHEN 1.0 THEN 'WEAK' ELSE 'RELOCALIZE' END AS mode, runs FROM f""")
def schedule_stream(spark, d):
    """Mode and schedule of a stream of (t, sigma, accepted, obstructed)."""
    log = _log(spark, d).select("event_id", "track", "t", F.col("value").alias("sigma"), "accepted", F.col("flag").alias("obstructed"))
    df, path = _stream(spark, log)
    return _streamed(streaming.schedule_stream(df, "track", 0, ("event_id",)), path).select("event_id", "mode", "runs")


@_query(f"""
    SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS i FROM {LOG})
        WINDOW w AS (PARTITION BY track ORDER BY t RANGE BETWEEN 20.0 PRECEDING AND CURRENT ROW)""")
def history_stream(spark, d):
    """Each row's trailing count and mean over the last 20 units of time, kept as state; times are distinct within a track here."""
    df, path = _stream(spark, _log(spark, d).select("event_id", "track", "t", "value"))
    return _streamed(streaming.trailing_stream(df, "track", 20.0, ("event_id",)), path).select("event_id", "n", _r("mean").alias("mean"))


@_query(f"""
    SELECT e.event_id, 100.0::DOUBLE * (e.event_id % 7) AS elev, round(e.value - 100 * (e.event_id % 7), 6) AS agl_m FROM {LOG} e WHERE e.event_id % 9 < 7
    UNION ALL SELECT e.event_id, NULL, NULL FROM {LOG} e WHERE e.event_id % 9 >= 7""")
def agl_stream(spark, d):
    k = F.col("event_id")
    log = _log(spark, d).select("event_id", F.lit(89.5).alias("lat"), (k % 63 - 180 + 0.5).cast("double").alias("lon"), F.col("value").alias("alt"))
    df, path = _stream(spark, log)
    col = F.col("id")
    dem = spark.range(63).select(F.lit(0).cast("long").alias("row"), col.alias("col"), (100.0 * (col % 7)).alias("elev")).filter("col % 9 < 7")
    return _streamed(streaming.agl_stream(df, dem, 1.0), path).select("event_id", "elev", _r("agl_m").alias("agl_m"))


@_query("SELECT count(*) AS n, count(*) AS agree FROM events")
def filter_tracks_stream(spark, d):
    """The track filter on a stream whose rows come late and out of order, held against the batch filter: rows, and rows where both agree."""
    from .queries import _measured
    from .operators import state

    rows, late, path = _measured(spark, d), 0.5, _folder(spark)
    came = (F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(1000)) * late / 1000).alias("came")
    cuts = [float("-inf"), *rows.select(came).approxQuantile("came", [0.3, 0.6], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:]):  # three deliveries
        rows.filter((came > low) & (came <= high)).repartition(4).write.mode("append").parquet(f"{path}/in")
    last = rows.agg((F.max("t") + 2 * late + 1).alias("t"), F.min("track").alias("track"))  # moves the watermark past all rows
    rows.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{path}/in")
    df = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    with streaming.typed_state(spark):
        own = _streamed(streaming.filter_tracks_ordered(df, "track", late, ("event_id",)), path).select("event_id", "x_e", "sigma_pos")
    batch = state.filter_tracks(rows, ["track"], ("event_id",)).select("event_id", F.col("x_e").alias("bx"), F.col("sigma_pos").alias("bs"))
    same = (F.abs(F.col("x_e") - F.col("bx")) < 1e-6) & (F.abs(F.col("sigma_pos") - F.col("bs")) < 1e-6)
    return own.join(batch, "event_id").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"))


@_query(f"SELECT raster, count(*) AS n, sum(v) AS total FROM {CELLS} GROUP BY 1")
def to_cells(spark, d):
    """Cells packed into decoded images of 16 x 16, and unpacked again."""
    from .operators import raster

    cells = _cells(spark, d)
    keys = cells.select("raster").distinct()
    whole = keys.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    whole = whole.join(cells.withColumn("v", F.col("v") + 1), ["raster", "r", "c"], "left").fillna(0, ["v"])
    packed = raster.pack(whole, ["raster"], 16)
    images = packed.select(F.col("raster").cast("string").alias("origin"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"), "data")
    back = raster.to_cells(images).filter("v > 0")
    return back.groupBy(F.col("origin").cast("long").alias("raster")).agg(F.count("*").alias("n"), F.sum(F.col("v") - 1).cast("long").alias("total"))
