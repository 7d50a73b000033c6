"""Readers and writers. Files go through Spark's readers only; schemas are declared."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, nChannels, mode, data, missing: undecodable files stay, as missing."""
    df = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return df.withColumn("missing", F.col("height").isNull() | (F.col("height") < 1))


def parse_tile_name(path: Column) -> Column:
    """struct<region,z,x,y> of `region_z_x_y.png`; the region may hold underscores; null for other names."""
    pattern = r"([^/]+)_(\d+)_(\d+)_(\d+)\.png$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    found = F.struct(part(1).alias("region"), *[part(i).cast("int").alias(c) for i, c in ((2, "z"), (3, "x"), (4, "y"))])
    return F.when(F.rlike(path, F.lit(pattern)), found)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths of files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def named_images(files: DataFrame, kind: str) -> DataFrame:
    """Fields of `@`-delimited file names: map (5), query (2) or frame (3 fields); other names are skipped.

    Map corners are put in order and get a centre; stamps stay text.
    """
    parts = files.withColumn("p", F.split(stem(F.col("path")), "@")).filter(F.size("p") == {"map": 5, "query": 2, "frame": 3}[kind])
    num = lambda i: F.col("p")[i].try_cast("double")
    if kind == "map":
        low, high = (lambda i, j: F.least(num(i), num(j))), (lambda i, j: F.greatest(num(i), num(j)))
        out = parts.select("path", F.col("p")[0].alias("name"), low(1, 3).alias("lon_min"), low(2, 4).alias("lat_min"), high(1, 3).alias("lon_max"), high(2, 4).alias("lat_max"))
        return out.withColumn("center_lat", (F.col("lat_min") + F.col("lat_max")) / 2).withColumn("center_lon", (F.col("lon_min") + F.col("lon_max")) / 2)
    if kind == "query":
        return parts.select("path", num(0).alias("lon"), num(1).alias("lat"))
    return parts.select("path", F.col("p")[0].alias("stamp"), num(1).alias("lon"), num(2).alias("lat"))


def scan_named_images(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return named_images(list_files(spark, root), kind)


def scan_distractors(spark: SparkSession, root: str) -> DataFrame:
    """Images without a pose, as distractors."""
    return distractors(list_files(spark, root))


def distractors(files: DataFrame) -> DataFrame:
    none = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "z", "lat", "lon")]
    return files.select(stem(F.col("path")).alias("image_id"), "path", F.lit("distractor").alias("role"), *none)


POSES = "filepath string, x string, y string, z string, roll string, pitch string, yaw string, undulation string, landcover string"


def number(text: Column) -> Column:
    """A double of a text; null for what doesn't parse and for NaN."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v), v)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose table; missing or bad numbers are null."""
    df = spark.read.schema(POSES).option("header", True).option("enforceSchema", False).csv(path)
    return df.select("filepath", *[number(F.col(c)).alias(c) for c in df.columns[1:-1]], "landcover")


def read_manifest(spark: SparkSession, path: str, numbers: list[str], image_id: str = "image_id") -> DataFrame:
    """CSV manifest with lenient numbers; a missing image_id is the stem of its path."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumns({c: number(F.col(c)) for c in numbers if c in df.columns})
    own = F.nullif(F.trim(F.col(image_id)), F.lit("")) if image_id in df.columns else F.lit(None)
    return df.withColumn(image_id, F.coalesce(own, stem(F.col("path"))))


def wkb_parts(wkb: Column) -> Column:
    """array<array<struct<x,y>>> of WKB polygons and lines, one or many; null for other kinds."""

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def parts(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.array([None if b is None else _wkb(b.as_py()) for b in column], kind)

    return parts(wkb)


def _wkb(data: bytes) -> list | None:
    """Rings and lines of a geometry."""

    def read(at: int) -> tuple[list | None, int]:
        order = "<" if data[at] == 1 else ">"
        kind = int(np.frombuffer(data, f"{order}u4", 1, at + 1)[0])
        size = 2 + (kind // 1000 in (1, 3) or bool(kind & 0x80000000)) + (kind // 1000 in (2, 3) or bool(kind & 0x40000000))
        at, kind = at + 5, kind % 1000 & 0xFF
        count = lambda at: int(np.frombuffer(data, f"{order}u4", 1, at)[0])

        def line(at: int) -> tuple[list, int]:
            n = count(at)
            xy = np.frombuffer(data, f"{order}f8", n * size, at + 4).reshape(n, size)
            return [{"x": float(p[0]), "y": float(p[1])} for p in xy], at + 4 + 8 * n * size

        if kind == 2:
            own, at = line(at)
            return [own], at
        if kind == 3:
            n, at, out = count(at), at + 4, []
            for _ in range(n):
                own, at = line(at)
                out.append(own)
            return out, at
        if kind in (5, 6):
            n, at, out = count(at), at + 4, []
            for _ in range(n):
                own, at = read(at)
                out += own or []
            return out, at
        return None, at

    return read(0)[0]


def wkb_kind(wkb: Column) -> Column:
    """Name of a WKB geometry's type, whatever its byte order and dimensions; null for types beyond collections of polygons."""
    byte = lambda i: F.conv(F.hex(F.substring(wkb, i, 1)), 16, 10).cast("int")
    code = F.when(byte(1) == 1, byte(2) + 256 * byte(3)).otherwise(byte(5) + 256 * byte(4)) % 1000
    names = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
    return F.get(F.array(*map(F.lit, names)), code - 1)


def lonlat(parts: Column, epsg: Column) -> Column:
    """Points of parts in degrees: EPSG 4326 and 4979 as they are, web mercator (3857, 900913) turned back; others are an error."""
    r = 6_378_137.0
    back = lambda p: F.struct(F.degrees(p["x"] / r).alias("x"), F.degrees(2 * F.atan(F.exp(p["y"] / r)) - F.lit(3.141592653589793 / 2)).alias("y"))
    known = F.when(epsg.isin(4326, 4979), parts).when(epsg.isin(3857, 900913), F.transform(parts, lambda ring: F.transform(ring, back)))
    return F.when(epsg.isin(4326, 4979, 3857, 900913), known).otherwise(F.raise_error(F.concat(F.lit("unknown CRS: EPSG "), epsg.cast("string"))))


def footer_epsg(spark: SparkSession, path: str, column: str = "geometry") -> int:
    """EPSG code of a column of GeoParquet, by the `geo` entry of the footer of the path's first file in name order.

    4326 where there is no entry or no CRS, or it is CRS84 (degrees); a CRS without an EPSG code is an
    error. The files of one layer share a CRS; only one footer is read, from any file system of Spark.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    while system.getFileStatus(place).isDirectory():
        inside = [f.getPath() for f in system.listStatus(place) if not f.getPath().getName().startswith(("_", "."))]
        if not inside:
            return 4326
        place = min(inside, key=lambda p: p.getName())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf))
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    crs = json.loads(text or "{}").get("columns", {}).get(column, {}).get("crs")
    if crs is None:
        return 4326
    known = crs.get("id") or {}
    if known.get("authority") == "EPSG":
        return int(known["code"])
    if (known.get("authority"), known.get("code")) == ("OGC", "CRS84"):
        return 4326
    raise ValueError(f"CRS without an EPSG code: {crs.get('name')}")


def read_layer(spark: SparkSession, path: str, layer: str, epsg: int | None = None) -> DataFrame:
    """GeoParquet with a WKB column `geometry` in a CRS, by its footer if not given -> layer, attrs map, kind, parts in degrees.

    Null geometry is skipped; points have no parts.
    """
    epsg = footer_epsg(spark, path) if epsg is None else epsg
    df = spark.read.parquet(path).filter("geometry IS NOT NULL")
    attrs = [c for c in df.columns if c != "geometry"]
    table = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in attrs])) if attrs else F.create_map().cast("map<string,string>")
    out = df.select(F.lit(layer).alias("layer"), F.map_filter(table, lambda k, v: v.isNotNull()).alias("attrs"), wkb_kind(F.col("geometry")).alias("kind"), wkb_parts(F.col("geometry")).alias("parts"))
    return out.withColumn("parts", lonlat(F.col("parts"), F.lit(epsg)))


def resolve_layer(spark: SparkSession, folder: str, layer: str, epsg: int | None = None) -> DataFrame | None:
    """A layer of a region's folder from the first of `.parquet`, `.geojson`, `.json`; None if there is none.

    -> layer, attrs, kind, parts in degrees; rows without geometry are skipped. GeoParquet is in the CRS
    `epsg`, else in the one its footer names; GeoJSON names its own, else it is in degrees.
    """
    for ending in ("parquet", "geojson", "json"):
        path = f"{folder}/{layer}.{ending}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return read_layer(spark, path, layer, epsg) if ending == "parquet" else read_geojson(spark, path, layer)
    return None


def read_geojson(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Features of GeoJSON collections with polygon or line geometry -> layer, attrs, kind, parts in degrees."""
    schema = "crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    epsg = F.coalesce(F.nullif(F.regexp_extract("crs.properties.name", r"(?i)EPSG:+(\d+)$", 1), F.lit("")).cast("int"), F.lit(4326))
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(epsg.alias("epsg"), F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    d2, d3, d4 = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(kind == "LineString", F.array(ring(F.from_json(text, d2)))).when(
        kind.isin("Polygon", "MultiLineString"), F.transform(F.from_json(text, d3), ring)
    ).when(kind == "MultiPolygon", F.transform(F.flatten(F.from_json(text, d4)), ring))
    out = f.select(F.lit(layer).alias("layer"), F.col("f.properties").alias("attrs"), kind.alias("kind"), parts.alias("parts"), "epsg").filter("parts IS NOT NULL")
    return out.withColumn("parts", lonlat(F.col("parts"), F.col("epsg"))).drop("epsg")


_POINTS = "array<struct<lat:double,lon:double>>"
OSM = f"elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:{_POINTS},members:array<struct<role:string,geometry:{_POINTS}>>>>"


def osm_class(tags: Column, theme: str) -> Column:
    """Class of a water or building element by its tags; null for elements that are no buildings."""
    if theme == "buildings":
        return F.when(tags["building"].isNotNull(), F.lit("building"))
    water = F.when(tags["natural"] == "water", F.lower(F.coalesce(F.nullif(tags["water"], F.lit("")), F.lit("lake"))))
    river = F.when(F.coalesce(tags["waterway"], F.lit("")) != "", "river")
    return F.coalesce(water, river, F.when(tags["landuse"].isin("reservoir", "basin"), "reservoir"), F.lit("lake"))


def read_osm_dump(spark: SparkSession, path: str, theme: str) -> DataFrame:
    """Ways and relations of a dump: feature_id, kind, tags, parts, of a theme (water or buildings).

    Closed ways of four points or more are polygons, others of two or more are lines, which buildings
    don't have; relations are polygons of their outer or unmarked members of three points or more.
    """
    e = spark.read.schema(OSM).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    xy = lambda g: F.transform(g, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    n = F.size("geometry")
    closed = (n >= 4) & (F.col("geometry")[0] == F.element_at("geometry", -1))
    way = F.when(closed, "Polygon").when(n >= 2, "LineString")
    outer = F.filter("members", lambda m: (F.coalesce(m["role"], F.lit("")).isin("outer", "")) & (F.size(m["geometry"]) >= 3))
    kind = F.when(F.col("type") == "way", way).when((F.col("type") == "relation") & (F.size(outer) > 0), "MultiPolygon")
    parts = F.when(F.col("type") == "way", F.array(xy(F.col("geometry")))).otherwise(F.transform(outer, lambda m: xy(m["geometry"])))
    out = e.select(F.col("id").alias("feature_id"), kind.alias("kind"), "tags", osm_class(F.col("tags"), theme).alias("class"), parts.alias("parts"))
    out = out.filter("kind IS NOT NULL AND class IS NOT NULL")
    if theme == "buildings":
        out = out.filter("kind <> 'LineString'")
    return out.withColumn("layer", F.lit(f"osm_{theme}"))


LANDMARKS = (
    "schema_version int, video string, segments array<struct<id:string,name:string,start_s:double,end_s:double,kind:string>>,"
    " track_thresholds struct<max_sigma_pos_m:double>, expected_dead_reckoning_segments array<string>,"
    " landmarks array<struct<id:string,t_sec:double,lat:double,lon:double,sigma_m:double,source:string,note:string>>"
)


def read_landmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (with dead_reckoning) and landmarks of a truth file."""
    df = spark.read.schema(LANDMARKS).option("multiLine", True).json(path)
    expected = F.coalesce("expected_dead_reckoning_segments", F.array().cast("array<string>"))
    seg = df.select("video", expected.alias("_dr"), F.col("track_thresholds.max_sigma_pos_m").alias("max_sigma_m"), F.inline("segments"))
    seg = seg.withColumn("dead_reckoning", F.array_contains("_dr", F.col("id"))).drop("_dr").withColumnsRenamed({"id": "segment_id", "start_s": "start", "end_s": "end"})
    return seg, df.select("video", F.inline("landmarks")).withColumnRenamed("t_sec", "t")


def read_state_log(spark: SparkSession, path: str, required: tuple[str, ...] = ("t_sec", "lat", "lon", "sigma_pos_m", "map_accepted", "obstructed")) -> DataFrame:
    """State log from CSV with its required columns; numbers that don't parse are null, flags are booleans."""
    df = spark.read.option("header", True).csv(path)
    if absent := [c for c in required if c not in df.columns]:
        raise ValueError(f"state log without columns {absent}")
    out = df.withColumns({c: number(F.col(c)) for c in required})
    return out.withColumns({c: F.col(c) > 0 for c in ("map_accepted", "obstructed")})


def read_gallery(spark: SparkSession, path: str, model: str, metadata: str | None = None) -> DataFrame:
    """Descriptors (vec_id, tile_id, lat, lon, embedding, model_name); another model's rows are an error.

    With `metadata`, a second table by vec_id holds the places: other ids, or other counts of rows, are an
    error too, since both tables describe the same rows.
    """
    df = spark.read.parquet(path)
    ok = F.assert_true(F.col("model_name") == model, F.concat(F.lit("descriptors of another model: "), F.coalesce("model_name", F.lit("null"))))
    df = df.filter(ok.isNull())
    if metadata is None:
        return df
    places = spark.read.parquet(metadata)
    both = df.withColumn("_l", F.lit(True)).join(places.withColumn("_r", F.lit(True)), "vec_id", "full_outer")
    paired = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("descriptors and metadata hold different rows"))
    once = F.assert_true(F.count("*").over(Window.partitionBy("vec_id")) == 1, F.lit("a descriptor has several rows"))
    return both.withColumn("_once", once).filter(paired.isNull() & F.col("_once").isNull()).drop("_l", "_r", "_once")


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """Elevation tiles `N55E038.hgt` -> dem_id, row, col, elev, with west, north and cell_deg; voids are null.

    Side 1201 or 3601 from the length; big-endian; the grid's outer centres lie on the degree lines.
    """
    return hgt_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content"))


def hgt_cells(files: DataFrame) -> DataFrame:
    """read_hgt() of files (path, content) that are there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                dem = name.rsplit("/", 1)[-1][:7].upper()
                side = {2 * 1201**2: 1201, 2 * 3601**2: 3601}.get(len(data))
                if side is None or dem[0] not in "NS" or dem[3] not in "EW":
                    continue
                lat, lon = int(dem[1:3]) * (1 if dem[0] == "N" else -1), int(dem[4:7]) * (1 if dem[3] == "E" else -1)
                cell = 1.0 / (side - 1)
                v = np.frombuffer(data, ">i2").reshape(side, side)
                for top in range(0, side, 64):
                    part = v[top : top + 64].astype(np.float32)
                    r, c = np.divmod(np.arange(part.size), side)
                    elev = part.ravel()
                    same = lambda x, n=part.size: pa.array(np.full(n, x))
                    yield pa.RecordBatch.from_pydict({
                        "dem_id": pa.array([dem] * part.size), "row": pa.array((r + top).astype(np.int32)), "col": pa.array(c.astype(np.int32)),
                        "elev": pa.array(elev, mask=elev == -32768), "west": same(lon - cell / 2), "north": same(lat + 1 + cell / 2), "cell_deg": same(cell),
                    })

    return files.mapInArrow(run, "dem_id string, row int, col int, elev float, west double, north double, cell_deg double")


ANCHORS = (
    "video string, anchors array<struct<anchor_index:int,frame_index:int,timestamp_seconds:double,mask:string,"
    "detections:array<struct<prompt:string,num_accepted:int,instances:array<struct<index:int,score:double,box:array<double>,cx_frac:double,accepted:boolean,reason:string>>>>>>"
)


def read_anchor_index(spark: SparkSession, path: str, video: str, any_video: bool = False) -> DataFrame:
    """Anchor instances of an index; an index of another video, or of none, is an error unless any_video."""
    df = spark.read.schema(ANCHORS).option("multiLine", True).json(path)
    if not any_video:
        df = df.filter(F.assert_true(F.coalesce(F.col("video") == video, F.lit(False)), F.lit("anchor index of another video")).isNull())
    rows = df.select("video", F.inline("anchors"))
    rows = rows.select("video", "anchor_index", "frame_index", "timestamp_seconds", F.explode_outer("detections").alias("d"))
    return rows.select("video", "anchor_index", "frame_index", "timestamp_seconds", F.col("d.prompt").alias("prompt"), F.explode_outer("d.instances").alias("i")).select("*", "i.*").drop("i")


def read_class_rules(spark: SparkSession, path: str, field: str = "class_mapping") -> DataFrame:
    """Rules (layer, attr, value, class_id) of a JSON config whose field maps `layer:value` or `layer.attr:value` to ids."""
    text = F.get_json_object(F.col("value"), f"$.{field}")
    rules = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,int>")).alias("key", "class_id"))
    part = lambda i: F.regexp_extract("key", r"^([^.:]+)(?:\.([^:]+))?:(.*)$", i)
    return rules.select(part(1).alias("layer"), F.nullif(part(2), F.lit("")).alias("attr"), part(3).alias("value"), "class_id")


def read_run_summaries(spark: SparkSession, path: str, schema: str, pattern: str = "summary.json") -> DataFrame:
    """summary.json files (or others of a pattern) of run folders `sequence__config`: their fields, run, sequence and config."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    run = F.regexp_extract("_metadata.file_path", r"(?:[^/=]+=)?([^/=]+)/[^/]+$", 1)
    return df.withColumn("run", run).withColumn("sequence", F.split("run", "__")[0]).withColumn("config", F.try_element_at(F.split("run", "__"), F.lit(2)))


def with_expected_runs(expected: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every expected run; those without a summary have passed = false."""
    return expected.join(summaries, "run", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def coerce_diag(df: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Text columns of a diagnostic log as numbers (empty is null, -1 stays) and booleans."""
    true = lambda c: F.lower(F.trim(F.col(c))).isin("true", "1", "yes")
    return df.withColumns({c: number(F.col(c)) for c in numbers} | {c: F.when(F.trim(F.col(c)) != "", true(c)) for c in flags})


def write_report(rows: DataFrame, summary: DataFrame, path: str, partition: list[str] = ()) -> None:
    """Rows as partitioned Parquet; the summary as CSV, JSON and a Markdown table, each in a folder below path."""
    rows.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/rows")
    summary = summary.persist()
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary_csv")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary_json")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns])
    head = [f"| {' | '.join(summary.columns)} |", f"|{'---|' * len(summary.columns)}"]
    lines = summary.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, value string").unionByName(summary.select(F.lit(2).alias("i"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")))
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/summary_md")
    summary.unpersist()
