"""Tile, interval, as-of, radius and raster joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


#: Rows up to which a table of ranges or boxes is sent to every task; beyond that it is cut into cells.
FEW = 50_000


#: Rows of a task that makes several rows of each.
MANY = 1_000_000


def is_few(df: DataFrame, most: int = FEW) -> bool:
    """Whether a table has at most `most` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def pair_tiles(images: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Full outer pairs with flags for a missing side."""
    left, right = images.withColumn("_l", F.lit(True)), masks.withColumn("_r", F.lit(True))
    both = left.join(right, on, "full_outer")
    return both.withColumn("missing_image", F.col("_l").isNull()).withColumn("missing_mask", F.col("_r").isNull()).drop("_l", "_r")


def tile_quads(tiles: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Anchors (x, y) whose tiles (x, y) to (x + 1, y + 1) all exist: two shuffles instead of three self-joins.

    Tiles are dealt in tasks of about MANY rows before anything is made of them, however few files they come from.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    own = tiles.select(*keys, "x", "y")
    own = own.repartition(max(1, -(-own.count() // MANY)), *keys, "x", "y").distinct()
    out = own.withColumn("c", corner)
    out = out.select(*keys, (F.col("x") - F.col("c.dx")).alias("x"), (F.col("y") - F.col("c.dy")).alias("y"))
    return out.groupBy(*keys, "x", "y").count().filter("count = 4").drop("count")


def tiles_in_bbox(regions: DataFrame, z: int) -> DataFrame:
    """(region, w, s, e, n) -> the same and every tile x, y of zoom z that the box meets."""
    a, b = geo.deg2tile("n", "w", z), geo.deg2tile("s", "e", z)
    xs = regions.withColumn("_a", a).withColumn("_b", b).withColumn("x", F.explode(F.sequence("_a.x", "_b.x")))
    return xs.withColumn("y", F.explode(F.sequence("_a.y", "_b.y"))).drop("_a", "_b").withColumn("z", F.lit(z))


def tile_window(df: DataFrame, r: int) -> DataFrame:
    """Each tile's neighbours within Chebyshev radius r, as wx, wy."""
    steps = F.sequence(F.lit(-r), F.lit(r))
    out = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return out.withColumn("wx", F.col("x") + F.col("_dx")).withColumn("wy", F.col("y") + F.col("_dy")).drop("_dx", "_dy")


def features_to_tiles(features: DataFrame, z: int) -> DataFrame:
    """Candidate tiles of features with a bbox (w, s, e, n); the exact test comes later."""
    return tiles_in_bbox(features, z)


def ring_edges(parts: Column) -> Column:
    """All edges (a, b) of the rings of a shape, the closing ones too."""
    after = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.flatten(F.transform(parts, lambda r: F.zip_with(r, after(r), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def crosses(e: Column, y: Column) -> Column:
    """Whether an edge goes from one side of the row y to the other."""
    return (e["a"]["y"] > y) != (e["b"]["y"] > y)


def crossing(e: Column, y: Column) -> Column:
    """Where an edge meets the row y."""
    return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]


def with_bands(polygons: DataFrame, box: dict[str, Column]) -> DataFrame:
    """Polygons (parts) -> the same without parts and with _low, _high, _bands, _edges, _first for in_bands().

    A shape's height is cut into as many bands as make an edge lie in about two; _edges has the edges of the
    first band, then those of the second and so on, _first where each begins. Built within a row, in the
    time of one sort of its edges.
    """
    out = polygons.withColumn("_e", ring_edges(F.col("parts"))).drop("parts").withColumns({"_low": box["s"], "_high": box["n"]})
    rise = F.aggregate("_e", F.lit(0.0), lambda n, e: n + F.abs(e["b"]["y"] - e["a"]["y"]))
    most = F.size("_e").cast("double")
    count = F.greatest(F.lit(1.0), F.least(most, most * (F.col("_high") - F.col("_low")) / F.nullif(rise, F.lit(0.0))))
    out = out.withColumn("_bands", F.coalesce(F.floor(count), F.lit(1)).cast("int"))
    ends = lambda e: (F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    own = F.flatten(F.transform("_e", lambda e: F.transform(F.sequence(*map(_band, ends(e))), lambda b: F.struct(b.alias("band"), F.lit(1).alias("real"), e.alias("e")))))
    none = F.transform(F.sequence(F.lit(0), F.col("_bands") - 1), lambda b: F.struct(b.alias("band"), F.lit(0).alias("real"), F.get("_e", F.lit(0)).alias("e")))
    out = out.withColumn("_edges", F.array_sort(F.concat(own, none))).drop("_e")  # a band begins with its number alone
    first = F.transform("_edges", lambda x, i: F.when(x["real"] == 0, i))
    return out.withColumn("_first", F.filter(first, lambda i: i.isNotNull()))


def _band(y: Column) -> Column:
    share = F.floor((y - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * F.col("_bands"))
    return F.greatest(F.lit(0), F.least(F.col("_bands") - 1, F.coalesce(share, F.lit(0)).cast("int")))


def in_bands(x: Column, y: Column) -> Column:
    """Even-odd test over all rings of a shape of with_bands(), so holes are outside; only the edges of the point's band are read.

    Of the points on a shape's own edges those on eastern and southern ones are inside."""
    first = F.get("_first", _band(y))
    last = F.coalesce(F.get("_first", _band(y) + 1), F.size("_edges"))
    near = F.slice("_edges", first + 2, last - first - 1)
    return F.aggregate(near, F.lit(0), lambda n, s: n + F.when(crosses(s["e"], y) & (x <= crossing(s["e"], y)), 1).otherwise(0)) % 2 == 1


def in_cells(points: DataFrame, shapes: DataFrame, on: list[str], axes: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Points with the shapes of their key that may hold them; axes: a point's place, a shape's lowest and highest.

    Each shape falls in squares of a power of two, of the level of its own size: four of them or so. Large
    shapes among small ones take finer squares, so that none of theirs holds all points. A point looks into one
    square of each level that shapes have, as many as there are powers of two between their sizes, at most 40.
    """
    names = [f"_a{i}" for i in range(len(axes))]
    sized = shapes.withColumns({f"{a}{k}": v for a, (_, low, high) in zip(names, axes) for k, v in (("l", low), ("h", high))})
    extent = F.greatest(*[F.col(f"{a}h") - F.col(f"{a}l") for a in names]) if len(axes) > 1 else F.col(f"{names[0]}h") - F.col(f"{names[0]}l")
    sized = sized.withColumn("_l", F.when(extent > 0, F.ceil(F.log2(extent)).cast("int")))
    low, high = sized.agg(F.min("_l"), F.max("_l")).first()
    low = 0 if low is None else max(low, high - 40)
    level = F.greatest(F.coalesce("_l", F.lit(low)), F.lit(low))
    sized = sized.withColumn("_l", level - F.least(F.lit(4), F.floor((level - low) / 2).cast("int")))
    levels = [r[0] for r in sized.select("_l").distinct().collect()]
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_l")))
    for a in names:
        sized = sized.withColumn(a, F.explode(F.sequence(at(F.col(f"{a}l")), at(F.col(f"{a}h"))))).drop(f"{a}l", f"{a}h")
    looks = points.withColumns({f"{a}p": p for a, (p, _, _) in zip(names, axes)})
    looks = looks.withColumn("_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    looks = looks.withColumns({a: at(F.col(f"{a}p")) for a in names}).drop(*[f"{a}p" for a in names])
    return looks.join(sized, [*on, "_l", *names]).drop("_l", *names)


def _in_squares(cells: DataFrame, shapes: DataFrame, on: list[str], box: dict[str, Column]) -> DataFrame:
    """Cells (x, y) with the shapes of their key whose box (w, s, e, n) holds them."""
    sized = shapes.withColumns({f"_{c}": v for c, v in box.items()})
    both = in_cells(cells, sized, on, [(F.col("x"), F.col("_w"), F.col("_e")), (F.col("y"), F.col("_s"), F.col("_n"))])
    return both.filter(F.col("x").between(F.col("_w"), F.col("_e")) & F.col("y").between(F.col("_s"), F.col("_n"))).drop("_w", "_s", "_e", "_n")


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, on: list[str]) -> DataFrame:
    """Cells (keys, x, y at the centre) inside polygons (keys, parts array<array<struct<x,y>>>) of the same key.

    A cell reads the edges of its band only, see with_bands(): time grows with edges plus cells.
    """
    of = lambda pick, c: pick(F.transform(F.flatten("parts"), lambda p: p[c]))
    box = {"w": of(F.array_min, "x"), "s": of(F.array_min, "y"), "e": of(F.array_max, "x"), "n": of(F.array_max, "y")}
    sized = with_bands(polygons.withColumns({f"_b{c}": v for c, v in box.items()}), {c: F.col(f"_b{c}") for c in box})
    found = _in_squares(cells, sized, on, {c: F.col(f"_b{c}") for c in box}).filter(in_bands(F.col("x"), F.col("y")))
    return found.drop("_low", "_high", "_bands", "_edges", "_first", *[f"_b{c}" for c in box])


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / F.nullif(size, F.lit(0.0)))))
    return F.hypot(x - x0 - t * dx, y - y0 - t * dy)


def cells_near_lines(cells: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """Cells (keys, r, c, x, y in metres) within width_m of lines (keys, width_m, parts) of the same key, once each.

    Segments that several lines share are looked up once.
    """
    ends = lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    segments = lines.withColumn("s", F.explode(F.flatten(F.transform("parts", ends)))).drop("parts").distinct()
    near = segment_distance(F.col("x"), F.col("y"), F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")) <= F.col("width_m")
    ends = lambda pick, c: pick(F.col(f"s.a.{c}"), F.col(f"s.b.{c}"))
    wide = F.col("width_m")
    box = {"w": ends(F.least, "x") - wide, "s": ends(F.least, "y") - wide, "e": ends(F.greatest, "x") + wide, "n": ends(F.greatest, "y") + wide}
    return _in_squares(cells, segments, on, box).filter(near).drop("s", "width_m").dropDuplicates([*on, "r", "c"])


def assign_segments(log: DataFrame, segments: DataFrame, t: str = "t", eps: float = 1e-9, most: int = FEW) -> DataFrame:
    """Rows in [start, end) of a segment; the last one holds its end too.

    Up to `most` segments are broadcast. More fall in cells of their own lengths, see in_cells(), which rows
    meet by an equi-join.
    """
    last = segments.agg(F.max("end")).first()[0]
    inside = (F.col(t) >= F.col("start")) & ((F.col(t) < F.col("end")) | ((F.col("end") == F.lit(last)) & (F.abs(F.col(t) - F.col("end")) < eps)))
    if is_few(segments, most):
        return log.join(F.broadcast(segments), inside)
    return in_cells(log, segments, [], [(F.col(t), F.col("start"), F.col("end") + eps)]).filter(inside)


def interp_asof(log: DataFrame, truth: DataFrame, columns: list[str], keys: list[str], t: str = "t") -> DataFrame:
    """Truth columns interpolated to the rows of a log; null outside the truth's range.

    Both tables are tagged and merged; one window carries the knot before, one the knot after.
    """
    knots = truth.select(*keys, F.col(t), F.lit(0).alias("_tag"), F.struct(F.col(t).alias("t"), *columns).alias("_knot"))
    rows = log.withColumn("_tag", F.lit(1)).withColumn("_row", F.struct(*[F.col(c) for c in log.columns]))
    both = rows.select(*keys, t, "_tag", "_row").unionByName(knots, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(t, "_tag")
    after = Window.partitionBy(*keys).orderBy(t, "_tag").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_a", F.last("_knot", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_b", F.first("_knot", True).over(after)).filter("_tag = 1")
    a, b = F.col("_a"), F.col("_b")
    share = (F.col(t) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))
    at = lambda c: F.when(a["t"] == F.col(t), a[c]).otherwise(a[c] + (b[c] - a[c]) * share)
    return both.select("_row.*", *[at(c).alias(f"true_{c}") for c in columns])


def nearest_asof(df: DataFrame, anchors: DataFrame, keys: list[str], k: str = "k", weight: float | None = None) -> DataFrame:
    """The anchor with the nearest integer key, as `anchor`; of two equally near the smaller one.

    With a `weight`, over 1, the anchor of the least distance * weight + key instead: of two that are nearly as near
    a much smaller one wins. Of equal sums the smaller anchor is taken.
    """
    tagged = anchors.select(*keys, k, F.lit(0).alias("_tag"), F.col(k).alias("_k"))
    rows = df.withColumn("_row", F.struct(*[F.col(c) for c in df.columns])).select(*keys, k, F.lit(1).alias("_tag"), "_row")
    both = rows.unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(k, "_tag")
    both = both.withColumn("_p", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_n", F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_tag = 1")
    before, after = F.col(k) - F.col("_p"), F.col("_n") - F.col(k)
    if weight is not None:
        before, after = before * weight + F.col("_p"), after * weight + F.col("_n")
    take = F.when(F.col("_n").isNull() | (before <= after), F.col("_p")).otherwise(F.col("_n"))
    return both.select("_row.*", take.alias("anchor"))


def first_after(segments: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each segment the delay from its end to the first accepted row (t) of the next segment; null if none."""
    nxt = F.lead("segment_id").over(Window.partitionBy(*keys).orderBy("start"))
    seg = segments.withColumn("next_id", nxt)
    first = rows.filter("accepted").groupBy(*keys, F.col("segment_id").alias("next_id")).agg(F.min("t").alias("_t"))
    return seg.join(first, [*keys, "next_id"], "left").withColumn("recovery_s", F.col("_t") - F.col("end")).drop("next_id", "_t")


def radius_neighbors(points: DataFrame, r_m: float, key: str, frame: str) -> DataFrame:
    """Points (key, frame, x, y in metres) -> the same and n_frames: distinct frames within r_m, its own included.

    Distinct places fall in cells of size r_m; each looks into nine of them by an equi-join, and the frames of a place
    are counted once for all points there.
    """
    cell = points.select("x", "y").distinct().withColumn("cx", F.floor(F.col("x") / r_m)).withColumn("cy", F.floor(F.col("y") / r_m))
    near = cell.withColumn("_dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select("x", "y", (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy"))
    other = cell.select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"))
    inside = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= r_m
    met = near.join(other, ["cx", "cy"]).filter(inside).select("x", "y", "ox", "oy")
    frames = points.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col(frame).alias("of")).distinct()
    found = met.join(frames, ["ox", "oy"]).groupBy("x", "y").agg(F.count_distinct("of").alias("n_frames"))
    return points.select(key, frame, "x", "y").distinct().join(found, ["x", "y"]).select(key, frame, "x", "y", "n_frames")


def best_covering(maps: DataFrame, frames: DataFrame, keys: list[str], most: int = FEW) -> DataFrame:
    """The map (map_id, ord, w, s, e, n) that covers most frames (keys, lat, lon); of equal ones the first listed.

    Up to `most` maps are broadcast; more fall in squares of their own sizes, see in_cells(), which frames meet by an equi-join.
    """
    inside = geo.bbox_contains("w", "s", "e", "n", "lat", "lon")
    if is_few(maps, most):
        hit = frames.join(F.broadcast(maps), inside)
    else:
        hit = in_cells(frames, maps, [], [(F.col("lon"), F.col("w"), F.col("e")), (F.col("lat"), F.col("s"), F.col("n"))]).filter(inside)
    counts = hit.groupBy(*keys, "map_id", "ord").agg(F.count("*").alias("covered"))
    best = F.max_by(F.struct("map_id", "covered"), F.struct("covered", -F.col("ord")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def attach_tiebreak(scored: DataFrame, extra: DataFrame, on: list[str]) -> DataFrame:
    """Side metrics (residual, gate, valid) with the defaults 999, 0 and 0 where absent."""
    return scored.join(extra, on, "left").fillna({"residual": 999.0, "gate": 0.0, "valid": 0.0})


def consistency_gate(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Two channels' fixes (channel, x, y, sigma) of a frame are both dropped if farther apart than 3 joint sigmas."""
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.struct("x", "y", "sigma")))
    both = fixes.groupBy(*keys).agg(pick("appearance").alias("a"), pick("structural").alias("b"))
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    bad = both.withColumn("gap_m", gap).filter(F.col("gap_m") > 3 * F.hypot(F.col("a.sigma"), F.col("b.sigma"))).select(*keys, "gap_m")
    out = fixes.join(bad, keys, "left")
    return out.withColumn("agreed", F.col("gap_m").isNull()).withColumn("reject_code", F.when(F.col("gap_m").isNotNull(), "consistency_reject"))


def sample_raster(points: DataFrame, cells: DataFrame, raster: str, height: int, width: int) -> DataFrame:
    """The class under points (px, py), clipped to the raster; 0 where the cell is empty."""
    inside = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round(v).cast("int")))
    at = points.withColumn("r", inside(F.col("py"), height)).withColumn("c", inside(F.col("px"), width))
    return at.join(cells.select(raster, "r", "c", "v"), [raster, "r", "c"], "left").fillna(0, ["v"])


def filter_by_class(matches: DataFrame, compat: DataFrame, keys: list[str], wildcard: int = -1) -> tuple[DataFrame, DataFrame]:
    """Matches (keys, c0, c1) of compatible classes (a, b), and counts raw, kept, background, cross for each key."""
    pairs = compat.select(F.col("a").alias("c0"), F.col("b").alias("c1")).distinct()
    exact = pairs.filter(F.col("c1") != wildcard).withColumn("_exact", F.lit(True))
    any_ = pairs.filter(F.col("c1") == wildcard).select("c0", F.lit(True).alias("_any"))
    kept = matches.join(exact, ["c0", "c1"], "left").join(any_, "c0", "left").filter("_exact OR _any").select(*matches.columns)
    back = (F.col("c0") == 0) | (F.col("c1") == 0)
    raw = matches.groupBy(*keys).agg(F.count("*").alias("raw"), F.count_if(back).alias("background"), F.count_if(~back & (F.col("c0") != F.col("c1"))).alias("cross"))
    counts = raw.join(kept.groupBy(*keys).agg(F.count("*").alias("kept")), keys, "left").fillna(0, ["kept"])
    return kept, counts


def dem_elevation(points: DataFrame, dem: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Bilinear elevation of points (key, dem_id, lat, lon): corners without data leave their weight to the others.

    Null outside the grid or if no corner has data. meta: dem_id, west, north, cell_deg, width, height;
    dem: dem_id, row, col, elev.
    """
    p = points.join(meta, "dem_id")
    p = p.withColumn("fc", (F.col("lon") - F.col("west")) / F.col("cell_deg") - 0.5).withColumn("fr", (F.col("north") - F.col("lat")) / F.col("cell_deg") - 0.5)
    p = p.filter((F.col("fc") >= 0) & (F.col("fr") >= 0) & (F.col("fc") <= F.col("width") - 1) & (F.col("fr") <= F.col("height") - 1))
    c0, r0 = F.least(F.floor("fc"), F.col("width") - 2), F.least(F.floor("fr"), F.col("height") - 2)
    dc, dr = F.col("fc") - c0, F.col("fr") - r0
    corner = lambda i, j: F.struct((r0 + i).cast("int").alias("row"), (c0 + j).cast("int").alias("col"), ((dr if i else 1 - dr) * (dc if j else 1 - dc)).alias("w"))
    corners = p.select(key, "dem_id", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    held = corners.join(dem.filter("elev IS NOT NULL"), ["dem_id", "row", "col"])
    found = held.groupBy(key).agg((F.sum(F.col("w") * F.col("elev")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("elevation"))
    return points.join(found, key, "left")


def agl(points: DataFrame, dem: DataFrame, meta: DataFrame, key: str, alt: str = "alt") -> DataFrame:
    """dem_elevation() and agl_m, the altitude less the elevation."""
    return dem_elevation(points, dem, meta, key).withColumn("agl_m", F.col(alt) - F.col("elevation"))


def param_grid(spark, **axes: list) -> DataFrame:
    """Every combination of small lists of parameters."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def reached_blocks(cells: DataFrame, most: int, size: int) -> DataFrame:
    """Cells (r, c) once for each block (br, bc) of `size` cells a side that an offset of up to `most` leads to."""
    blocks = lambda x: F.explode(F.sequence(F.floor((F.col(x) - most) / size), F.floor((F.col(x) + most) / size)))
    return cells.withColumn("br", blocks("r")).withColumn("bc", blocks("c"))


def offset_votes(template: DataFrame, scene: DataFrame, most: int, key: str = "pair_id", side: int = 16) -> DataFrame:
    """Votes (key, dr, dc) -> weight of template cells (key, cls, r, c, w) that meet scene cells of their class.

    Only offsets of up to `most` cells count: cells are put into blocks of that size or `side` and looked up in
    those that they reach, nine at most and few where blocks are large, so no class is paired with all of a scene.
    """
    size = max(most, side)
    block = lambda df: df.withColumn("br", F.floor(F.col("r") / size)).withColumn("bc", F.floor(F.col("c") / size))
    t = reached_blocks(template, most, size).select(key, "cls", "br", "bc", F.col("r").alias("tr"), F.col("c").alias("tc"), "w")
    pairs = t.join(block(scene).select(key, "cls", "br", "bc", "r", "c"), [key, "cls", "br", "bc"])
    pairs = pairs.withColumn("dr", F.col("r") - F.col("tr")).withColumn("dc", F.col("c") - F.col("tc"))
    return pairs.filter((F.abs("dr") <= most) & (F.abs("dc") <= most)).groupBy(key, "dr", "dc").agg(F.sum("w").alias("votes"))
