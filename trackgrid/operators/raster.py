"""Operators on raster cells (keys, r, c, v). Neighbourhoods never cross a raster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, geo
from . import joins

#: Cells of the dense arrays that a task holds at once.
MOST = 1 << 20


def to_cells(images: DataFrame, key: str = "origin", channel: int = 0) -> DataFrame:
    """Rows of the image source -> key, r, c, v of one channel; undecodable images have none. One image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("_key", "height", "width", "nChannels", "data")]
            for name, h, w, n, data in zip(*columns):
                if h is None or h < 1 or not data:
                    continue
                v = np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, min(channel, n - 1)]
                for top in range(0, h, max(1, 65536 // w)):  # in strips, so a large image stays in small batches
                    part = v[top : top + max(1, 65536 // w)]
                    r, c = np.divmod(np.arange(part.size), w)
                    yield pa.RecordBatch.from_pydict({
                        key: pa.array([name] * part.size, pa.string()), "r": pa.array((r + top).astype(np.int32)),
                        "c": pa.array(c.astype(np.int32)), "v": pa.array(part.ravel().astype(np.int16)),
                    })

    fields = images.select(F.col(key).alias("_key"), "height", "width", "nChannels", "data")
    return fields.mapInArrow(run, f"{key} string, r int, c int, v short")


def pack(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Cells packed as bytes in row order, one row a raster; a cell's value is one byte."""
    at = F.struct((F.col("r") * width + F.col("c")).alias("i"), F.lpad(F.hex(F.col("v").cast("int")), 2, "0").alias("x"))
    return cells.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["x"]), "")).alias("data"))


def burn(cells: DataFrame, priority: list[int], keys: list[str]) -> DataFrame:
    """Cells (keys, r, c, cls) covered by several classes keep the first of the priority list."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("cls"))
    best = cells.filter(rank > 0).groupBy(*keys, "r", "c").agg(F.min(rank).alias("_p"))
    return best.select(*keys, "r", "c", F.element_at(F.array(*map(F.lit, priority)), F.col("_p").cast("int")).alias("v"))


def cells_of_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles (…, w, s, e, n) -> all their size x size cells with centres x = lon, y = lat."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    out = tiles.withColumn("r", F.explode(steps)).withColumn("c", F.explode(steps))
    x = F.col("w") + (F.col("c") + 0.5) / size * (F.col("e") - F.col("w"))
    y = F.col("n") - (F.col("r") + 0.5) / size * (F.col("n") - F.col("s"))
    return out.withColumn("x", x).withColumn("y", y)


def burn_polygons(tiles: DataFrame, features: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Cells of tiles whose centre a feature of the same key covers (keys, parts, cls; even-odd) -> keys, r, c, cls.

    By scan lines: each edge meets the rows between its ends; sorted by row and place, each two meetings
    that follow enclose cells. The time of a tile and a feature grows with the edges, the rows that they
    cross and the covered cells. Tiles are dealt by key in tasks of about a million cells, where all of theirs stay.
    """
    pts = F.flatten("parts")
    of = lambda pick, c: pick(F.transform(pts, lambda p: p[c]))
    shapes = features.withColumns({"_x0": of(F.array_min, "x"), "_y0": of(F.array_min, "y"), "_x1": of(F.array_max, "x"), "_y1": of(F.array_max, "y")})
    shapes = shapes.withColumn("_edges", joins.ring_edges(F.col("parts"))).drop("parts")
    both = tiles.join(shapes, keys).filter("_x1 >= w AND _x0 <= e AND _y1 >= s AND _y0 <= n").drop("_x0", "_y0", "_x1", "_y1")
    both = both.repartition(max(1, -(-tiles.count() * size * size // joins.MANY)), *keys)
    row = lambda y: (F.col("n") - y) / (F.col("n") - F.col("s")) * size - 0.5
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), v.cast("int")))
    centre = lambda r: F.col("n") - (r + 0.5) / size * (F.col("n") - F.col("s"))
    first = lambda e: inside(F.floor(row(F.greatest(e["a"]["y"], e["b"]["y"]))))
    last = lambda e: inside(F.ceil(row(F.least(e["a"]["y"], e["b"]["y"]))))
    rows = lambda e: F.filter(F.sequence(first(e), last(e)), lambda r: joins.crosses(e, centre(r)))
    met = F.flatten(F.transform("_edges", lambda e: F.transform(rows(e), lambda r: F.struct(r.alias("r"), joins.crossing(e, centre(r)).alias("x")))))
    both = both.withColumn("_met", F.array_sort(met)).drop("_edges").filter("size(_met) > 1")
    at = lambda i: F.get("_met", i.cast("int"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("_met") / 2).cast("int") - 1), lambda i: F.struct(at(2 * i)["r"].alias("r"), at(2 * i)["x"].alias("_from"), at(2 * i + 1)["x"].alias("_to")))
    both = both.select(*keys, "cls", "w", "e", F.inline(spans))
    col = lambda x: inside(F.floor((x - F.col("w")) / (F.col("e") - F.col("w")) * size - 0.5))
    cells = both.withColumn("c", F.explode(F.sequence(col(F.col("_from")), F.least(F.lit(size - 1), col(F.col("_to")) + 1))))
    x = F.col("w") + (F.col("c") + 0.5) / size * (F.col("e") - F.col("w"))
    return cells.filter((x >= F.col("_from")) & (x < F.col("_to"))).select(*keys, "r", "c", "cls").distinct()


def burn_buffered(tiles: DataFrame, features: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Cells of tiles (keys, w, s, e, n in degrees) within width_m of lines (keys, parts, cls, width_m) -> keys, r, c, cls.

    Distances are taken in the tile's own metre frame. Only cells in a segment's box, grown by the
    width, are made. With the rings of polygons as lines this is their outer padding.
    """
    pairs = lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    seg = features.withColumn("_s", F.explode(F.flatten(F.transform("parts", pairs)))).drop("parts")
    both = tiles.join(seg, keys)
    ky = F.lit(111_320.0)
    kx = ky * F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    both = both.withColumn("_kx", kx).withColumn("_ky", ky)
    step_x, step_y = (F.col("e") - F.col("w")) / size, (F.col("n") - F.col("s")) / size
    col = lambda x: (x - F.col("w")) / step_x - 0.5
    row = lambda y: (F.col("n") - y) / step_y - 0.5
    px, py = F.col("width_m") / F.col("_kx") / step_x, F.col("width_m") / F.col("_ky") / step_y
    xs, ys = (F.col("_s.a.x"), F.col("_s.b.x")), (F.col("_s.a.y"), F.col("_s.b.y"))
    low = lambda v: F.greatest(F.lit(0), F.ceil(v).cast("int"))
    high = lambda v: F.least(F.lit(size - 1), F.floor(v).cast("int"))
    both = both.withColumn("_r0", low(row(F.greatest(*ys)) - py)).withColumn("_r1", high(row(F.least(*ys)) + py))
    both = both.withColumn("_c0", low(col(F.least(*xs)) - px)).withColumn("_c1", high(col(F.greatest(*xs)) + px))
    cells = both.filter("_r0 <= _r1 AND _c0 <= _c1").withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1")))
    x = (F.col("w") + (F.col("c") + 0.5) * step_x - F.col("w")) * F.col("_kx")
    y = (F.col("n") - (F.col("r") + 0.5) * step_y - F.col("s")) * F.col("_ky")
    at = lambda p: ((p["x"] - F.col("w")) * F.col("_kx"), (p["y"] - F.col("s")) * F.col("_ky"))
    near = joins.segment_distance(x, y, *at(F.col("_s.a")), *at(F.col("_s.b"))) <= F.col("width_m")
    return cells.filter(near).select(*keys, "r", "c", "cls").distinct()


def neighbourhood(kind: str, k: int) -> list[tuple[int, int]]:
    """Offsets of a k x k rectangle or ellipse."""
    r = k // 2
    span = range(-r, k - r)
    return [(i, j) for i in span for j in span if kind == "rect" or (i / max(r, 0.5)) ** 2 + (j / max(r, 0.5)) ** 2 <= 1.0 + 1e-9]


def _swept(on: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Cells (…, r, c) that an offset carries a set cell to. Running counts: a run of rows costs the same whatever its size."""
    h, w = on.shape[-2:]
    columns: dict[int, list[int]] = {}
    for i, j in offsets:
        columns.setdefault(i, []).append(j)
    runs: list[list[int]] = []  # first row, last row, first column, last column
    for i, js in sorted(columns.items()):
        if runs and runs[-1][1] == i - 1 and runs[-1][2:] == [min(js), max(js)]:
            runs[-1][1] = i
        else:
            runs.append([i, i, min(js), max(js)])
    out, r, c = np.zeros_like(on), np.arange(h), np.arange(w)
    across = np.zeros((*on.shape[:-1], w + 1), np.int32)
    np.cumsum(on, axis=-1, out=across[..., 1:])
    down = np.zeros((*on.shape[:-2], h + 1, w), np.int32)
    for top, bottom, left, right in runs:
        line = across[..., np.clip(c - left + 1, 0, w)] > across[..., np.clip(c - right, 0, w)]
        np.cumsum(line, axis=-2, out=down[..., 1:, :])
        out |= down[..., np.clip(r - top + 1, 0, h), :] > down[..., np.clip(r - bottom, 0, h), :]
    return out


def _grown(on: np.ndarray, inside: np.ndarray, k: int, kind: str = "rect") -> np.ndarray:
    return _swept(on, neighbourhood(kind, k)) & inside


def _shrunk(on: np.ndarray, inside: np.ndarray, k: int, kind: str = "rect") -> np.ndarray:
    return inside & ~_swept(inside & ~on, [(-i, -j) for i, j in neighbourhood(kind, k)])


def _stencil(
    cells: DataFrame, keys: list[str], height: int, width: int, halo: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = MOST,
    value: str | None = None,
) -> DataFrame:
    """Set cells (keys, r, c) of all rasters after work(on, inside) on dense arrays; cells outside the raster are left out.

    One shuffle, whatever work does. Rasters of over `most` cells are dealt in bands of rows with `halo` more
    rows at both ends, the reach of work; small ones are stacked, as many as have `most` cells. on and
    inside have the axes raster, r, c; inside is false in rows beyond the raster. With `value`, a column of numbers from 0 to
    32767, on holds them, the largest of a cell that repeats, and -1 where there is no cell; results over zero are returned.
    """
    rows = max(1, min(height, most // width))
    bands = -(-height // rows)
    halo = halo if bands > 1 else 0
    more = [value] if value else []
    own = cells.select(*keys, "r", "c", *more).filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    band = lambda r: F.floor(r / rows).cast("int")
    at = F.sequence(F.greatest(F.lit(0), band(F.col("r") - halo)), F.least(F.lit(bands - 1), band(F.col("r") + halo)))
    own = own.withColumn("_band", F.explode(at) if bands > 1 else F.lit(0))
    types = own.drop("_band").schema
    deep = rows + 2 * halo

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        new = np.zeros(len(table), bool)
        new[0] = True
        for name in [*keys, "_band"]:
            code = table[name].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        top = table["_band"].to_numpy()[starts] * rows - halo
        r, c = table["r"].to_numpy() - top[of], table["c"].to_numpy()
        step = max(1, most // (deep * width))
        for first in range(0, len(starts), step):
            n = min(step, len(starts) - first)
            a, b = starts[first], starts[first + n] if first + n < len(starts) else len(table)
            place = of[a:b] - first, r[a:b], c[a:b]
            if value:
                on = np.full((n, deep, width), -1, np.int16)
                np.maximum.at(on, place, table[value].to_numpy()[a:b].astype(np.int16))
            else:
                on = np.zeros((n, deep, width), bool)
                on[place] = True
            line = top[first : first + n, None] + np.arange(deep)
            inside = np.broadcast_to(((line >= 0) & (line < height))[:, :, None], on.shape)
            found = work(on, inside)[:, halo : halo + rows]
            g, y, x = np.nonzero(found > 0)
            for to in range(0, len(g), 65536):
                part = slice(to, to + 65536)
                names = table.select(keys).take(pa.array(starts[first + g[part]])).combine_chunks()
                place = {"r": y[part] + top[first + g[part]] + halo, "c": x[part]} | {v: found[g[part], y[part], x[part]] for v in more}
                columns = [*(names[k].combine_chunks() for k in keys), *(pa.array(v).cast(table[c].type) for c, v in place.items())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows are sorted: a raster may go on in the next batch
        raster = lambda batch, at: batch.select([*keys, "_band"]).slice(at, 1).to_pylist()
        for batch in batches:
            if not len(batch):
                continue
            if held and raster(held[0], 0) != raster(batch, 0):
                yield from worked(pa.Table.from_batches(held))
                held = []
            last, low, high = raster(batch, len(batch) - 1), 0, len(batch) - 1
            while low < high:  # the first row of the batch's last raster
                half = (low + high) // 2
                low, high = (low, half) if raster(batch, half) == last else (half + 1, high)
            if low:
                yield from worked(pa.Table.from_batches([*held, batch.slice(0, low)]))
                held = []
            held.append(batch.slice(low))
        if held:
            yield from worked(pa.Table.from_batches(held))

    return own.repartition(*keys, "_band").sortWithinPartitions(*keys, "_band").mapInArrow(run, types)


def dilate(cells: DataFrame, keys: list[str], height: int, width: int, k: int = 3, kind: str = "rect") -> DataFrame:
    """Cells within the element of a set cell. Input and output hold set cells only (keys, r, c)."""
    return _stencil(cells, keys, height, width, k, lambda on, inside: _grown(on, inside, k, kind))


def erode(cells: DataFrame, keys: list[str], height: int, width: int, k: int = 3, kind: str = "rect") -> DataFrame:
    """Set cells whose whole element is set; cells outside the raster count as set."""
    return _stencil(cells, keys, height, width, k, lambda on, inside: _shrunk(on, inside, k, kind))


def opening(cells: DataFrame, keys: list[str], height: int, width: int, k: int = 3) -> DataFrame:
    return _stencil(cells, keys, height, width, 2 * k, lambda on, inside: _grown(_shrunk(on, inside, k), inside, k))


def closing(cells: DataFrame, keys: list[str], height: int, width: int, k: int = 3) -> DataFrame:
    return _stencil(cells, keys, height, width, 2 * k, lambda on, inside: _shrunk(_grown(on, inside, k), inside, k))


def open_close(cells: DataFrame, roads: list[int], keys: list[str], height: int, width: int) -> DataFrame:
    """Cleans class cells (keys, r, c, v > 0): roads are closed with 3 x 3, others opened and closed with 5 x 5, ellipses.

    Where cleaned classes overlap the larger id stays.
    """
    own = cells.filter("v > 0").select(*keys, F.col("v").alias("cls"), "r", "c")
    by, size = [*keys, "cls"], (height, width)
    road = own.filter(F.col("cls").isin(*roads)) if roads else own.limit(0)
    rest = own.filter(~F.col("cls").isin(*roads)) if roads else own

    def closed(on: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
        return _shrunk(_grown(on, inside, k, "ellipse"), inside, k, "ellipse")

    def opened(on: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return _grown(_shrunk(on, inside, 5, "ellipse"), inside, 5, "ellipse")

    road = _stencil(road, by, *size, 6, lambda on, inside: closed(on, inside, 3))
    rest = _stencil(rest, by, *size, 20, lambda on, inside: closed(opened(on, inside), inside, 5))
    return road.unionByName(rest).groupBy(*keys, "r", "c").agg(F.max("cls").alias("v"))


def edge_band(cells: DataFrame, keys: list[str], height: int, width: int, width_m: float, mppx: float) -> DataFrame:
    """Dilation without erosion, of half the width in pixels, one at least."""
    k = 2 * max(1, round(width_m / mppx / 2)) + 1
    return _stencil(cells, keys, height, width, k, lambda on, inside: _grown(on, inside, k) & ~_shrunk(on, inside, k))


def sobel(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Gradient magnitude of inner cells: each cell sends its weight to its neighbours, summed once."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(-j * (2 - abs(i))).alias("gx"), F.lit(-i * (2 - abs(j))).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    sent = cells.select(*keys, "r", "c", "v", F.explode(F.array(*steps)).alias("_s"))
    sent = sent.select(*keys, (F.col("r") + F.col("_s.i")).alias("r"), (F.col("c") + F.col("_s.j")).alias("c"), (F.col("v") * F.col("_s.gx")).alias("gx"), (F.col("v") * F.col("_s.gy")).alias("gy"))
    out = sent.groupBy(*keys, "r", "c").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.count("*").alias("_n")).filter("_n = 9")
    return out.withColumn("magnitude", F.hypot("gx", "gy")).drop("_n")


def _thinned(v: np.ndarray, inside: np.ndarray, low: int, high: int) -> np.ndarray:
    """Gray values (raster, r, c) -> 2 where the gradient, |x| + |y|, is over `high`, 1 where it is over `low`, if it is the largest
    along its direction, in steps of 45 degrees; else 0. Cells that are absent (-1) are black and have no gradient; borders are repeated."""
    rows = inside[:, :, 0]
    ends = rows.argmax(axis=1), rows.shape[1] - 1 - rows[:, ::-1].argmax(axis=1)
    at = np.clip(np.arange(rows.shape[1]), ends[0][:, None], ends[1][:, None])
    around = lambda a, **kw: (lambda p: lambda i, j: p[:, 1 + i : p.shape[1] - 1 + i, 1 + j : p.shape[2] - 1 + j])(np.pad(a, ((0, 0), (1, 1), (1, 1)), **kw))
    gray = around(np.take_along_axis(np.maximum(v, 0), at[:, :, None], 1).astype(np.int32), mode="edge")
    x = gray(-1, 1) - gray(-1, -1) + 2 * (gray(0, 1) - gray(0, -1)) + gray(1, 1) - gray(1, -1)
    y = gray(1, -1) - gray(-1, -1) + 2 * (gray(1, 0) - gray(-1, 0)) + gray(1, 1) - gray(-1, 1)
    m = np.where(inside & (v >= 0), np.abs(x) + np.abs(y), 0)
    near = around(m)
    across, down = np.abs(x) * 13573, np.abs(y) << 15  # 13573 / 2 ** 15 is the tangent of 22.5 degrees
    flat = (m > near(0, -1)) & (m >= near(0, 1))
    steep = (m > near(-1, 0)) & (m >= near(1, 0))
    slant = np.where((x ^ y) < 0, np.maximum(near(-1, 1), near(1, -1)), np.maximum(near(-1, -1), near(1, 1)))
    top = np.where(down < across, flat, np.where(down > across + (np.abs(x) << 16), steep, m > slant))
    return np.where(top & (m > low), 1 + (m > high), 0)


def _traced(level: np.ndarray) -> np.ndarray:
    """Levels (raster, r, c) in which every 1 that a chain of neighbours links to a 2 is a 2, too. Each cell is visited once."""
    p = np.pad(level, ((0, 0), (1, 1), (1, 1)))
    wide, cells = p.shape[2], p.reshape(-1)
    steps = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    front = np.flatnonzero(cells == 2)
    while front.size:
        near = (front[:, None] + steps).ravel()
        front = np.unique(near[cells[near] == 1])
        cells[front] = 2
    return p[:, 1:-1, 1:-1]


def canny(cells: DataFrame, keys: list[str], height: int, width: int, low: int = 80, high: int = 160, most: int = MOST) -> DataFrame:
    """Edge cells (keys, r, c) of gray cells (keys, r, c, v 0-255) by Canny's method, without smoothing.

    3 x 3 gradients, the largest along their direction, over `high` or linked to such a one by those over `low`. Absent
    cells are black and no edges. In rasters of over `most` cells, which go in bands, edges are traced in rounds until none
    goes on in another band.
    """
    whole = height <= most // width
    gray = cells.filter("v IS NOT NULL").select(*keys, "r", "c", F.col("v").cast("int").alias("v"))

    def levels(v: np.ndarray, inside: np.ndarray) -> np.ndarray:
        found = _thinned(v, inside, low, high)
        return _traced(found) == 2 if whole else found

    out, n = _stencil(gray, keys, height, width, 2, levels, most, "v"), None
    while not whole:
        out = out.checkpoint() if out.sparkSession.sparkContext.getCheckpointDir() else out.localCheckpoint()
        before, n = n, out.filter("v = 2").count()
        if n == before:
            out = out.filter("v = 2")
            break
        out = _stencil(out, keys, height, width, 1, lambda v, inside: _traced(np.maximum(v, 0)), most, "v")
    return out.select(*keys, "r", "c")


def edge_overlap(image_edges: DataFrame, mask_edges: DataFrame, keys: list[str], least: float = 0.035) -> DataFrame:
    """Share of mask boundary cells that are image edges, and a flag below `least`."""
    on = [*keys, "r", "c"]
    hit = mask_edges.select(*on).distinct().join(image_edges.select(*on).distinct().withColumn("_e", F.lit(1)), on, "left")
    share = F.count("_e") / F.greatest(F.count("*"), F.lit(1))
    return hit.groupBy(*keys).agg(share.alias("edge_overlap"), (share < least).alias("flagged"))


def dhash(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """64-bit difference hash of 8 rows of 9 area averages, as 16 hex digits."""
    small = resample(cells, keys, height, width, 8, 9, "area")
    more = F.col("v") > F.lag("v").over(Window.partitionBy(*keys, "r").orderBy("c"))
    bits = small.withColumn("_b", more).filter("_b").select(*keys, F.expr("shiftleft(1L, 64 - r * 8 - c)").alias("_bit"))
    return cells.select(*keys).distinct().join(bits.groupBy(*keys).agg(F.bit_or("_bit").alias("_h")), keys, "left").select(*keys, F.lower(F.lpad(F.hex(F.coalesce("_h", F.lit(0).cast("long"))), 16, "0")).alias("dhash"))


def resample(cells: DataFrame, keys: list[str], height: int, width: int, out_h: int, out_w: int, how: str) -> DataFrame:
    """Nearest (the source cell of each target) or area (mean of the cells that fall into a target)."""
    if how == "area":
        r, c = F.floor(F.col("r") * out_h / height).cast("int"), F.floor(F.col("c") * out_w / width).cast("int")
        return cells.groupBy(*keys, r.alias("r"), c.alias("c")).agg(F.avg("v").alias("v"))
    targets = lambda v, n, m: F.filter(F.sequence(F.floor(v * m / n).cast("int"), F.ceil((v + 1) * m / n).cast("int")), lambda t: (F.floor(t * n / m) == v) & (t < m))
    out = cells.withColumn("_r", F.explode(targets(F.col("r"), height, out_h))).withColumn("_c", F.explode(targets(F.col("c"), width, out_w)))
    return out.drop("r", "c").withColumnsRenamed({"_r": "r", "_c": "c"})


def make_patches(tiles: DataFrame, cells: DataFrame, size: int, low: float, high: float, region: str = "region") -> DataFrame:
    """2 x 2 mosaics of tiles (region, x, y) with the ratio of non-background cells in a range, and their classes."""
    quads = joins.tile_quads(tiles, (region,)).withColumnsRenamed({"x": "px", "y": "py"})
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    parts = quads.withColumn("_q", quarter).withColumn("x", F.col("px") + F.col("_q.i")).withColumn("y", F.col("py") + F.col("_q.j"))
    moved = cells.join(parts, [region, "x", "y"])
    out = moved.groupBy(region, "px", "py").agg(
        (F.sum(F.when(F.col("v") != 0, 1).otherwise(0)) / (4 * size * size)).alias("non_background_ratio"), F.array_sort(F.collect_set("v")).alias("classes_present")
    )
    return out.filter(F.col("non_background_ratio").between(low, high))


def patch_cells(tiles: DataFrame, cells: DataFrame, size: int, region: str = "region") -> DataFrame:
    """Cells (region, x, y, r, c, v) of tiles of size x size, moved into every 2 x 2 mosaic that holds their tile: region, px, py, r, c, v."""
    quads = joins.tile_quads(tiles, (region,)).withColumnsRenamed({"x": "px", "y": "py"})
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    parts = quads.withColumn("_q", quarter).withColumn("x", F.col("px") + F.col("_q.i")).withColumn("y", F.col("py") + F.col("_q.j"))
    return cells.join(parts, [region, "x", "y"]).select(region, "px", "py", (F.col("r") + size * F.col("_q.j")).alias("r"), (F.col("c") + size * F.col("_q.i")).alias("c"), "v")


def raster_or(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "r", "c"]
    return a.select(*on, "v").unionByName(b.select(*on, "v")).groupBy(*on).agg(F.max("v").alias("v"))


def raster_and(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "r", "c"]
    return a.filter("v > 0").select(*on).join(b.filter("v > 0").select(*on), on).distinct()


def snow_mask(cells: DataFrame, snow: Column, keys: list[str], height: int, width: int, k: int = 3) -> DataFrame:
    """Closed set of cells (red, green, blue columns) that a snow predicate holds for."""
    return closing(cells.filter(snow).select(*keys, "r", "c"), keys, height, width, k)


def class_edges(cells: DataFrame, keys: list[str], height: int, width: int, least: int = 50) -> DataFrame:
    """Boundary cells of each class (dilation without the class itself), for classes with enough of them.

    They are counted where they are made, in the dense arrays; only rasters that go in bands are counted
    after a shuffle and then made anew, without a sort of all boundary cells.
    """
    own = cells.filter("v > 0").select(*keys, F.col("v").alias("cls"), "r", "c")
    whole = height <= MOST // width

    def edge(on: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = _grown(on, inside, 3) & ~on
        return out & (out.sum(axis=(1, 2)) >= least)[:, None, None] if whole else out

    out = _stencil(own, [*keys, "cls"], height, width, 3, edge)
    if whole:
        return out
    enough = out.groupBy(*keys, "cls").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return out.join(enough.hint("shuffle_hash"), [*keys, "cls"])


def texture_metrics(cells: DataFrame, keys: list[str], height: int, width: int, grid: int = 8, edge: float = 40.0, patch_std: float = 8.0) -> DataFrame:
    """Deviation, entropy, edge density and share of flat patches of valid cells (keys, r, c, v, valid), and votes.

    Patches with under 16 valid cells are skipped; fewer than 64 valid cells give nulls and no votes.
    """
    ok = cells.filter("valid")
    base = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("std"))
    hist = ok.groupBy(*keys, "v").agg(F.count("*").alias("_n")).join(base.select(*keys, "n"), keys)
    p = F.col("_n") / F.col("n")
    entropy = hist.groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))
    grad = sobel(cells, keys).filter(F.col("magnitude") > edge).join(ok.select(*keys, "r", "c"), [*keys, "r", "c"])
    edges = grad.groupBy(*keys).agg(F.count("*").alias("_e"))
    patch = ok.groupBy(*keys, F.floor(F.col("r") / (height // grid)).alias("i"), F.floor(F.col("c") / (width // grid)).alias("j"))
    flat = patch.agg(F.count("*").alias("_n"), F.stddev_pop("v").alias("_s")).filter(f"_n >= 16 AND i < {grid} AND j < {grid}")
    flat = flat.groupBy(*keys).agg(F.avg(F.when(F.col("_s") < patch_std, 1.0).otherwise(0.0)).alias("low_var_patch_frac"))
    out = base.join(entropy, keys).join(edges, keys, "left").join(flat, keys, "left")
    out = out.withColumn("edge_density", F.coalesce("_e", F.lit(0)) / F.col("n"))
    names = ["std", "entropy", "edge_density", "low_var_patch_frac"]
    return out.select(*keys, "n", *[F.when(F.col("n") >= 64, F.col(c)).alias(c) for c in names])


def texture_votes(metrics: DataFrame, std: float = 20.0, entropy: float = 5.5, edges: float = 0.05, flat: float = 0.6, need: int = 3) -> DataFrame:
    """Votes of the four metrics and raw_obstructed; nulls don't vote."""
    marks = [F.col("std") < std, F.col("entropy") < entropy, F.col("edge_density") < edges, F.col("low_var_patch_frac") > flat]
    votes = sum((F.coalesce(m.cast("int"), F.lit(0)) for m in marks), F.lit(0))
    return metrics.withColumn("votes", votes).withColumn("raw_obstructed", F.col("votes") >= need)


def texture_mask(cells: DataFrame, keys: list[str], pct: float) -> DataFrame:
    """Inner cells whose absolute Laplacian reaches a percentile of its raster."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(-4 if i == j == 0 else 1).alias("k")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))]
    sent = cells.select(*keys, "r", "c", "v", F.explode(F.array(*steps)).alias("_s"))
    sent = sent.select(*keys, (F.col("r") + F.col("_s.i")).alias("r"), (F.col("c") + F.col("_s.j")).alias("c"), (F.col("v") * F.col("_s.k")).alias("_l"))
    lap = sent.groupBy(*keys, "r", "c").agg(F.abs(F.sum("_l")).alias("laplacian"), F.count("*").alias("_n")).filter("_n = 5").drop("_n")
    return lap.join(lap.groupBy(*keys).agg(F.percentile("laplacian", pct / 100).alias("_p")), keys).filter("laplacian >= _p").drop("_p")


def peak_margin(votes: DataFrame, radius: int, key: str = "pair_id") -> DataFrame:
    """The best vote (dr, dc) of each key and its lead over the best one outside a square about it."""
    top = votes.groupBy(key).agg(F.max_by(F.struct("dr", "dc", "votes"), F.struct("votes", -F.abs("dr"), -F.abs("dc"), "dr", "dc")).alias("p"))
    rest = votes.join(top, key).filter(F.greatest(F.abs(F.col("dr") - F.col("p.dr")), F.abs(F.col("dc") - F.col("p.dc"))) > radius)
    second = rest.groupBy(key).agg(F.max("votes").alias("second"))
    return top.join(second, key, "left").select(key, "p.dr", "p.dc", F.col("p.votes").alias("peak"), (F.col("p.votes") - F.coalesce("second", F.lit(0))).alias("margin"))


def mask_match(template: DataFrame, scene: DataFrame, size: int, scene_h: int, scene_w: int, radius: int, key: str = "pair_id", least: int = 50) -> DataFrame:
    """Normalised correlation of size x size class masks within a scene, weighted by class -> best offset, peak, margin.

    Cells: key, cls, r, c, w. One pair of rasters, whose size the parameters bound, is one group: both are
    dealt once by key. Products of equal cells come from one transform a class, window sums from running
    sums. Classes with fewer than `least` template cells take no part; offsets at which no cells meet
    don't count; margins are taken as in peak_margin().
    """
    high, wide = scene_h - size, scene_w - size
    kind = template.schema[key].dataType.simpleString()

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t[c].to_numpy().astype(np.float64)
        cls, votes, met, weight = left["cls"].to_numpy(), np.zeros((high + 1, wide + 1)), np.zeros((high + 1, wide + 1), bool), 0.0
        other, n = right["cls"].to_numpy(), size * size
        for k in np.unique(cls):
            own = np.flatnonzero(cls == k)
            if len(own) < least:
                continue
            t, s = np.zeros((size, size)), np.zeros((scene_h, scene_w))
            t[column(left, "r").astype(int)[own], column(left, "c").astype(int)[own]] = 1
            here = np.flatnonzero(other == k)
            s[column(right, "r").astype(int)[here], column(right, "c").astype(int)[here]] = 1
            w = column(left, "w")[own].max()
            weight += w
            shape = (scene_h, scene_w)
            product = np.fft.irfft2(np.fft.rfft2(s) * np.conj(np.fft.rfft2(t, shape)), shape)
            sts = np.round(product[: high + 1, : wide + 1])
            run = np.pad(s.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            ss = run[size:, size:] - run[:-size, size:] - run[size:, :-size] + run[:-size, :-size]
            st = t.sum()
            under = np.sqrt((n * st - st * st) * (n * ss - ss * ss))
            with np.errstate(divide="ignore", invalid="ignore"):
                ncc = np.where(under > 0, (n * sts - st * ss) / under, 0.0)
            votes += np.where(sts > 0, w * ncc, 0.0)
            met |= sts > 0
        dr, dc = np.nonzero(met)
        if not len(dr):
            return pa.table({key: left[key].slice(0, 0), **{c: pa.array([], t) for c, t in kinds}})
        score = np.round(votes[dr, dc] / weight, 9)  # equal peaks stay equal
        best = np.lexsort((dc, dr, -dc, -dr, score))[-1]
        rest = score[np.maximum(np.abs(dr - dr[best]), np.abs(dc - dc[best])) > radius]
        margin = score[best] - (rest.max() if len(rest) else 0.0)
        out = {c: pa.array([v], t) for (c, t), v in zip(kinds, (dr[best], dc[best], score[best], margin))}
        return pa.table({key: left[key].slice(0, 1), **out})

    kinds = (("dr", pa.int32()), ("dc", pa.int32()), ("peak", pa.float64()), ("margin", pa.float64()))
    names = [F.col(c).alias(c) for c in (key, "cls", "r", "c", "w")]  # both sides may come from one table
    both = template.select(*names).groupBy(key).cogroup(scene.select(*names).groupBy(key))
    return both.applyInArrow(_whole(match, key, kinds), f"{key} {kind}, dr int, dc int, peak double, margin double")


def _whole(match, key: str, kinds):
    """match(), for pairs that have both sides."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return match(left, right)
        return pa.table({key: pa.array([], left.schema.field(key).type), **{c: pa.array([], t) for c, t in kinds}})

    return run


#: The fewest template edges, template pixels and scene features of a search.
TEMPLATE_EDGES, TEMPLATE_PIXELS, SCENE_FEATURES = 200, 500, 1000


def match_report(
    pairs: DataFrame, template: DataFrame, scene: DataFrame, size: int, scene_h: int, scene_w: int, radius: int, key: str = "pair_id", least: int = 50,
    least_template: int = TEMPLATE_PIXELS, least_scene: int = SCENE_FEATURES, mode: str = "masks",
) -> DataFrame:
    """Every pair (key, w, s, e, n: the scene's box) with its match: dr, dc, peak, margin, lat, lon of the template's
    centre, accepted, sigma_m, and the first reject_reason that applies.

    Reasons: template_too_big, too_few_template_cells, too_few_scene_features, no_valid_channels (no class
    with `least` template cells meets the scene), then a peak that gates.gate_peak() refuses: peak_too_weak
    or low_margin.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    fits = size <= scene_h and size <= scene_w
    cells = template if fits else template.limit(0)
    out = pairs.join(count(template, "_t"), key, "left").join(count(scene, "_s"), key, "left").fillna(0, ["_t", "_s"])
    enough = out.filter((F.col("_t") >= least_template) & (F.col("_s") >= least_scene)).select(key)
    found = mask_match(cells.join(enough, key, "left_semi"), scene.join(enough, key, "left_semi"), min(size, scene_h, scene_w), scene_h, scene_w, radius, key, least)
    out = out.join(found, key, "left")
    gate = gates.gate_peak("peak", "margin", mode)
    weak = F.col("peak") <= (0.05 if mode == "edges" else 0.10)
    reason = gates.first_reason(
        (F.lit(not fits), "template_too_big"), (F.col("_t") < least_template, "too_few_template_cells"), (F.col("_s") < least_scene, "too_few_scene_features"),
        (F.col("peak").isNull(), "no_valid_channels"), (~gate["accepted"] & weak, "peak_too_weak"), (~gate["accepted"], "low_margin"),
    )
    at = geo.pixel_to_geo(F.col("dc") + size / 2, F.col("dr") + size / 2, "w", "s", "e", "n", scene_w, scene_h)
    return out.select(
        key, "dr", "dc", "peak", "margin", at["lat"].alias("lat"), at["lon"].alias("lon"), reason.isNull().alias("accepted"),
        F.when(reason.isNull(), gate["sigma_m"]).alias("sigma_m"), reason.alias("reject_reason"),
    )


def gray_of_hsv() -> Column:
    """Gray of the columns h (0-179), s, v (0-255): red, green and blue, rounded, by their usual weights."""
    h, s, v = (F.col(c).cast("int") for c in "hsv")
    sector, part = F.floor(F.pmod(h, F.lit(180)) / 30), F.pmod(h, F.lit(30))
    to = lambda less: F.floor((2 * v * (7650 - s * less) + 7650) / 15300)
    p, q, t = to(F.lit(30)), to(part), to(30 - part)
    red, green, blue = (
        F.element_at(F.array(*x), (sector + 1).cast("int")) for x in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))
    )
    return F.floor((9798 * red + 19235 * green + 3735 * blue + 16384) / 32768).cast("int")


def visual_feature(cells: DataFrame, key: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """12 x 4 x 4 histogram of cells (key, r, c, h 0-179, s, v 0-255), mean and deviation of gray, share of edges: one array of
    195 numbers a raster, of which the histogram and then the whole are brought to length one.

    Edges are those of canny() in the raster of height x width, as a share of its cells. Without the size, cells (key, h, s, v)
    have no places and so no edges: the histogram as shares, mean and deviation of v, 194 numbers of length one.
    """
    size = 194 if height is None else 195
    own = cells.withColumn("_w", F.col("v") if height is None else gray_of_hsv())
    b = lambda c, n, most: F.least(F.lit(n - 1), F.floor(F.col(c) * n / most)).cast("int")
    bins = own.groupBy(key, (b("h", 12, 180) * 16 + b("s", 4, 256) * 4 + b("v", 4, 256)).alias("bin"))
    bins = bins.agg(F.count("*").alias("n"), F.sum("_w").cast("double").alias("sum"), F.sum(F.col("_w").cast("double") * F.col("_w")).alias("squares"))
    if height is not None:
        edges = canny(own.select(key, "r", "c", F.col("_w").alias("v")), [key], height, width).groupBy(key).agg(F.count("*").alias("n"))
        none = F.lit(None).cast("double")
        bins = bins.unionByName(edges.select(key, F.lit(194).alias("bin"), "n", none.alias("sum"), none.alias("squares")))
    n = F.sum(F.when(F.col("bin") < 192, F.col("n"))).alias("n")
    parts = bins.groupBy(key).agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"), n, F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    spread = F.greatest(F.lit(0.0), F.col("n") * F.col("squares") - F.col("sum") * F.col("sum"))
    parts = parts.select(key, "bins", "ns", "n", (F.col("sum") / F.col("n")).alias("mean"), (F.sqrt(spread) / F.col("n")).alias("std"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns = batch["ns"].flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), batch["bins"].value_lengths().to_numpy())
            f = np.zeros((len(batch), size))
            f[row, batch["bins"].flatten().to_numpy()] = ns
            hist = f[:, :192]
            whole = hist.sum(axis=1, keepdims=True) if size == 194 else np.sqrt((hist * hist).sum(axis=1, keepdims=True))
            hist /= np.maximum(whole, 1)
            f[:, 192], f[:, 193] = batch["mean"].to_numpy(False) / 255, batch["std"].to_numpy(False) / 255
            f[:, 194:] /= batch["n"].to_numpy(False)[:, None]
            f /= np.maximum(np.sqrt((f * f).sum(axis=1, keepdims=True)), 1e-12)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(ends, pa.array(f.ravel()))], names=[key, "feature"])

    return parts.mapInArrow(run, f"{key} {cells.schema[key].dataType.simpleString()}, feature array<double>")


def tile_shift(image_edges: DataFrame, mask_edges: DataFrame, most: int, radius: int, key: str = "tile_id", tiles: DataFrame | None = None) -> DataFrame:
    """Shift of the mask edges against the image edges within `most` cells: dx, dy, response (votes per edge cell), margin.

    With `tiles` (key, fg_share, edge_share) every tile has a row, with shift_mag and status: no_signal where
    under half a percent of cells are edges or under two percent are foreground, or nothing meets.
    """
    one = lambda df: df.select(key, F.lit(1).alias("cls"), "r", "c", F.lit(1.0).alias("w"))
    if tiles is not None:
        clear = tiles.filter("edge_share >= 0.005 AND fg_share >= 0.02").select(key)
        image_edges, mask_edges = image_edges.join(clear, key, "left_semi"), mask_edges.join(clear, key, "left_semi")
    peaks = peak_margin(joins.offset_votes(one(mask_edges), one(image_edges), most, key), radius, key)
    n = mask_edges.groupBy(key).agg(F.count("*").alias("_n"))
    out = peaks.join(n, key).select(key, F.col("dc").alias("dx"), F.col("dr").alias("dy"), (F.col("peak") / F.col("_n")).alias("response"), "margin")
    if tiles is None:
        return out
    status = F.when(F.col("dx").isNull(), "no_signal").otherwise("ok")
    return tiles.join(out, key, "left").withColumns({"shift_mag": F.hypot("dx", "dy"), "status": status, "response": F.coalesce("response", F.lit(0.0))})
