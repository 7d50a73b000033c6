"""Table functions for SQL users."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="x int, y int")
class TilesInBox:
    """Tiles of zoom z that a box (w, s, e, n) meets."""

    def eval(self, w: float, s: float, e: float, n: float, z: int) -> Iterator[tuple[int, int]]:
        side = 2**z
        col = lambda lon: int((lon + 180.0) / 360.0 * side)
        row = lambda lat: int((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * side)
        for x in range(col(w), col(e) + 1):
            for y in range(row(n), row(s) + 1):
                yield x, y


@udtf(returnType="x int, y int")
class TileWindow:
    """Tiles within Chebyshev radius r of a tile."""

    def eval(self, x: int, y: int, r: int) -> Iterator[tuple[int, int]]:
        for i in range(x - r, x + r + 1):
            for j in range(y - r, y + r + 1):
                yield i, j


def register(spark: SparkSession) -> None:
    """Make tiles_in_bbox(w, s, e, n, z) and tile_window(x, y, r) known to SQL."""
    spark.udtf.register("tiles_in_bbox", TilesInBox)
    spark.udtf.register("tile_window", TileWindow)
