"""Whole workloads composed of operators: retrieval evaluation, dataset build, track evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, raster, retrieval, selection, state


def evaluate_retrieval(queries: DataFrame, gallery: DataFrame, ks: list[int], radii: list[float], error) -> DataFrame:
    """recall_grid() of the top hits; error(hits) adds the column `error` to query_id, vec_id, score, rank."""
    hits = error(retrieval.cosine_topk(queries, gallery, max(ks)))
    return retrieval.recall_grid(hits, ks, radii)


def build_masks(tiles: DataFrame, features: DataFrame, size: int, priority: list[int], keys: list[str]) -> DataFrame:
    """Class histograms of tiles (keys, w, s, e, n) burnt with features (keys, parts, cls) by priority."""
    cells = raster.burn(raster.burn_polygons(tiles, features, size, keys), priority, keys)
    counts = cells.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    hist = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("pixel_hist"), F.sum("n").alias("_set"))
    out = tiles.join(hist, keys, "left").withColumn("_set", F.coalesce("_set", F.lit(0)))
    empty = F.create_map(F.lit(0), (size * size - F.col("_set")).cast("long"))
    full = F.when(F.col("pixel_hist").isNull(), empty).otherwise(F.map_concat("pixel_hist", empty))
    return out.select(*keys, full.alias("pixel_hist"), F.round(F.col("_set") / (size * size), 6).alias("non_background_ratio"))


def build_splits(patches: DataFrame) -> DataFrame:
    """Balanced patches with their split."""
    return selection.split_regions(selection.boost_rare(patches))


def evaluate_track(log: DataFrame, segments: DataFrame, truth: DataFrame, keys: list[str], most_sigma: float) -> DataFrame:
    """Segment KPIs of a log (keys, t, x, y, sigma_m, accepted, obstructed) against truth points (keys, t, x, y)."""
    rows = joins.interp_asof(joins.assign_segments(log, segments), truth, ["x", "y"], keys)
    rows = rows.withColumn("ate_m", F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y")))
    return aggregates.segment_kpis(rows, keys, most_sigma)


def run_tracks(fixes: DataFrame, motion: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement gate and track filter."""
    return state.fuse_channels(fixes, motion, keys)
