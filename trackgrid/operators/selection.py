"""Selections, splits, rankings, validation and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import with_index


def topk(df: DataFrame, keys: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k largest scores of each key, of all rows without keys; ties by `tie`."""
    order = [F.desc(score), F.col(tie)]
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def select_frames(df: DataFrame, keys: list[str], order: list[str], stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th frame of each key, at most `most` of them."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = df.withColumn("_n", n).filter(F.col("_n") % stride == 0)
    return (out.filter(F.col("_n") < stride * most) if most is not None else out).drop("_n")


def first_sequence(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Rows of the smallest sequence of each key."""
    least = df.groupBy(*keys).agg(F.min(sequence).alias(sequence))
    return df.join(least, [*keys, sequence], "left_semi")


def frame_index(runs: DataFrame, stride: int, lat: float, lon: float) -> DataFrame:
    """(n_frames, fps, lat, lon) -> one row for every stride-th frame with its time and a default position."""
    out = runs.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames").cast("int") - 1, F.lit(0)), F.lit(stride))))
    return out.withColumns({"t_sec": F.col("frame_idx") / F.col("fps"), "lat": F.coalesce("lat", F.lit(lat)), "lon": F.coalesce("lon", F.lit(lon))})


def validate(df: DataFrame, rules: dict[str, Column], id_column: str) -> DataFrame:
    """Violations (rule, id): rows for which a rule does not hold or is null."""
    rows = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("rule"), F.col(id_column).alias("id"))


def overlapping(segments: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Segments that begin before one that began earlier has ended."""
    ended = F.max(end).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("_ended", ended).filter(F.col(start) < F.col("_ended")).drop("_ended")


def not_increasing(df: DataFrame, keys: list[str], position: str, t: str) -> DataFrame:
    """Rows whose time is not after that of the row before."""
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(position))
    return df.withColumn("_b", before).filter(F.col(t) <= F.col("_b")).drop("_b")


def boost_rare(patches: DataFrame, rare: tuple[int, ...] = (1, 3, 4)) -> DataFrame:
    """All patches with a rare class, and at most twice as many others (one at least) by non-background ratio."""
    has = F.arrays_overlap("classes_present", F.array(*map(F.lit, rare)))
    flagged = patches.withColumn("_rare", F.coalesce(has, F.lit(False)))
    cap = max(2 * flagged.filter("_rare").count(), 1)
    kept = flagged.filter("NOT _rare").orderBy(F.desc("non_background_ratio"), "patch_id").limit(cap)
    return flagged.filter("_rare").unionByName(kept).drop("_rare")


def split_regions(patches: DataFrame, region: str = "region_id") -> DataFrame:
    """train, val or test by region: airport-like regions first, then larger ones, then by name.

    The first max(1, 70 %) regions train; the next max(1, 15 %) validate if two or more are left, else
    one less than are left; the rest test. Regions are ranked in one window.
    """
    airport = F.contains(F.lower(region), F.lit("airport")) | F.contains(F.lower(region), F.lit("svo"))
    sizes = patches.groupBy(region).agg(F.count("*").alias("_size")).withColumn("_airport", airport)
    order = Window.orderBy(F.when(F.col("_airport"), 0).otherwise(1), F.desc("_size"), region)  # regions only
    n = F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sizes.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", n)
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.7))
    val = F.when(F.col("_n") - train >= 2, F.greatest(F.lit(1), F.floor(F.col("_n") * 0.15))).otherwise(F.greatest(F.lit(0), F.col("_n") - train - 1))
    split = F.when(F.col("_r") < train, "train").when(F.col("_r") < train + val, "val").otherwise("test")
    return patches.join(ranked.select(region, split.alias("split")), region)


def split_random(df: DataFrame, id_column: str, share: float, seed: int) -> DataFrame:
    """A fixed share of rows, by the order of a seeded hash, is `train`; it does not depend on the partitioning."""
    numbered = with_index(df.withColumn("_h", F.xxhash64(id_column, F.lit(seed))), ["_h", id_column], "_i")
    n = df.count()
    return numbered.withColumn("split", F.when(F.col("_i") < int(n * share), "train").otherwise("val")).drop("_h", "_i")


def sample_per_key(df: DataFrame, key: str, n: int, id_column: str, seed: int = 0) -> DataFrame:
    """At most n rows of each key, by seeded hash."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(id_column, F.lit(seed)), id_column)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def quota_select(df: DataFrame, top_k: int, min_building: int, min_roads: int, id_column: str = "patch_id", distance: str = "distance") -> DataFrame:
    """Nearest rows by quota: first with buildings, then with roads, then any, top_k in all.

    The building stage ends when min_building are taken; taken rows with roads count for the road
    stage. Every stage is a limited sort, so at most top_k rows pass between them.
    """
    order = [F.col(distance), F.col(id_column)]
    one = df.filter("has_building").orderBy(*order).limit(min(min_building, top_k))
    taken = one.agg(F.count("*"), F.count_if("has_roads")).first()
    need = max(0, min(min_roads - taken[1], top_k - taken[0]))
    left = df.join(one.select(id_column), id_column, "left_anti")
    two = left.filter("has_roads").orderBy(*order).limit(need)
    rest = left.join(two.select(id_column), id_column, "left_anti").orderBy(*order).limit(max(0, top_k - taken[0] - two.count()))
    tag = lambda part, k: part.select(*df.columns).withColumn("stage", F.lit(k))
    return tag(one, 1).unionByName(tag(two, 2)).unionByName(tag(rest, 3))


def preview_rank(df: DataFrame, n: int, id_column: str) -> DataFrame:
    """The n best by twice the classes less the distance of the non-background ratio from 0.45."""
    score = 2 * F.col("n_classes") - F.abs(F.col("non_background_ratio") - 0.45)
    return df.withColumn("preview_score", score).orderBy(F.desc("preview_score"), id_column).limit(n)


def worst_n(df: DataFrame, value: str, n: int, id_column: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), id_column).limit(n)


def rank_grid(df: DataFrame, rate: str, inliers: str, residual: str, keys: list[str]) -> DataFrame:
    """Settings by rate and inliers, both descending, then by finite residual; ranks from 1. Settings are few."""
    ok = F.when(~F.isnan(residual) & (F.abs(residual) < float("inf")), F.col(residual))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rate), F.desc(inliers), ok.asc_nulls_last(), *keys)))


def best_candidate(cands: DataFrame, keys: list[str], early: int) -> DataFrame:
    """Per frame the accepted candidate with most inliers among those up to the first with `early`; ties by rank."""
    bound = F.min(F.when(F.col("accepted") & (F.col("inliers") >= early), F.col("rank"))).over(Window.partitionBy(*keys))
    seen = cands.withColumn("_b", bound).filter(F.col("_b").isNull() | (F.col("rank") <= F.col("_b"))).filter("accepted").drop("_b")
    row = F.struct(*[F.col(c) for c in seen.columns])
    return seen.groupBy(*keys).agg(F.max_by(row, F.struct("inliers", -F.col("rank"))).alias("b")).select("b.*")


def tiebreak_rank(df: DataFrame, floor: float, id_column: str) -> DataFrame:
    """Candidates with a gate of at least `floor` by residual, then the others by gate; and the margin to the next.

    Candidates are few.
    """
    ok = F.col("gate") >= floor
    w = Window.orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col("residual")).asc_nulls_last(), F.desc("gate"), id_column)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.lead("residual").over(w) - F.col("residual"))


def sample_indices(df: DataFrame, keys: list[str], order: list[str], n: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """n evenly spaced rows of each key between two shares of its length."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = (high - low) / max(n - 1, 1)
    wanted = F.array(*[F.floor((F.col("_n") - 1) * (low + step * i)) for i in range(n)])
    return rows.filter(F.array_contains(wanted, F.col("_r").cast("long"))).drop("_r", "_n")


def jittered_indices(df: DataFrame, keys: list[str], order: list[str], n: int, seed: int = 0) -> DataFrame:
    """One row of each of n equal stretches of a key, chosen by seeded hash."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    rows = rows.withColumn("stratum", F.floor(F.col("_r") * n / F.col("_n")))
    first = F.row_number().over(Window.partitionBy(*keys, "stratum").orderBy(F.xxhash64("_r", F.lit(seed)), "_r"))
    return rows.withColumn("_k", first).filter("_k = 1").drop("_r", "_n", "_k")


def keep_existing(df: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    return df.join(files.select(*on), on, "left_semi")


def drop_rejected(df: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    return df.join(rejected.select(*on), on, "left_anti")


def region_except(everything: DataFrame, *used: DataFrame) -> DataFrame:
    """Regions in none of the other tables."""
    for part in used:
        everything = everything.subtract(part)
    return everything


def discover(*listings: DataFrame) -> DataFrame:
    """Paths of several listings, each once."""
    out = listings[0].select("path")
    for more in listings[1:]:
        out = out.unionByName(more.select("path"))
    return out.distinct()
