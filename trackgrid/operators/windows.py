"""Row-order operators: time steps, hysteresis, modes, histories, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_dt(df: DataFrame, keys: list[str], t: str = "t", fps: float = 30.0, order: tuple[str, ...] = ()) -> DataFrame:
    """Seconds since the row before, at least a millisecond; the first row has 1 / fps."""
    step = F.col(t) - F.lag(t).over(_w(keys, [t, *order]))
    return df.withColumn("dt", F.greatest(F.lit(1e-3), F.coalesce(step, F.lit(1.0 / fps))))


def hysteresis(df: DataFrame, flag: str, entry: int, exit: int, keys: list[str], order: list[str], name: str = "is_on") -> DataFrame:
    """On after `entry` flags in a row, off after `exit` rows without; else as before. Off at the start."""
    up = _w(keys, order)
    streak = lambda n, cond: F.sum(F.when(cond, 1).otherwise(0)).over(up.rowsBetween(-(n - 1), 0)) == n
    turn = F.when(streak(entry, F.col(flag)), True).when(streak(exit, ~F.coalesce(F.col(flag), F.lit(False))), False)
    rows = df.withColumn("_turn", turn)
    held = F.coalesce(F.last("_turn", True).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return rows.withColumn(name, held).drop("_turn")


def track_mode(log: DataFrame, keys: list[str], t: str = "t", sigma: str = "sigma", accepted: str = "accepted", order: tuple[str, ...] = ()) -> DataFrame:
    """TRACK, WEAK or RELOCALIZE from sigma and the time since the last accepted fix of an earlier row."""
    before = _w(keys, [t, *order]).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col(t) - F.last(F.when(F.col(accepted), F.col(t)), True).over(before), F.lit(1e9))
    mode = F.when((F.col(sigma) < 60) & (gap < 5), "TRACK").when((F.col(sigma) < 200) & (gap < 30), "WEAK").otherwise("RELOCALIZE")
    return log.withColumn("mode", mode)


def rank_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(_w(keys, order)))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def trailing(df: DataFrame, seconds: float, keys: list[str], t: str, value: str) -> DataFrame:
    """Count and mean of a value over the last seconds, by a range of whole microseconds."""
    w = Window.partitionBy(*keys).orderBy((F.col(t) * 1_000_000).cast("long")).rangeBetween(-int(seconds * 1_000_000), 0)
    return df.withColumn("trail_n", F.count(value).over(w)).withColumn("trail_mean", F.avg(value).over(w))


def track_slope(df: DataFrame, keys: list[str], distance: Column, value: str, order: list[str]) -> DataFrame:
    """Path length and the mean and largest |change of value / distance| along a track; distance is a row's own step."""
    w = _w(keys, order)
    rows = df.withColumn("_d", distance).withColumn("_s", F.abs(F.col(value) - F.lag(value).over(w)))
    slope = F.when(F.col("_d") > 0, F.col("_s") / F.nullif(F.col("_d"), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.sum("_d").alias("length_m"), F.avg(slope).alias("mean_slope"), F.max(slope).alias("max_slope"))


def segment_edges(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each key."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def episodes(df: DataFrame, flag: str, keys: list[str], order: list[str]) -> DataFrame:
    """Numbers runs of equal flags from 1."""
    w = _w(keys, order)
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
