"""Exact order statistics that no task holds all values of a key for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _ranges(v: Column) -> list[Column]:
    """Ranges of a finite double from coarse to fine, each in the order of the values: the binade, then binary digits."""
    e = F.when(v != 0, F.floor(F.log2(F.abs(v)))).otherwise(0)
    binade = F.when(v > 0, e + 1100).when(v < 0, -(e + 1100)).otherwise(0)
    digits = lambda n: F.floor(v / F.pow(F.lit(2.0), e) * float(2**n))
    return [binade, digits(16), digits(34)]


def order_statistics(df: DataFrame, keys: list[str], value: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and a column for each name of `at`: the finite value at the rank, from 0, that it gives for n values.

    A null where that rank does not exist; keys without finite values have no row; null keys are a key.
    Values are counted, the counts are added up by ranges of the values, and only the ranges that hold a
    rank are opened, one level after the other. The values of a key are spread over the tasks: of a range a
    task has at most its 2**18 parts for each rank.
    """
    v = F.col(value).cast("double")
    key = F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])
    rows = df.filter(geo.finite(F.col(value)) & v.isNotNull()).select(key.alias("_k"), (v + 0.0).alias("_v"))
    counts = rows.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    levels = [f"_r{i}" for i in range(3)] + ["_v"]
    counts = counts.withColumns(dict(zip(levels, _ranges(F.col("_v")))))
    places = F.array(*[F.struct(F.lit(name).alias("_name"), place(F.col("n")).cast("long").alias("_at")) for name, place in at.items()])
    totals = counts.groupBy("_k").agg(F.sum("_n").alias("n"))
    open_ = totals.select("_k", F.inline(places))
    for depth, level in enumerate(levels):
        sums = counts.groupBy("_k", *levels[: depth + 1]).agg(F.sum("_n").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_name").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = open_.join(sums, ["_k", *levels[:depth]]).withColumn("_before", before)
        met = met.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
        open_ = met.select("_k", "_name", (F.col("_at") - F.col("_before")).alias("_at"), *levels[: depth + 1])
    found = open_.groupBy("_k").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in at])
    return totals.join(found, "_k", "left").select(*[F.col("_k")[k].alias(k) for k in keys], "n", *at)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a linearly interpolated quantile of the finite values for each name of `shares`, as order_statistics()."""
    place = lambda p: lambda n: F.floor((n - 1) * F.lit(p))
    after = lambda p: lambda n: F.ceil((n - 1) * F.lit(p))
    at = {f"_{end}_{name}": pick(p) for name, p in shares.items() for end, pick in (("low", place), ("high", after))}
    out = order_statistics(df, keys, value, at)

    def between(name: str, p: float) -> Column:
        low, high, exact = F.col(f"_low_{name}"), F.col(f"_high_{name}"), (F.col("n") - 1) * F.lit(p)
        return F.when(low == high, low).otherwise((F.ceil(exact) - exact) * low + (exact - F.floor(exact)) * high).alias(name)

    return out.select(*keys, "n", *[between(name, p) for name, p in shares.items()])
