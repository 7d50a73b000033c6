"""Cells of grids over the counts of segments: sets of near sizes share one for certain."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Parts of each first-level partition, all but one of which make a signature (three parts give half as many signatures
#: again, of more members each); and partitions more than needed, at least.
PARTS, SPARE = 2, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MORE
    return x ^ x >> np.uint64(29)


@lru_cache(maxsize=4096)
def bands(n: int, percent: int) -> tuple[tuple[int, int], ...]:
    """The size bands (number, most differing members) in which a set of n meets others: its own and the next one.

    A band ends where sizes over its first one divided by the similarity begin, so similar sets are in one
    band or in two that follow. Sets of sizes a and b differ in at most (a + b) (1 - s) / (1 + s) members.
    """
    low, number = 1, 0
    while True:
        high = 100 * low // percent
        if n <= high:
            break
        low, number = high + 1, number + 1
    above = 100 * (high + 1) // percent
    return tuple((j, 2 * most * (100 - percent) // (100 + percent)) for j, most in ((number, high), (number + 1, above)))


def signatures(own: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Hashes of which two sorted sets (of nearcopies.shingles) share one if their similarity is at least `percent`.

    Members may repeat: a signature is the sum of its members' hashes, so it stands for how often each occurs, and sets
    count as many differing members as their counts differ in sum.

    In a band, sets differ in at most k members. The features fall in (k + 1) / 2 partitions, rounded up, and
    some to spare, each of PARTS parts. Two sets differ by one member at most in at least one partition more
    than those to spare, and there in one part at most, so they agree on all others: every choice of all parts but
    one is a signature. Choices without members are none, as most sets would share them. That is safe as
    long as no more partitions of one of the sets have such a choice than there are to spare. A set with more of them
    also has, for each, the hashes of the rest of the partition whole and without each member: two
    rests that differ by one member share one. Bands in which k is zero need no signature.
    frequent: sorted members of many sets. Choices of none but such members are left out like those
    without any, but only where no more partitions have one than there are to spare: of a partition that agrees
    both sets leave out the same choices.
    """
    out = []
    u = own.view(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(u * _ODD))])
    scarce = None if frequent is None or not len(frequent) else frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] != u
    for band, k in bands(len(own), percent):
        if not k:
            continue
        n1 = (k + 2) // 2
        spare = SPARE + n1 // 50 if k > 2 * SPARE else 0
        n1 += spare
        parts = n1 * PARTS
        ends = np.searchsorted((u >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
        part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, PARTS)
        filled = np.diff(ends).reshape(n1, PARTS)
        held = filled.sum(axis=1, keepdims=True) - filled  # members of the choice that leaves a part out
        if scarce is not None and spare:
            rare = np.concatenate([[0], np.cumsum(scarce)])
            rare = (rare[ends[1:]] - rare[ends[:-1]]).reshape(n1, PARTS)
            known = rare.sum(axis=1, keepdims=True) == rare  # choices without rare members
            if known.any(axis=1).sum() <= spare:
                held = np.where(known, 0, held)
        salt = _mixed(np.arange(n1, dtype=np.uint64) + np.uint64(band << 32))
        for left in range(PARTS):  # the part that may differ
            whole, some = np.zeros(n1, np.uint64), held[:, left] > 0
            for c in range(PARTS):
                if c != left:
                    whole = whole * _ODD + part[:, c]
            out.append(_mixed(whole + salt * np.uint64(2 * left + 1))[some])
        empty = [(j, left) for left in range(PARTS) for j in np.flatnonzero(filled.sum(axis=1) == filled[:, left])]
        if len({j for j, _ in empty}) > spare:
            for j, left in empty:
                at = slice(ends[j * PARTS + left], ends[j * PARTS + left + 1])
                variants = part[j, left] - np.append(_mixed(u[at] * _ODD), np.uint64(0))
                out.append(_mixed(variants + salt[j : j + 1] * np.uint64(2 * (PARTS + left) + 1)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a token with the next one, from rows (token, k) in the order of tokens."""
    last = np.empty((2, 0), np.int64)
    for batch in batches:
        token, k = np.concatenate([last, np.stack([batch["token"].to_numpy(), batch["k"].to_numpy()])], axis=1)
        on = token[1:] == token[:-1]
        pairs = np.unique(np.stack([k[:-1][on], k[1:][on]]), axis=1)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})
        last = np.stack([token[-1:], k[-1:]])


def crowds(cells: DataFrame) -> DataFrame:
    """(token, k) of tokens of several sets -> (token, k) with fewer rows, in which the same sets share a token, or more.

    Copies share most of their signatures, and all of a crowd share some. Sets that tokens connect are one
    crowd: where all its pairs are no more than those within its tokens, the crowd is its only token.
    """
    edges = stored(cells.repartition("token").sortWithinPartitions("token", "k").mapInArrow(_chained, "a long, b long").distinct())
    roots = components(edges).withColumnRenamed("id", "k")
    per = cells.join(roots, "k").groupBy("token").agg(F.count("*").cast("double").alias("c"), F.min("root").alias("root"))
    cost = per.groupBy("root").agg(F.sum(F.col("c") * F.col("c")).alias("cost"))
    whole = roots.groupBy("root").agg(F.count("*").cast("double").alias("all")).join(cost, "root")
    whole = roots.join(whole.select("root", (F.col("all") * F.col("all") <= F.col("cost")).alias("one")), "root")
    single = whole.filter("one").select(F.col("root").alias("token"), "k")
    return single.unionByName(cells.join(whole.filter("NOT one").select("k"), "k", "left_semi").select("token", "k"))
