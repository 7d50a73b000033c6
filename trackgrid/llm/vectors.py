"""Exact top-k inner products through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v binary (floor(scale * x) as doubles), norm2 double.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, are left out.
    Vectors shorter than the longest are padded by zeros.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(F.exists("e", odd), F.lit(False))
    )
    d = kept.agg(F.max(F.size("e"))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch["e"]
            n = np.diff(e.offsets.to_numpy())
            out = np.zeros((len(e), d))
            out[np.repeat(np.arange(len(e)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = e.flatten().to_numpy()
            out = np.floor(scale * out) + 0.0
            packed = [x.tobytes() for x in out]
            norm2 = pa.array((out * out).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "v": pa.array(packed, pa.binary()), "norm2": norm2})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, v binary, norm2 double")


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1) if len(packed) else np.zeros((0, 1))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of a sample."""
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int) -> list[tuple]:
    """For each query the k largest (score, smaller id first) among vectors, itself left out."""
    out = []
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ vectors.T
        for q, row in zip(qids[at : at + 256], scores):
            row = np.where(ids == q, -np.inf, row)
            if len(row) > k:
                on = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            else:
                on = np.arange(len(row))
            on = on[np.lexsort((ids[on], -row[on]))][:k]
            on = on[np.isfinite(row[on])]
            out += [(q, i, int(s)) for i, s in zip(ids[on].tolist(), row[on].tolist())]
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of points and pivots, a row a point."""
    out = np.empty((len(points), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((points - p) ** 2).sum(axis=1))
    return out


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, cell_rows: int = 8192, query_rows: int = 4096, sample: int = 4096,
    most_pivots: int = 1024,
) -> DataFrame:
    """Queries, the rows whose vec_id is divisible by `every`, against all rows: query_id, rank, vec_id, score.

    score is the inner product of the quantised vectors; ties go to the smaller vec_id; rows with a
    query's own vec_id are not its candidates. Exact while scores stay below 2**53. An empty table gives
    an empty result; rows that share a vec_id are all candidates of others, and such a query counts once.

    A further component sqrt(most - norm2) turns the largest inner product into the smallest distance.
    Pivots and the limits of annuli come from at most `sample` rows (the only thing that is sampled), a pivot
    for every `cell_rows` rows; there are at most as many annuli as sampled rows, so what the driver and a
    task hold of them does not grow with the table. Every vector is keyed by its nearest pivot and the
    annulus of its distance to it. Each query first
    searches the annulus nearest to its own circle, then the next nearest one, two, four and so on, each
    time with the k-th score so far as a bound: by the triangle inequality annuli beyond it, and rows of
    an annulus beyond it, are skipped, and a query ends when none is left. Annuli are split by hash into
    parts of about `cell_rows` rows and queries into groups of about `query_rows`; only parts and groups
    that meet are sent to each other. Of equal vectors, only the k + 1 smallest ids can appear in any
    result; the others leave before the search.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    same = Window.partitionBy("v").orderBy("vec_id")
    base = stored(rows.withColumn("rn", F.row_number().over(same)).filter(F.col("rn") <= k + 1).drop("rn"))
    n, most = base.agg(F.count("*"), F.max("norm2")).first()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    queries = stored(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]))
    groups = max(1, -(-queries.count() // query_rows))
    taken = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    points = np.column_stack([_matrix(taken["v"]), np.sqrt(np.maximum(most - taken["norm2"], 0))])
    pivots = choose_pivots(points, int(np.clip(n // cell_rows, 1, most_pivots)))
    near = distances(points, pivots)
    rings = int(np.clip(n // (cell_rows * len(pivots)), 1, max(1, len(points) // len(pivots))))
    edges = [np.quantile(own, np.arange(1, rings) / rings) if len(own := near[near.argmin(axis=1) == c, c]) else np.zeros(rings - 1) for c in range(len(pivots))]

    def place(frame: pd.DataFrame, extra: bool) -> np.ndarray:
        v = _matrix(frame["v"])
        last = np.sqrt(np.maximum(most - frame["norm2"].to_numpy(), 0)) if extra else np.zeros(len(v))
        return distances(np.column_stack([v, last]), pivots)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = place(frame, True)
            c = d.argmin(axis=1)
            dist = d[np.arange(len(c)), c]
            ring = np.array([np.searchsorted(edges[p], x) for p, x in zip(c, dist)], int)
            yield frame.assign(cell=(c * rings + ring).astype("int32"), dist=dist)

    indexed = stored(base.mapInPandas(index, f"vec_id {kind}, v binary, norm2 double, cell int, dist double"))
    bounds = indexed.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).collect()  # one row an annulus
    low, high = np.full(len(pivots) * rings, np.inf), np.full(len(pivots) * rings, -np.inf)
    parts = np.ones(len(low), np.int64)
    for r in bounds:
        low[r["cell"]], high[r["cell"]], parts[r["cell"]] = r["lo"], r["hi"], -(-r["n"] // cell_rows)
    filled = np.isfinite(low)
    part_of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)

    def route(first: int, last: int):
        """The annuli that queries visit: those from the first to the last in the order of their gap, if within reach."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for at in range(0, len(whole), 256):
                    frame = whole.iloc[at : at + 256]
                    to = np.repeat(place(frame, False), rings, axis=1)
                    gap = np.where(filled, np.maximum(np.maximum(to - high, low - to), 0), np.inf)
                    reach = np.sqrt(np.maximum(frame["norm2"].to_numpy() + most - 2 * frame["least"].to_numpy(), 0))
                    reach = reach[:, None] + 1e-6 + 1e-9 * to  # rounding never skips a tie
                    turn = gap.argsort(axis=1, kind="stable")[:, first:last]
                    q = np.repeat(np.arange(len(turn)), turn.shape[1])
                    c = turn.ravel()
                    on = (gap[q, c] <= reach[q, c]) & np.isfinite(gap[q, c])
                    q, c = q[on], c[on]
                    yield frame.iloc[q].drop(columns="least").assign(cell=c.astype("int32"), toward=to[q, c], reach=reach[q, c])

        return run

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("dist")
            v, ids, dist = _matrix(right["v"]), right["vec_id"].to_numpy(), right["dist"].to_numpy()
            left = left.sort_values("toward")
            for at in range(0, len(left), 512):
                part = left.iloc[at : at + 512]
                a = np.searchsorted(dist, (part["toward"] - part["reach"]).min())
                b = np.searchsorted(dist, (part["toward"] + part["reach"]).max(), "right")
                found += _best(_matrix(part["v"]), v[a:b], ids[a:b], part["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = None
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    sent = f"vec_id {kind}, v binary, norm2 double, cell int, toward double, reach double"
    keys, first, width = ["cell", "part", "grp"], 0, 1
    while first < filled.sum():
        known = queries.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            least = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
            known = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        visits = known.mapInPandas(route(first, first + width), sent).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
        visits = stored(visits)
        if not visits.isEmpty():
            meet = visits.select("cell", F.col("grp").alias("g")).distinct()
            held = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), part_of).cast("int")).join(meet, "cell")
            held = held.select("vec_id", "v", "dist", F.col("cell").alias("cell"), "part", F.col("g").alias("grp"))
            asked = visits.withColumn("part", F.explode(F.sequence(F.lit(0), (part_of - 1).cast("int"))))
            found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, f"query_id {kind}, vec_id {kind}, score long")
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        elif best is not None:
            break
        first, width = first + width, max(1, 2 * width if first else 1)
    return best.select("query_id", "rank", "vec_id", "score")
