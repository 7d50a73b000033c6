"""Descriptor retrieval: top-K, recall, reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _block_pairs(queries: DataFrame, gallery: DataFrame, block: int, run, kind: str) -> DataFrame:
    """run(queries, gallery) for each pair of blocks of about `block` rows: q and v are the vectors, other columns of queries stay."""
    groups = lambda df: max(1, -(-df.count() // block))
    nq, ng = groups(queries), groups(gallery)
    q = queries.withColumnRenamed("embedding", "q").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
    g = gallery.select("vec_id", F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(ng)).cast("int").alias("gb"))
    q = q.withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(ng - 1))))
    g = g.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(run, kind)


def cosine_topk(queries: DataFrame, gallery: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """(query_id, embedding) against (vec_id, embedding), unit vectors -> query_id, vec_id, score, rank.

    Scores are rounded to `digits`; ties go to the smaller vec_id. Queries and gallery are cut into
    blocks of about `block` rows; each pair of blocks is one matrix product in one task, which keeps its
    best k for each query, and a window picks the best of those. No task holds more than two blocks.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), gallery.schema["vec_id"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            vs, ids, names = _matrix(right["v"]), right["vec_id"].to_numpy(), left["query_id"].to_pylist()
            for at in range(0, left.num_rows, 512):
                scores = np.round(_matrix(left["q"].slice(at, 512)) @ vs.T, digits)
                for name, row in zip(names[at:], scores):
                    on = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    on = on[np.lexsort((ids[on], -row[on]))][:k]
                    out[0] += [name] * len(on)
                    out[1] += ids[on].tolist()
                    out[2] += row[on].tolist()
        types = (left.schema.field("query_id").type, right.schema.field("vec_id").type, pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=["query_id", "vec_id", "score"])

    found = _block_pairs(queries, gallery, block, best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def union_gallery(references: DataFrame, distractors: DataFrame, order: list[str]) -> DataFrame:
    """References, then distractors, with a contiguous index from 0."""
    both = references.withColumn("role", F.lit("reference")).unionByName(distractors.withColumn("role", F.lit("distractor")), allowMissingColumns=True)
    return with_index(both, [F.when(F.col("role") == "reference", 0).otherwise(1), *order])


def with_index(df: DataFrame, order: list, name: str = "index", parts: int = 64) -> DataFrame:
    """Rows numbered from 0 in an order: ranges are numbered apart, then shifted by the counts before them.

    The order should tell rows apart. Only the counts of the ranges, `parts` at most, meet in one task. Spark draws
    the limits of ranges anew each time that it makes them, so they are made once and kept as a checkpoint.
    """
    own = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    own = own.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else own.localCheckpoint()
    counts = own.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("_part", before.alias("_before")))
    return own.join(shifts, "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def prefix_min(ranked: DataFrame, key: str = "query_id", error: str = "error") -> DataFrame:
    """The smallest error up to each rank."""
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("best_error", F.min(error).over(w))


def recall_grid(ranked: DataFrame, ks: list[int], radii: list[float], key: str = "query_id", error: str = "error") -> DataFrame:
    """Percent of queries with an error of at most each radius among their first K, for each K and radius."""
    best = ranked.groupBy(key).agg(*[F.min(F.when(F.col("rank") <= k, F.col(error))).alias(f"e{k}") for k in ks])
    cells = [(k, r) for k in ks for r in radii]
    hits = [F.avg(F.when(F.col(f"e{k}") <= r, 100.0).otherwise(0.0)).alias(f"c{i}") for i, (k, r) in enumerate(cells)]
    rows = [F.struct(F.lit(k).alias("k"), F.lit(float(r)).alias("radius"), F.col(f"c{i}").alias("recall")) for i, (k, r) in enumerate(cells)]
    return best.agg(*hits).select(F.inline(F.array(*rows)))


def exact_pair(query_id: Column, gallery_id: Column, role: Column) -> Column:
    return F.coalesce((query_id == gallery_id) & (role == "reference"), F.lit(False))


def top1_shares(pred: DataFrame) -> DataFrame:
    """(top1_role, exact, inside) -> percents of the first hits by role, exact pairs and inside tiles."""
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return pred.agg(
        pct(F.col("top1_role") == "reference").alias("reference_pct"), pct(F.col("top1_role") == "distractor").alias("distractor_pct"),
        pct(F.col("exact")).alias("exact_pct"), pct(F.col("inside")).alias("inside_pct"),
    )


def rerank(df: DataFrame, alpha: float, key: str = "query_id", a: str = "score", b: str = "score2") -> DataFrame:
    """Blend two scores, each scaled to 0..1 within a list (0 for a range under 1e-6); equal blends keep their rank."""
    w = Window.partitionBy(key)
    part = lambda c: F.when(F.max(c).over(w) - F.min(c).over(w) < 1e-6, 0.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    out = df.withColumn("blend", alpha * part(a) + (1 - alpha) * part(b))
    return out.withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("blend"), "rank")))


def rerank_summary(df: DataFrame, radius: float, key: str = "query_id") -> DataFrame:
    """Recall of the first hits before and after, the difference in points, and both median errors."""
    first = df.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("error"))).alias("before"), F.max(F.when(F.col("new_rank") == 1, F.col("error"))).alias("after"))
    pct = lambda c: F.avg(F.when(F.col(c) <= radius, 100.0).otherwise(0.0))
    return first.agg(
        pct("before").alias("recall_before"), pct("after").alias("recall_after"), (pct("after") - pct("before")).alias("delta_pp"),
        F.median("before").alias("median_before"), F.median("after").alias("median_after"),
    )


def score_margin(scores: DataFrame, key: str = "query_id") -> DataFrame:
    """The first score less the median of all, for each query; margins() needs no list of scores."""
    return scores.groupBy(key).agg((F.max("score") - F.median("score")).alias("margin"))


#: Scores of unit vectors are counted as whole millionths from -HALF on, in ranges of FINE of them.
HALF, FINE, MILLION = 1 << 20, 1 << 10, 1_000_000


def _counted(queries: pa.Table, gallery: pa.Table) -> pa.Table:
    """For each query of a block its scores with a block of the gallery as counts: of ranges, or, once the ranges of
    the median are known (low, high), of the values in those."""
    known = "low" in queries.column_names
    n = queries.num_rows if gallery.num_rows else 0
    width = 2 * FINE if known else 2 * HALF // FINE
    counts, best = np.zeros((n, width), np.int32), np.zeros(n, np.int64)  # a block's counts, and no copy of them
    parts = np.stack([queries["low"].to_numpy(), queries["high"].to_numpy()], axis=1) if known else None
    vs = _matrix(gallery["v"]) if gallery.num_rows else None
    for at in range(0, n, 512):
        found = np.rint(_matrix(queries["q"].slice(at, 512)) @ vs.T * MILLION).astype(np.int64) + HALF
        if found.min() < 0 or found.max() >= 2 * HALF:
            raise ValueError("vectors aren't of unit length")
        for i, own in enumerate(found):
            if known:
                for j, r in enumerate(parts[at + i]):
                    counts[at + i, j * FINE : (j + 1) * FINE] = np.bincount(own[own // FINE == r] % FINE, minlength=FINE)
            else:
                counts[at + i] = np.bincount(own // FINE, minlength=width)
        best[at : at + len(found)] = found.max(axis=1)
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.table({"query_id": queries["query_id"].slice(0, n), "counts": pa.ListArray.from_arrays(ends, pa.array(counts.ravel())), "best": pa.array(best)})


def _merged(finish, names: tuple[str, ...]):
    """Rows (query_id, counts, best) in the order of queries -> finish(counts, best) of each, summed as they come."""

    def run(batches):
        at, total, best, out = None, None, 0, []
        for batch in batches:
            for q, counts, b in zip(batch["query_id"].to_pylist(), batch["counts"], batch["best"].to_pylist()):
                counts = counts.values.to_numpy()
                if total is None or q != at:
                    if total is not None:
                        out.append((at, *finish(total, best)))
                    at, total, best = q, counts.astype(np.int64), b
                else:
                    total += counts
                    best = max(best, b)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", *names), r)) for r in out])
                out = []
        if total is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", *names), (at, *finish(total, best))))])

    return run


def margins(queries: DataFrame, gallery: DataFrame, block: int = 4096) -> DataFrame:
    """(query_id, embedding) against (vec_id, embedding), unit vectors -> query_id, margin: the best score less the median of
    all, of scores rounded to six digits.

    Exact, in two passes over pairs of blocks. The first counts a query's scores by ranges, the second the
    values in the one or two ranges where the middle ranks fall; counts of blocks add up. A pair of blocks
    gives one row of constant size for each query, and a merging task holds one.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    counts = f"query_id {kind}, counts array<int>, best bigint"
    merge = lambda df, finish, names, kinds: df.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(finish, names), f"query_id {kind}, {kinds}")

    def ranges(total: np.ndarray, best: int) -> tuple:
        """The ranges of both middle ranks, these ranks among the values of the two ranges, and the best score."""
        upto, n = np.cumsum(total), int(total.sum())
        low, high = (int(np.searchsorted(upto, r, "right")) for r in ((n - 1) // 2, n // 2))
        before = [int(upto[r] - total[r]) for r in (low, high)]
        return low, high, (n - 1) // 2 - before[0], n // 2 - before[1]

    first = merge(_block_pairs(queries.select("query_id", "embedding"), gallery, block, _counted, counts), ranges, ("low", "high", "i", "j"), "low bigint, high bigint, i bigint, j bigint")

    def values(total: np.ndarray, best: int) -> tuple:
        return total.tolist(), best

    second = _block_pairs(queries.select("query_id", "embedding").join(first, "query_id"), gallery, block, _counted, counts)
    fine = merge(second, values, ("counts", "best"), "counts array<bigint>, best bigint").join(first, "query_id")

    def middle(part: int, rank: str) -> Column:
        """The place in a range of the value of that rank."""
        own = F.slice("counts", part * FINE + 1, FINE)
        step = lambda s, n: F.struct((s["seen"] + n).alias("seen"), (s["at"] + F.when(s["seen"] + n <= F.col(rank), 1).otherwise(0)).alias("at"))
        return F.aggregate(own, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at")), step)["at"]

    value = lambda v: (v - HALF) / float(MILLION)
    low, high = value(F.col("low") * FINE + middle(0, "i")), value(F.col("high") * FINE + middle(1, "j"))
    return fine.select("query_id", (value(F.col("best")) - (low + high) / 2).alias("margin"))


def hop_consistency(pred: DataFrame, distance: Column, most: float = 2800.0, least_pct: float = 70.0) -> DataFrame:
    """Share of hops, `distance` of a row to the one before, of at most `most` metres, and whether it is enough."""
    share = F.avg(F.when(distance <= most, 100.0).when(distance.isNotNull(), 0.0))
    return pred.agg(share.alias("near_pct"), (share >= least_pct).alias("consistent"))

