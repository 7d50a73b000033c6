"""Histograms, quality reports, error statistics and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.gates import first_reason
from . import ranks


def _pct(cond: Column) -> Column:
    return F.avg(F.when(cond, 100.0).otherwise(0.0))


def _known(c) -> Column:
    """A number, or null where it is NaN or infinite."""
    return F.when(geo.finite(c), geo._c(c))


def class_hist(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, v) -> pixel_hist map<int,bigint> and non_background_ratio (six digits)."""
    counts = cells.groupBy(*keys, F.col("v").cast("int").alias("v")).agg(F.count("*").alias("n"))
    ratio = F.round(F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    hist = F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n"))))
    return counts.groupBy(*keys).agg(hist.alias("pixel_hist"), ratio.alias("non_background_ratio"))


def mask_stats(df: DataFrame, hist: str = "pixel_hist") -> DataFrame:
    """Adds dominant_ratio, n_foreground (classes above 0), structural_ratio (3 and 4) of a histogram."""
    h = F.col(hist)
    total = F.aggregate(F.map_values(h), F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda keep: F.aggregate(F.map_values(F.map_filter(h, keep)), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({
        "dominant_ratio": F.array_max(F.map_values(h)) / F.nullif(total, F.lit(0)),
        "n_foreground": F.size(F.map_filter(h, lambda k, v: (k > 0) & (v > 0))),
        "structural_ratio": part(lambda k, v: k.isin(3, 4)) / F.nullif(total, F.lit(0)),
    })


def dataset_profile(meta: DataFrame, region: str = "region_id", hist: str = "pixel_hist") -> DataFrame:
    """Pixels of each class, over all and by region (null region: over all), and their share."""
    flat = meta.select(region, F.explode(hist).alias("cls", "n"))
    sums = flat.groupingSets([[region, "cls"], ["cls"]], region, "cls").agg(F.sum("n").alias("pixels"), F.grouping(region).alias("is_total"))
    return sums.withColumn("share", F.col("pixels") / F.sum("pixels").over(Window.partitionBy(region, "is_total")))


def duplicate_groups(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """Ids that share a key, where more than one does: group_key, size, first_id. Counts combine before the shuffle."""
    out = df.select(key.alias("group_key"), F.col(id_column).alias("id")).groupBy("group_key")
    return out.agg(F.count("*").alias("size"), F.min("id").alias("first_id")).filter("size > 1")


def qc_report(tiles: DataFrame, most_dominant: float = 0.97, least_foreground: float = 0.01, least_overlap: float = 0.035) -> DataFrame:
    """Long report (check, tile_id, metric) of tiles (tile_id, missing, same_size, dominant_ratio, non_background_ratio,
    edge_overlap, image_hash, mask_hash).

    A missing file or a differing size ends a tile's checks; duplicates are reported but not rejected.
    """
    stop = F.col("missing") | ~F.col("same_size")
    sound = ~F.coalesce(stop, F.lit(True))
    checks = [
        ("missing", F.col("missing"), F.lit(None).cast("double")), ("size_mismatch", ~F.col("missing") & ~F.col("same_size"), F.lit(None).cast("double")),
        ("monoculture", sound & (F.col("dominant_ratio") >= most_dominant), F.col("dominant_ratio")),
        ("low_foreground", sound & (F.col("non_background_ratio") < least_foreground), F.col("non_background_ratio")),
        ("shifted", sound & (F.col("edge_overlap") < least_overlap), F.col("edge_overlap")),
    ]
    rows = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), m.cast("double").alias("metric"))) for n, c, m in checks])
    flags = tiles.select("tile_id", F.inline(F.array_compact(rows)))
    for name in ("image_hash", "mask_hash"):
        twice = tiles.filter(sound).groupBy(name).agg(F.count("*").alias("metric")).filter(f"metric > 1 AND {name} IS NOT NULL")
        same = tiles.filter(sound).join(twice, name)
        flags = flags.unionByName(same.select("tile_id", F.lit(f"duplicate_{name}").alias("check"), F.col("metric").cast("double").alias("metric")))
    return flags.select("check", "tile_id", "metric")


def rejected_ids(report: DataFrame) -> DataFrame:
    """Distinct tiles that a report rejects; duplicates are no reason."""
    return report.filter(~F.startswith("check", F.lit("duplicate_"))).select("tile_id").distinct()


def filter_tiles(meta: DataFrame, rejected: DataFrame, shifted: DataFrame, hist: str = "pixel_hist") -> DataFrame:
    """Adds drop_reason, the first of bad_hist, empty, monoculture, low_foreground, smeared, likely_shifted."""
    out = mask_stats(meta, hist)
    out = out.join(rejected.select("tile_id", F.lit(True).alias("_smeared")), "tile_id", "left")
    out = out.join(shifted.select("tile_id", F.lit(True).alias("_shifted")), "tile_id", "left")
    reason = first_reason(
        (F.col(hist).isNull(), "bad_hist"), (F.size(hist) == 0, "empty"), (F.col("dominant_ratio") >= 0.95, "monoculture"),
        (F.col("non_background_ratio") < 0.05, "low_foreground"), (F.col("_smeared"), "smeared"), (F.col("_shifted"), "likely_shifted"),
    )
    return out.withColumn("drop_reason", reason).drop("_smeared", "_shifted")


#: Below any count.
LOWEST = -1e300


def finite_stats(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Median, 95th percentile (linear) and mean over finite values; null if there are none."""
    v = _known(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("p95"), F.avg(v).alias("mean"))


def trajectory_kpis(log: DataFrame, keys: list[str], error: str, order: str, near: float = 100.0) -> DataFrame:
    """Error statistics of tracks and the pass rule: p95 within `near` and 80 percent of rows within it."""
    e = _known(error)
    out = log.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.median(e).alias("median_m"), F.percentile(e, 0.95).alias("p95_m"), F.avg(e).alias("mean_m"),
        F.max_by(F.col(error), F.struct(order, error)).alias("final_m"), _pct(e <= near).alias("track_pct"),
    )
    return out.withColumn("passed", F.coalesce((F.col("p95_m") <= near) & (F.col("track_pct") >= 80), F.lit(False)))


def channel_rates(log: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, accepts and percents of (attempted, accepted, valid), with at least one as divisor."""
    n = lambda c: F.count_if(F.col(c))
    return log.groupBy(*keys).agg(
        n("attempted").alias("attempts"), n("accepted").alias("accepts"),
        (100.0 * n("accepted") / F.greatest(n("attempted"), F.lit(1))).alias("accept_pct"),
        (100.0 * n("valid") / F.greatest(F.count("*"), F.lit(1))).alias("valid_pct"),
    )


def segment_kpis(log: DataFrame, keys: list[str], most_sigma: float) -> DataFrame:
    """Per segment, of rows (keys, segment_id, dead_reckoning, t, ate_m, sigma_m, accepted, obstructed).

    False fixes are all fixes of a dead-reckoning segment, else those in obstructed rows; a row is on
    track if its sigma is at most most_sigma.
    """
    ate, fix, obs = _known("ate_m"), F.col("accepted"), F.col("obstructed")
    at = F.struct("t", "sigma_m")
    out = log.groupBy(*keys, "segment_id", "dead_reckoning").agg(
        F.count("*").alias("rows"), F.count(ate).alias("gt_rows"), F.avg(ate).alias("ate_mean_m"), F.median(ate).alias("ate_median_m"),
        F.percentile(ate, 0.95).alias("ate_p95_m"), F.count_if(F.col("sigma_m") <= most_sigma).alias("track_count"),
        _pct(F.col("sigma_m") <= most_sigma).alias("track_pct"), F.count_if(fix).alias("map_fix_count"),
        F.count_if(fix & obs).alias("_in_obstruction"), F.count_if(obs).alias("obstructed_rows"),
        F.min_by("sigma_m", at).alias("sigma_start_m"), F.max_by("sigma_m", at).alias("sigma_end_m"),
    )
    false = F.when(F.col("dead_reckoning"), F.col("map_fix_count")).otherwise(F.col("_in_obstruction"))
    grew = F.coalesce(F.col("sigma_end_m") >= F.col("sigma_start_m"), F.lit(False))
    behaviour = F.when(~F.col("dead_reckoning"), "N/A").when(grew, "sigma_grew").otherwise("sigma_not_growing")
    return out.withColumn("false_fix_count", false).withColumn("dead_reckoning_behavior", behaviour).drop("_in_obstruction")


def changes(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 500_000) -> DataFrame:
    """keys, changes: how often a value differs from the one before it, in the order of a column; none counts beside a null.

    Rows are cut into ranges of about `rows` by key and order, and counted in each; only a range's first and last
    values meet those of the next one.
    """
    own = df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"))
    parts = max(1, -(-own.count() // rows))
    own = own.repartitionByRange(parts, *keys, "_o").withColumn("_part", F.spark_partition_id())
    differs = lambda w: F.coalesce(F.col("_v") != F.lag("_v").over(w), F.lit(False))
    own = own.withColumn("_new", differs(Window.partitionBy("_part", *keys).orderBy("_o")))
    ends = {name: pick(F.struct("_v"), F.struct("_o"))["_v"].alias(name) for name, pick in (("_first", F.min_by), ("_last", F.max_by))}
    ranges = own.groupBy(*keys, "_part").agg(F.count_if("_new").alias("_n"), *ends.values())
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part"))
    ranges = ranges.withColumn("_n", F.col("_n") + F.coalesce(F.col("_first") != before, F.lit(False)).cast("int"))
    return ranges.groupBy(*keys).agg(F.sum("_n").alias("changes"))


def diag_summary(diag: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of states, rejects and their counts by reason, medians (negatives as 0, NaN left out) and
    tile changes of frame diagnostics; a key may have any number of frames, see changes()."""
    n = F.greatest(F.count("*"), F.lit(1))
    states = ("TRACK", "WEAK", "RELOCALIZE")
    on = lambda s: F.count_if(F.col("state") == s)
    shares = [(100.0 * on(s) / n).alias(f"{s.lower()}_pct") for s in states] + [on(s).alias(f"{s.lower()}_count") for s in states]
    med = lambda c: F.median(F.when(_known(c) < 0, 0.0).otherwise(_known(c))).alias(f"median_{c}")
    rejected = F.coalesce(F.col("reason"), F.lit("")) != ""
    out = diag.groupBy(*keys).agg(F.count("*").alias("frames"), *shares, F.count_if(rejected).alias("rejects"), med("inliers"), med("ratio"))
    moved = changes(diag, keys, "frame", "tile").withColumnRenamed("changes", "tile_changes")
    alike = F.lit(True)
    for k in keys:
        alike = alike & out[k].eqNullSafe(moved[k])
    out = out.join(moved, alike).drop(*[moved[k] for k in keys])
    counts = diag.filter(rejected).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    reasons = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejects_by_reason"))
    return out.join(reasons, keys, "left")


def timing_stats(log: DataFrame, columns: list[str]) -> DataFrame:
    """Median and 95th percentile of each stage's positive finite times, one row a stage; see ranks.quantiles()."""
    long = log.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).cast("double").alias("ms")) for c in columns])))
    return ranks.quantiles(long.filter("ms > 0"), ["stage"], "ms", {"median_ms": 0.5, "p95_ms": 0.95}).drop("n")


def latency_stats(samples: DataFrame, keys: list[str], ms: str = "ms") -> DataFrame:
    """Interpolated median, the sample at int(0.95 n) of the sorted ones, and frames per second, of finite samples."""
    at = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2), "p95_ms": lambda n: F.floor(n * 0.95)}
    out = ranks.order_statistics(samples, keys, ms, at).withColumn("median_ms", (F.col("_low") + F.col("_high")) / 2)
    return out.select(*keys, "median_ms", "n", "p95_ms", (1000.0 / F.nullif("median_ms", F.lit(0.0))).alias("fps"))


def smoke_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Accept rate, upper median and most inliers, and the most frequent reject reason (ties by name).

    Rows without inliers are the lowest of the median, as if they had fewer than any other.
    """
    kind = log.schema["inliers"].dataType
    out = log.groupBy(*keys).agg(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("accept_rate"), F.max("inliers").alias("max_inliers"))
    least = log.withColumn("_in", F.coalesce(F.col("inliers").cast("double"), F.lit(LOWEST)))
    middle = ranks.order_statistics(least, keys, "_in", {"_in": lambda n: F.floor(n / 2)})
    middle = middle.select(*keys, F.nullif("_in", F.lit(LOWEST)).cast(kind).alias("upper_median_inliers"))
    out = out.join(middle, keys, "left")
    reasons = log.filter("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    top = reasons.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "reason"))).filter("_k = 1")
    return out.join(top.select(*keys, F.col("reason").alias("top_reject"), F.col("n").alias("top_reject_count")), keys, "left")


def shift_audit(shifts: DataFrame, most: float, region: str = "region") -> DataFrame:
    """Median, p90, p99, spread of quartiles and share over `most` of shift magnitudes, over all and by region."""
    ok = shifts.filter("status <> 'no_signal'")
    out = ok.groupingSets([[], [region]], region).agg(
        F.grouping(region).alias("is_total"), F.count("*").alias("n"), F.percentile("shift_mag", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99)))).alias("q"),
        F.avg(F.when(F.col("shift_mag") > most, 1.0).otherwise(0.0)).alias("over_share"),
    )
    q = F.col("q")
    return out.select(region, "is_total", "n", q[1].alias("median"), q[3].alias("p90"), q[4].alias("p99"), (q[2] - q[0]).alias("iqr"), "over_share")


def class_weights(hist: DataFrame) -> DataFrame:
    """(cls, pixels) -> weight: one over the root of the frequency, mean 1, within 0.25 to 4, background at most 0.5."""
    total = hist.agg(F.sum("pixels").alias("_all"))
    raw = hist.filter("pixels > 0").crossJoin(total).withColumn("_w", 1 / F.sqrt(F.col("pixels") / F.col("_all")))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    w = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("_w") / F.col("_mean")))
    w = F.when(F.col("cls") == 0, F.least(w, F.lit(0.5))).otherwise(w)
    return raw.crossJoin(mean).select("cls", "pixels", F.round(w, 4).alias("weight"))  # both right sides are one row


def class_iou(a: DataFrame, b: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """Mean IoU over classes whose union has more than `least` cells; 0 if none has. a, b: keys, r, c, v."""
    both = a.select(*keys, "r", "c", F.col("v").alias("va")).join(b.select(*keys, "r", "c", F.col("v").alias("vb")), [*keys, "r", "c"], "full_outer")
    cls = F.explode(F.array_distinct(F.array_compact(F.array("va", "vb"))))
    per = both.withColumn("cls", cls).groupBy(*keys, "cls").agg(F.count_if(F.col("va") == F.col("vb")).alias("i"), F.count("*").alias("u"))
    return per.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("u") > least, F.col("i") / F.col("u"))), F.lit(0.0)).alias("iou"))


def match_quality(matches: DataFrame, homographies: DataFrame, keys: list[str]) -> DataFrame:
    """Inliers, ratio and mean reprojection error over inliers of matches (keys, x0, y0, x1, y1, inlier)."""
    p = geo.h_apply("h", "x0", "y0")
    rows = matches.join(homographies, keys).withColumn("_e", F.hypot(p["x"] - F.col("x1"), p["y"] - F.col("y1")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("num_matches"), F.count_if("inlier").alias("num_inliers"), F.avg(F.when(F.col("inlier"), 1.0).otherwise(0.0)).alias("inlier_ratio"),
        F.avg(F.when(F.col("inlier"), F.col("_e"))).alias("reproj_px"),
    )


def rigid_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares rotation and shift of (keys, x0, y0) onto (x1, y1): theta, tx, ty, rms, from one pass of sums."""
    s = lambda e: F.sum(e)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    q = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x0).alias("mx0"), F.avg(y0).alias("my0"), F.avg(x1).alias("mx1"), F.avg(y1).alias("my1"),
        s(x0 * x1 + y0 * y1).alias("dot"), s(x0 * y1 - y0 * x1).alias("cross"), s(x0 * x0 + y0 * y0 + x1 * x1 + y1 * y1).alias("sq"),
    )
    n = F.col("n")
    q = q.withColumn("dot", F.col("dot") - n * (F.col("mx0") * F.col("mx1") + F.col("my0") * F.col("my1")))
    q = q.withColumn("cross", F.col("cross") - n * (F.col("mx0") * F.col("my1") - F.col("my0") * F.col("mx1")))
    q = q.withColumn("sq", F.col("sq") - n * sum(F.col(c) * F.col(c) for c in ("mx0", "my0", "mx1", "my1")))
    q = q.withColumn("theta", F.atan2("cross", "dot"))
    c, si = F.cos("theta"), F.sin("theta")
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - 2 * F.hypot("dot", "cross")) / n)
    return q.select(*keys, "n", "theta", (F.col("mx1") - c * F.col("mx0") + si * F.col("my0")).alias("tx"), (F.col("my1") - si * F.col("mx0") - c * F.col("my0")).alias("ty"), rms.alias("rms"))


def rigid_fit_ransac(pairs: DataFrame, keys: list[str], limit: float, hypotheses: int = 32, point: str = "i") -> DataFrame:
    """rigid_fit() over the inliers of the best two-point hypothesis; fewer than two inliers: over all points.

    Hypotheses pair points by hash: for each of them the two points of the smallest hashes, which two aggregations
    of the points find. Points meet all hypotheses in one join whose rows are counted at once; only the best
    hypothesis meets them again. No more than the points themselves is shuffled.
    """
    points = pairs.select(*keys, point, "x0", "y0", "x1", "y1")
    h = [F.xxhash64(F.lit(i), point) for i in range(hypotheses)]
    least = points.groupBy(*keys).agg(*[F.min(x).alias(f"_a{i}") for i, x in enumerate(h)])
    after = points.join(least, keys).groupBy(*keys).agg(*[F.min(F.when(x > F.col(f"_a{i}"), x)).alias(f"_b{i}") for i, x in enumerate(h)])
    drawn = F.array_compact(F.array(*[F.when((x == F.col(f"_a{i}")) | (x == F.col(f"_b{i}")), F.lit(i)) for i, x in enumerate(h)]))
    hyp = points.join(least.join(after, keys), keys).select(*points.columns, F.explode(drawn).alias("hyp"))
    hyp = hyp.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "hyp").orderBy(F.xxhash64("hyp", point), point))).filter("_k <= 2")
    fits = rigid_fit(hyp, [*keys, "hyp"]).select(*keys, "hyp", "theta", "tx", "ty")
    ex = F.cos("theta") * F.col("x0") - F.sin("theta") * F.col("y0") + F.col("tx") - F.col("x1")
    ey = F.sin("theta") * F.col("x0") + F.cos("theta") * F.col("y0") + F.col("ty") - F.col("y1")
    inside = F.hypot(ex, ey) < limit
    counts = points.join(fits, keys).groupBy(*keys, "hyp").agg(F.count_if(inside).alias("num_inliers"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct("hyp", "num_inliers"), F.struct("num_inliers", -F.col("hyp"))).alias("b")).select(*keys, "b.*")
    used = points.join(best.join(fits, [*keys, "hyp"]), keys).filter((F.col("num_inliers") < 2) | inside)
    return rigid_fit(used, keys).join(best.select(*keys, "num_inliers"), keys)


def motion_steps(fits: DataFrame, least: int = 8) -> DataFrame:
    """Body velocity -t/dt and yaw rate -theta/dt of fits (tx, ty, theta, dt, num_inliers); valid with enough inliers."""
    ok = F.coalesce((F.col("num_inliers") >= least) & (F.col("dt") > 0), F.lit(False))
    return fits.withColumn("vx", -F.col("tx") / F.col("dt")).withColumn("vy", -F.col("ty") / F.col("dt")).withColumn("yaw_rate", -F.col("theta") / F.col("dt")).withColumn("valid", ok)


def ground_motion(points: DataFrame, keys: list[str], limit: float = 1.0, least: int = 8, point: str = "i") -> DataFrame:
    """Motion of a platform from tracked image points: every key with vx, vy, yaw_rate, speed, valid and reject_reason.

    points: keys, a point's number, normalised image points xn0, yn0 before and xn1, yn1 after, and for the
    key pitch_deg, agl and dt. Both ends are cast to the ground, points above the horizon leave, and
    rigid_fit_ransac() fits the rest. Reasons: too_few_grounded, too_few_inliers.
    """
    before, after = (geo.raycast_ground(f"xn{k}", f"yn{k}", "pitch_deg", "agl") for k in (0, 1))
    cast = points.withColumn("_a", before).withColumn("_b", after)
    counts = cast.groupBy(*keys).agg(F.count("*").alias("num_tracked"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("num_grounded"), F.first("dt").alias("dt"))
    ground = cast.filter("_a IS NOT NULL AND _b IS NOT NULL").join(counts.filter(F.col("num_grounded") >= least).select(*keys), keys, "left_semi")
    pairs = ground.select(*keys, point, F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1"))
    fits = rigid_fit_ransac(pairs, keys, limit, point=point).select(*keys, "theta", "tx", "ty", "rms", "num_inliers")
    out = motion_steps(counts.join(fits, keys, "left"), least)
    reason = first_reason((F.col("num_grounded") < least, "too_few_grounded"), (F.coalesce("num_inliers", F.lit(0)) < least, "too_few_inliers"))
    return out.withColumn("speed", F.hypot("vx", "vy")).withColumn("reject_reason", reason).drop("theta", "tx", "ty")


def grid_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Median and mean inliers and accept rate of each setting, and whether it is the best by (rate, median)."""
    out = log.groupBy(*keys).agg(F.median("inliers").alias("median_inliers"), F.avg("inliers").alias("mean_inliers"), F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("accept_rate"))
    top = out.agg(F.max_by(F.struct(*keys), F.struct("accept_rate", "median_inliers", *keys)).alias("_best"))
    return out.crossJoin(top).withColumn("is_best", F.struct(*keys) == F.col("_best")).drop("_best")


def gated_score(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(1 - fallback share)^2 times the mean of the valid scores."""
    return frames.groupBy(*keys).agg((F.pow(1 - F.avg(F.when(F.col("fallback"), 1.0).otherwise(0.0)), 2) * F.coalesce(F.avg(F.when(~F.col("fallback"), F.col("score"))), F.lit(0.0))).alias("score"))


def pair_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Median ratio, median of residuals under 100 px, mean cheirality and number of pairs."""
    return pairs.groupBy(*keys).agg(F.median("ratio").alias("ratio"), F.median(F.when(F.col("residual") < 100, F.col("residual"))).alias("residual"), F.avg("cheirality").alias("cheirality"), F.count("*").alias("pairs"))


def ablation(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean over sequences of each config's medians, and percent off the baseline."""
    out = runs.groupBy("config").agg(F.avg("median_m").alias("mean_of_medians"))
    base = out.filter(F.col("config") == baseline).select(F.col("mean_of_medians").alias("_b"))
    return out.join(F.broadcast(base), how="left").withColumn("delta_pct", 100 * (F.col("mean_of_medians") - F.col("_b")) / F.col("_b")).drop("_b")


def detection_quality(flags: DataFrame, truth: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """Lag into and out of a labelled interval (t0, t1), false positives farther than `slack`, false negatives inside."""
    rows = flags.join(truth, keys)
    t, on = F.col("t"), F.col("flag")
    return rows.groupBy(*keys).agg(
        F.min(F.when((t >= F.col("t0")) & on, t - F.col("t0"))).alias("lag_in"), F.min(F.when((t >= F.col("t1")) & ~on, t - F.col("t1"))).alias("lag_out"),
        F.count_if(on & ((t < F.col("t0") - slack) | (t > F.col("t1") + slack))).alias("false_positives"),
        F.count_if(~on & t.between(F.col("t0") + slack, F.col("t1") - slack)).alias("false_negatives"),
    )


def sigma_coverage(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Share of rows with an error under 3 sigma, and whether sigma never falls."""
    before = F.lag("sigma").over(Window.partitionBy(*keys).orderBy(order))
    rows = log.withColumn("_fell", F.coalesce(F.col("sigma") < before, F.lit(False)))
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col("error") < 3 * F.col("sigma"), 1.0).otherwise(0.0)).alias("covered"), (~F.bool_or("_fell")).alias("monotone"))


def coverage(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("coverage"))


def scale_pairs(log: DataFrame, keys: list[str], least: float = 30.0) -> DataFrame:
    """Map displacement between accepted fixes (fix_x, fix_y) and the raw motion (vx, vy, dt) since, both long enough."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = log.withColumn("fix_id", F.sum(F.when(F.col("accepted"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    part = rows.filter("fix_id >= 1").groupBy(*keys, "fix_id").agg(F.sum(F.col("vx") * F.col("dt")).alias("vo_x"), F.sum(F.col("vy") * F.col("dt")).alias("vo_y"), F.max(F.when(F.col("accepted"), F.struct("fix_x", "fix_y"))).alias("end"))
    starts = rows.filter("accepted").select(*keys, (F.coalesce("fix_id", F.lit(0)) + 1).alias("fix_id"), F.struct("fix_x", "fix_y").alias("start"))
    out = part.filter("end IS NOT NULL").join(starts, [*keys, "fix_id"])
    out = out.select(*keys, "fix_id", (F.col("end.fix_x") - F.col("start.fix_x")).alias("map_x"), (F.col("end.fix_y") - F.col("start.fix_y")).alias("map_y"), "vo_x", "vo_y")
    return out.filter((F.hypot("map_x", "map_y") >= least) & (F.hypot("vo_x", "vo_y") >= least))
