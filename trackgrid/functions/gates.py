"""Quality gates, scores and labels as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, finite


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def fix_sigma_m(reproj_px, mppx, ratio, n_inliers, floor: float = 15.0, ceil: float = 200.0) -> Column:
    """Sigma of a map fix: reprojection error in metres, inflated for few inliers or a low ratio."""
    px = F.when(finite(reproj_px), _c(reproj_px)).otherwise(5.0)
    low = F.greatest(F.lit(1.0), 0.30 / F.greatest(_c(ratio), F.lit(1e-6)))
    few = F.sqrt(F.greatest(F.lit(1.0), 8.0 / F.greatest(_c(n_inliers), F.lit(1))))
    return clamp(px * _c(mppx) * low * few, floor, ceil)


def fix_confidence(n, ratio, reproj_px) -> Column:
    many = 1 - F.exp(-_c(n) / 30.0)
    return many * (0.4 + 0.6 * _c(ratio)) * clamp(1 - (_c(reproj_px) - 2) / 8, 0.2, 1.0)


def track_confidence(n, ratio, reproj_px, keyframe, orb=False) -> Column:
    """Weighted mean of ratio, error and count; lower between keyframes and for binary features."""
    score = 0.5 * clamp(_c(ratio), 0, 1) + 0.3 * clamp(1 - _c(reproj_px) / 20, 0, 1) + 0.2 * clamp(_c(n) / 80, 0, 1)
    score = F.when(_c(keyframe), score).otherwise(score * 0.95)
    return F.when(_c(orb), score * 0.90).otherwise(score)


def classify_state(n, ratio, reason) -> Column:
    lost = (F.coalesce(_c(reason), F.lit("")) != "") | (_c(n) <= 0)
    return F.when(lost, "RELOCALIZE").when((_c(n) >= 30) & (_c(ratio) >= 0.30), "TRACK").otherwise("WEAK")


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, in order; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in gates])


def gate_fix(matches, inliers, ratio, scale, last_scale, inside, h_found=None) -> Column:
    """Reject reason of a map fix, the first that applies; null if accepted."""
    jump = F.greatest(_c(scale) / _c(last_scale), _c(last_scale) / _c(scale))
    return first_reason(
        (_c(matches) < 4, "too_few_matches"),
        (~_c(h_found) if h_found is not None else F.lit(False), "homography_failed"),
        (_c(inliers) < 8, "too_few_inliers"),
        (_c(ratio) < 0.15, "low_inlier_ratio"),
        (_c(last_scale).isNotNull() & (jump > 1.5), "scale_change"),
        (~_c(inside), "out_of_map"),
    )


def gate_fix_rigid(ratio, reproj_px, keyframe, u, v) -> Column:
    """Reject reason of a rigid fit: ratio and error by kind of frame, and a place within two spans of the map."""
    key = _c(keyframe)
    return first_reason(
        (_c(ratio) < F.when(key, 0.22).otherwise(0.30), "low_inlier_ratio"),
        (_c(reproj_px) > F.when(key, 18.0).otherwise(10.0), "high_reprojection"),
        ((F.abs(_c(u) - 0.5) > 2.0) | (F.abs(_c(v) - 0.5) > 2.0), "out_of_map"),
    )


def gate_peak(peak, margin, mode: str = "edges") -> Column:
    """struct<accepted,sigma_m> of a correlation peak, for edges or for masks."""
    if mode == "edges":
        ok, sigma = (_c(peak) > 0.05) & (_c(margin) > 0.005), clamp(100 * (1 - _c(margin)), 15, 200)
    else:
        ok, sigma = (_c(peak) >= 0.10) & (_c(margin) >= 0.02), 200 - 185 * clamp(_c(margin) / 0.2, 0, 1)
    return F.struct(ok.alias("accepted"), sigma.alias("sigma_m"))


def mask_unreliable(method, confidence, yaw_rate, frame_gap) -> Column:
    """Whether an exclusion mask can't be trusted: a fallback, or a weak one in a turn or far from its anchor."""
    weak = (_c(confidence) < 0.3) & ((F.abs(_c(yaw_rate)) > math.radians(2.0)) | (F.abs(_c(frame_gap)) > 60))
    return F.coalesce((_c(method) == "fallback") | weak, F.lit(False))


def gate_detection(score, cx_frac, right_frac, least: float, most_cx: float, most_right: float) -> Column:
    """struct<accepted,reason> of a detection; null under the score threshold, where it is dropped."""
    reason = first_reason((_c(cx_frac) > most_cx, "centre_too_far_right"), (_c(right_frac) > most_right, "edge_too_far_right"))
    return F.when(_c(score) >= least, F.struct(reason.isNull().alias("accepted"), reason.alias("reason")))


def hsv(r, g, b) -> Column:
    """struct<h,s,v> of 8-bit colours: hue 0-179, saturation and value 0-255."""
    r, g, b = (_c(x).cast("double") for x in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    hue = F.when(d == 0, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    return F.struct(
        F.pmod(F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2), F.lit(180.0)).alias("h"),
        F.when(v == 0, 0.0).otherwise(F.round(255 * d / v)).alias("s"), v.alias("v"),
    )


def snow_pixel(r, g, b) -> Column:
    c = hsv(r, g, b)
    return (c["v"] / 255 > 0.80) & (c["s"] / 255 < 0.15)


def sky_pixel(r, g, b) -> Column:
    return hsv(r, g, b)["h"].between(90, 130)


def keep_water(r, g, b) -> Column:
    """Whether a pixel labelled water looks like it; others become vegetation."""
    c = hsv(r, g, b)
    return (c["h"].between(85, 140) & (c["s"] >= 40) & (c["v"] >= 20)) | ((c["v"] <= 55) & (c["s"] <= 85))


def keep_water_rgb(r, g, b, over_red: int, over_green: int, most: int, dark: int) -> Column:
    """Whether a pixel predicted as water looks like it: bluer than red and green by margins and not bright, or dark."""
    r, g, b = _c(r), _c(g), _c(b)
    top = F.greatest(r, g, b)
    return ((b >= r + over_red) & (b >= g + over_green) & (top <= most)) | (top <= dark)
