"""Tiles, frames, distances and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of the local sphere, radius of the haversine sphere.
M_PER_DEG, EARTH_M = 111_320.0, 6_371_000.0
#: WGS84 semi-major axis and flattening.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def deg2tile(lat, lon, z) -> Column:
    """struct<z,x,y> of the slippy tile that holds a point; fractions are truncated."""
    n = F.pow(F.lit(2.0), _c(z))
    x = ((_c(lon) + 180.0) / 360.0 * n).cast("int")
    y = ((1.0 - F.asinh(F.tan(F.radians(_c(lat)))) / math.pi) / 2.0 * n).cast("int")
    return F.struct(_c(z).cast("int").alias("z"), x.alias("x"), y.alias("y"))


def tile_bbox(z, x, y) -> Column:
    """struct<w,s,e,n> of a tile in degrees."""
    n = F.pow(F.lit(2.0), _c(z))
    lon = lambda t: t / n * 360.0 - 180.0
    lat = lambda t: F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * t / n))))
    return F.struct(
        lon(_c(x)).alias("w"), lat(_c(y) + 1).alias("s"), lon(_c(x) + 1).alias("e"), lat(_c(y)).alias("n")
    )


def tile_center(z, x, y) -> Column:
    """struct<lat,lon>: the mean of a tile's edges."""
    b = tile_bbox(z, x, y)
    return F.struct(((b["s"] + b["n"]) / 2).alias("lat"), ((b["w"] + b["e"]) / 2).alias("lon"))


def tile_key(z, x, y, sep: str = "_") -> Column:
    return F.concat_ws(sep, _c(z), _c(x), _c(y))


def parse_tile_key(key, sep: str = "_") -> Column:
    """struct<z,x,y> from its text; null if a part is no integer."""
    parts = F.split(_c(key), "\\" + sep)
    return F.struct(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("int").alias(c) for i, c in enumerate("zxy")])


def to_enu(lat, lon, alt, lat0, lon0, alt0) -> Column:
    """struct<x_e,y_n,z_u> in metres about an anchor."""
    k = F.cos(F.radians(_c(lat0))) * M_PER_DEG
    return F.struct(
        ((_c(lon) - _c(lon0)) * k).alias("x_e"), ((_c(lat) - _c(lat0)) * M_PER_DEG).alias("y_n"), (_c(alt) - _c(alt0)).alias("z_u")
    )


def to_wgs84(x_e, y_n, z_u, lat0, lon0, alt0) -> Column:
    """struct<lat,lon,alt>: the inverse of to_enu()."""
    k = F.cos(F.radians(_c(lat0))) * M_PER_DEG
    return F.struct(
        (_c(lat0) + _c(y_n) / M_PER_DEG).alias("lat"), (_c(lon0) + _c(x_e) / k).alias("lon"), (_c(alt0) + _c(z_u)).alias("alt")
    )


def cov_to_deg(cov, lat0) -> Column:
    """2x2 ENU covariance (row-major array) in square degrees, in the order lat, lon; cross terms stay."""
    kx, ky = 1 / (F.cos(F.radians(_c(lat0))) * M_PER_DEG), F.lit(1 / M_PER_DEG)
    c = _c(cov)
    return F.array(c[3] * ky * ky, c[2] * ky * kx, c[1] * kx * ky, c[0] * kx * kx)


def dist_local_m(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance with the cosine of the mean latitude."""
    mid = F.radians((_c(lat1) + _c(lat2)) / 2)
    return F.hypot((_c(lat2) - _c(lat1)) * M_PER_DEG, (_c(lon2) - _c(lon1)) * M_PER_DEG * F.cos(mid))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(_c(lat2) - _c(lat1)) / 2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(
        F.radians(_c(lat2))
    ) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def finite(x) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    x = _c(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def dist_ecef_m(a: list, b: list) -> Column:
    """Distance of two earth-centred points; infinite if a coordinate is missing or not finite."""
    d = F.sqrt(sum((_c(p) - _c(q)) * (_c(p) - _c(q)) for p, q in zip(a, b)))
    ok = finite(a[0])
    for x in [*a[1:], *b]:
        ok = ok & finite(x)
    return F.when(ok, d).otherwise(F.lit(float("inf")))


def ecef_to_wgs84(x, y, z) -> Column:
    """struct<lat,lon,h>: one Bowring step."""
    x, y, z = _c(x), _c(y), _c(z)
    b = WGS84_A * (1 - WGS84_F)
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = (WGS84_A**2 - b**2) / b**2
    p = F.hypot(x, y)
    theta = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(theta), 3), p - e2 * WGS84_A * F.pow(F.cos(theta), 3))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(lat) - n).alias("h"))


def utm_epsg(w, s, e, n) -> Column:
    """EPSG code of the UTM zone of a bbox centre."""
    zone = F.floor(((_c(w) + _c(e)) / 2 + 180) / 6).cast("int") + 1
    return F.when((_c(s) + _c(n)) / 2 >= 0, 32600).otherwise(32700) + zone


def metres_per_pixel(w, s, e, n, width, height) -> Column:
    """The larger of the two axes' metres per pixel."""
    mid = F.radians((_c(s) + _c(n)) / 2)
    return F.greatest(
        F.abs(_c(e) - _c(w)) * M_PER_DEG * F.cos(mid) / _c(width), F.abs(_c(n) - _c(s)) * M_PER_DEG / _c(height)
    )


def pixel_to_geo(px, py, w, s, e, n, width, height) -> Column:
    """struct<lat,lon> of a pixel; rows run down."""
    width, height = F.greatest(_c(width), F.lit(1e-9)), F.greatest(_c(height), F.lit(1e-9))
    return F.struct(
        (_c(n) - _c(py) / height * (_c(n) - _c(s))).alias("lat"), (_c(w) + _c(px) / width * (_c(e) - _c(w))).alias("lon")
    )


def geo_to_pixel(lat, lon, w, s, e, n, width, height) -> Column:
    """struct<px,py>: the inverse of pixel_to_geo()."""
    return F.struct(
        ((_c(lon) - _c(w)) / F.greatest(_c(e) - _c(w), F.lit(1e-12)) * _c(width)).alias("px"),
        ((_c(n) - _c(lat)) / F.greatest(_c(n) - _c(s), F.lit(1e-12)) * _c(height)).alias("py"),
    )


def bbox_around(lat, lon, span_m) -> Column:
    """struct<w,s,e,n> of a square of span_m metres about a point."""
    dlat = _c(span_m) / 2 / M_PER_DEG
    dlon = _c(span_m) / 2 / (M_PER_DEG * F.cos(F.radians(_c(lat))))
    return F.struct((_c(lon) - dlon).alias("w"), (_c(lat) - dlat).alias("s"), (_c(lon) + dlon).alias("e"), (_c(lat) + dlat).alias("n"))


def clip_window(x0, y0, x1, y1, width, height) -> Column:
    """struct<x0,y0,x1,y1>: a crop window inside a picture."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(_c(v).cast("int"), _c(most).cast("int")))
    return F.struct(inside(x0, width).alias("x0"), inside(y0, height).alias("y0"), inside(x1, width).alias("x1"), inside(y1, height).alias("y1"))


def norm_epoch_s(stamp, fallback) -> Column:
    """Seconds of a text or number; values over 1e10 are milliseconds, others that don't parse take the fallback."""
    v = _c(stamp).try_cast("double")
    v = F.when(finite(v), v)
    return F.coalesce(F.when(v > 1e10, v / 1000.0).otherwise(v), _c(fallback).cast("double"))


def wrap_pi(angle) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(_c(angle) + math.pi, F.lit(2 * math.pi)) - math.pi


def body_to_enu(vx, vy, yaw, scale=1.0) -> Column:
    """struct<vx_e,vy_n>: forward and right velocity, scaled and turned by yaw from north."""
    vx, vy, s, c = _c(vx) * _c(scale), _c(vy) * _c(scale), F.sin(_c(yaw)), F.cos(_c(yaw))
    return F.struct((vx * s + vy * c).alias("vx_e"), (vx * c - vy * s).alias("vy_n"))


def bank_deg(speed, yaw_rate) -> Column:
    """Bank of a coordinated turn; 0 below 5 m/s or half a degree a second."""
    still = (_c(speed) < 5.0) | (F.abs(_c(yaw_rate)) < math.radians(0.5))
    return F.when(still, 0.0).otherwise(F.degrees(F.atan(_c(speed) * _c(yaw_rate) / 9.81)))


def view_to_platform(lat, lon, yaw, agl, pitch_deg) -> Column:
    """struct<lat,lon>: from the centre of the view back to the platform."""
    steep = F.abs(_c(pitch_deg))
    ahead = F.when(steep >= 89.9, 0.0).otherwise(_c(agl) / F.tan(F.radians(steep)))
    return F.struct(
        (_c(lat) - ahead * F.cos(_c(yaw)) / M_PER_DEG).alias("lat"),
        (_c(lon) - ahead * F.sin(_c(yaw)) / (M_PER_DEG * F.cos(F.radians(_c(lat))))).alias("lon"),
    )


def raycast_ground(xn, yn, pitch_deg, agl) -> Column:
    """struct<x,y> on the ground plane, body frame, of a normalised image point; null above the horizon."""
    c, s = F.cos(F.radians(_c(pitch_deg))), F.sin(F.radians(_c(pitch_deg)))
    down, ahead = _c(yn) * c - s, _c(yn) * s + c
    return F.when(down > 1e-6, F.struct((ahead * _c(agl) / down).alias("x"), (_c(xn) * _c(agl) / down).alias("y")))


def h_apply(h, x, y) -> Column:
    """struct<x,y>: a point under a homography (row-major array of nine)."""
    h, x, y = _c(h), _c(x), _c(y)
    w = h[6] * x + h[7] * y + h[8]
    return F.when(w != 0, F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y")))


def h_scale(h) -> Column:
    """Root of the determinant of the linear part; null if that is not positive."""
    h = _c(h)
    det = h[0] * h[4] - h[1] * h[3]
    return F.when(det > 0, F.sqrt(det))


def h_nadir(pitch_deg, agl, span_m, out_w, out_h, fx, fy, cx, cy, roll_deg=0.0) -> Column:
    """Homography from a camera's picture to a view straight down of span_m metres, as nine numbers.

    The nadir camera times the inverse of the tilt and roll times the inverse of the camera matrix; the
    view centre, agl / tan|pitch| ahead, is in the middle.
    """
    pitch, agl, out_w, out_h = _c(pitch_deg), _c(agl), _c(out_w), _c(out_h)
    f = out_w * agl / _c(span_m)
    ahead = F.when(F.abs(pitch) < 89.9, agl / F.tan(F.radians(F.abs(pitch)))).otherwise(0.0)
    px, py = out_w / 2, out_h / 2 - f * ahead / agl
    c, s = F.cos(F.radians(90.0 + pitch)), F.sin(F.radians(90.0 + pitch))
    cr, sr = F.cos(F.radians(_c(roll_deg))), F.sin(F.radians(_c(roll_deg)))
    turn = [(cr, sr * c, sr * s), (-sr, cr * c, cr * s), (F.lit(0.0), -s, c)]
    fx, fy, cx, cy = _c(fx), _c(fy), _c(cx), _c(cy)
    rows = [[f * x + px * z for x, z in zip(turn[0], turn[2])], [f * y + py * z for y, z in zip(turn[1], turn[2])], turn[2]]
    out = []
    for a, b, d in rows:
        out += [a / fx, b / fy, d - a * cx / fx - b * cy / fy]
    return F.array(*out)


def bbox_contains(w, s, e, n, lat, lon) -> Column:
    """Whether a closed box holds a point."""
    return _c(lat).between(_c(s), _c(n)) & _c(lon).between(_c(w), _c(e))
