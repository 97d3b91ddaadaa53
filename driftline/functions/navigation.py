"""Pixels to planet longitude/latitude and back, given disk centre, scale, tilt and position angle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import FLATTENING, as_col, clip, wrap_deg


def body_xyz(lon_rel, lat, flattening=FLATTENING) -> tuple[Column, Column, Column]:
    lo, la = F.radians(as_col(lon_rel)), F.radians(as_col(lat))
    k = 1.0 - as_col(flattening)
    r = 1.0 / F.sqrt(F.pow(F.cos(la), 2) + F.pow(F.sin(la) / k, 2))
    return r * F.cos(la) * F.sin(lo), r * F.sin(la), r * F.cos(la) * F.cos(lo)


def lonlat_to_pixel(lon_rel, lat, xc, yc, a_eq_px, sub_lat=0.0, north_pa=0.0, flattening=FLATTENING):
    """(x, y, z): z above zero is the visible side."""
    bx, by, bz = body_xyz(lon_rel, lat, flattening)
    d, pa = F.radians(as_col(sub_lat)), F.radians(as_col(north_pa))
    ty, tz = by * F.cos(d) - bz * F.sin(d), by * F.sin(d) + bz * F.cos(d)
    sx, sy = bx * F.cos(pa) - ty * F.sin(pa), bx * F.sin(pa) + ty * F.cos(pa)
    return as_col(xc) + sx * as_col(a_eq_px), as_col(yc) - sy * as_col(a_eq_px), tz


def pixel_to_lonlat(x, y, xc, yc, a_eq_px, cm=0.0, sub_lat=0.0, north_pa=0.0, flattening=FLATTENING):
    """(lon, lat, on_disk). Off-limb pixels are pulled back along the radius to just inside the unit circle."""
    s = as_col(a_eq_px) + 1e-12
    ux, uy = (as_col(x) - as_col(xc)) / s, (as_col(yc) - as_col(y)) / s
    pa, d = F.radians(as_col(north_pa)), F.radians(as_col(sub_lat))
    px, py = ux * F.cos(pa) + uy * F.sin(pa), -ux * F.sin(pa) + uy * F.cos(pa)
    cd, sd = F.cos(d), F.sin(d)
    q = 1.0 / F.pow(1.0 - as_col(flattening), 2)
    a = cd * cd + sd * sd * q

    def roots(vx: Column, vy: Column):
        b = 2.0 * vy * sd * cd * (q - 1.0)
        c = vx * vx + vy * vy * (cd * cd * q + sd * sd) - 1.0
        return b, b * b - 4.0 * a * c

    _, disc0 = roots(px, py)
    on_disk = disc0 >= 0.0
    shrink = F.when(on_disk, F.lit(1.0)).otherwise(0.999999 / F.greatest(F.hypot(px, py), F.lit(1e-12)))
    vx, vy = px * shrink, py * shrink
    b, disc = roots(vx, vy)
    depth = (-b + F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2.0 * a)
    by, bz = vy * cd + depth * sd, -vy * sd + depth * cd
    radius = F.sqrt(vx * vx + by * by + bz * bz)
    lat = F.degrees(F.asin(clip(by / (radius + 1e-15), -1.0, 1.0)))
    return wrap_deg(as_col(cm) + F.degrees(F.atan2(vx, bz))), lat, on_disk


def emission_cosine(lon_rel, lat, sub_lat=0.0, flattening=FLATTENING) -> Column:
    x, y, z = body_xyz(lon_rel, lat, flattening)
    ny = y / F.pow(1.0 - as_col(flattening), 2)
    d = F.radians(as_col(sub_lat))
    norm = F.sqrt(x * x + ny * ny + z * z) + 1e-12
    return clip((ny * F.sin(d) + z * F.cos(d)) / norm, 0.0, 1.0)


def map_to_lonlat(cx, cy, width: int, height: int, cm, lat_top, lat_bottom) -> tuple[Column, Column]:
    """Map column/row to lon/lat: the relative longitude is interpolated and clamped, wrapping comes last."""
    rel = clip(-90.0 + as_col(cx) / max(width - 1, 1) * 180.0, -90.0, 90.0)
    step = (as_col(lat_bottom) - as_col(lat_top)) / max(height - 1, 1)
    return wrap_deg(as_col(cm) + rel), as_col(lat_top) + as_col(cy) * step
