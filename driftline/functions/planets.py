"""Planet dimension and rotation/wind scale factors as expressions on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .angles import as_col

# Name, equatorial km, polar km, rotation period s, distance au, wind rows (|lat|, m/s).
PLANETS = [
    ("Jupiter", 71492.0, 66854.0, 35729.711, 5.2,
     [(0.0, 5.0), (5.0, 30.0), (10.0, 50.0), (15.0, 35.0), (20.0, 18.0), (25.0, 8.0), (30.0, 2.0),
      (40.0, -5.0), (50.0, -8.0), (60.0, -5.0)]),
    ("Saturn", 60268.0, 54364.0, 37965.0, 9.5,
     [(0.0, 390.0), (5.0, 430.0), (10.0, 360.0), (15.0, 250.0), (20.0, 150.0), (30.0, 60.0), (40.0, 20.0),
      (50.0, -5.0), (60.0, -20.0), (75.0, -30.0)]),
    ("Neptune", 24764.0, 24341.0, 57996.0, 30.1,
     [(0.0, -50.0), (10.0, 80.0), (20.0, 250.0), (30.0, 400.0), (40.0, 300.0), (50.0, 150.0), (60.0, 40.0),
      (70.0, -20.0)]),
    ("Uranus", 25559.0, 24973.0, 62064.0, 19.2,
     [(0.0, -30.0), (10.0, -120.0), (20.0, -210.0), (30.0, -250.0), (40.0, -220.0), (50.0, -150.0),
      (60.0, -80.0), (75.0, -20.0)]),
    ("Mars", 3396.19, 3376.20, 88642.663, 1.52,
     [(0.0, 10.0), (15.0, 35.0), (30.0, 45.0), (45.0, 30.0), (60.0, 15.0), (75.0, 5.0)]),
]

SCHEMA = (
    "planet string, req_km double, rpol_km double, period_s double, distance_au double, "
    "wind array<struct<abs_lat:double,u:double>>"
)


def planets(spark: SparkSession) -> DataFrame:
    """Five fixed rows: always small enough to broadcast."""
    return spark.createDataFrame(PLANETS, SCHEMA)


def planet_row(name: str):
    return next(p for p in PLANETS if p[0] == name)


def with_constants(df: DataFrame, name: str) -> DataFrame:
    """One planet's row as literal columns: req_km, rpol_km, period_s and the wind table."""
    _, req, rpol, period, _, wind = planet_row(name)
    table = F.array(*[F.struct(F.lit(a).alias("abs_lat"), F.lit(u).alias("u")) for a, u in wind])
    return df.withColumns({"req_km": F.lit(req), "rpol_km": F.lit(rpol), "period_s": F.lit(period), "wind": table})


def wind_at(lat, wind="wind") -> Column:
    """Linear in |lat| between table rows, clamped at both ends."""
    la, tab = F.abs(as_col(lat)), as_col(wind)
    below = F.filter(tab, lambda r: r["abs_lat"] <= la)
    above = F.filter(tab, lambda r: r["abs_lat"] > la)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    inside = lo["u"] + (hi["u"] - lo["u"]) * (la - lo["abs_lat"]) / (hi["abs_lat"] - lo["abs_lat"])
    return F.coalesce(inside, lo["u"], hi["u"])


def rotation_rate(period_s="period_s") -> Column:
    return 360.0 / F.greatest(as_col(period_s), F.lit(1e-9))


def cloud_rate(lat, wind_mps, req_km="req_km", period_s="period_s") -> Column:
    """Degrees per second of a cloud feature: bulk rotation plus wind over the (clamped) parallel."""
    c = F.greatest(F.cos(F.radians(as_col(lat))), F.lit(0.05))
    return rotation_rate(period_s) + F.degrees(as_col(wind_mps) * 1e-3 / as_col(req_km)) / c


def parallel_factor(lat, req_km="req_km", rpol_km="rpol_km") -> Column:
    """Radius of the parallel in equatorial radii."""
    la = F.radians(as_col(lat))
    k = as_col(rpol_km) / as_col(req_km)
    return F.cos(la) / F.sqrt(F.pow(F.cos(la), 2) + F.pow(F.sin(la) / k, 2))


def px_per_deg_lon(lat, a_eq_px, req_km="req_km", rpol_km="rpol_km") -> Column:
    return (math.pi / 180.0) * parallel_factor(lat, req_km, rpol_km) * as_col(a_eq_px)


def parallel_radius_m(lat, req_km="req_km", rpol_km="rpol_km") -> Column:
    return parallel_factor(lat, req_km, rpol_km) * as_col(req_km) * 1000.0


def drift_px(lat, dt_s, a_eq_px, wind_mps) -> Column:
    return -cloud_rate(lat, wind_mps) * as_col(dt_s) * px_per_deg_lon(lat, a_eq_px)


def max_span_raw_s(lat, a_eq_px, budget_px, wind_mps) -> Column:
    speed = cloud_rate(lat, wind_mps) * px_per_deg_lon(lat, a_eq_px)
    return F.when(speed > 0, as_col(budget_px) / speed).otherwise(F.lit(float("inf")))


def max_span_derotated_s(lat, a_eq_px, budget_px, residual_mps=30.0) -> Column:
    speed = F.degrees(as_col(residual_mps) / parallel_radius_m(lat)) * px_per_deg_lon(lat, a_eq_px)
    return F.when(speed > 0, as_col(budget_px) / speed).otherwise(F.lit(float("inf")))
