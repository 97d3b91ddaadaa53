"""Time scales, rotation systems and approximate geometry. Instants are BIGINT microseconds since 1970 UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import AU_KM, REQ_KM, ROTATION_PERIOD_S, as_col, wrap_deg, wrap_diff

MJD_UNIX = 40587.0
MJD_J2000 = 51544.5
DAY_US = 86_400_000_000
LIGHT_KM_S = 299792.458

# Fixed values: (date, TAI-UTC seconds).
LEAP_SECONDS = [
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13),
    ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17),
    ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21),
    ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25),
    ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29),
    ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33),
    ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
]

# Prime meridian at J2000 (deg) and rate (deg/day) per rotation system.
SYSTEMS = {"I": (67.1, 877.900), "II": (43.3, 870.270), "III": (284.95, 870.536)}

# Drift-model anchor instant (2023-01-13), longitude and daily rate.
ANCHOR_US = 1673568000000000
ANCHOR_LON = 350.5
ANCHOR_RATE = 0.31


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), as_col(ts))


def tai_minus_utc(ts) -> Column:
    """Seconds from the last table row not after the instant; 10 before the first row.

    The 28-row table is folded into the expression, so the range lookup costs no join.
    """
    out = F.lit(10.0)
    for since, tai in LEAP_SECONDS:
        out = F.when(as_col(ts) >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz"), F.lit(float(tai))).otherwise(out)
    return out


def mjd_utc(t_us) -> Column:
    return as_col(t_us) / F.lit(float(DAY_US)) + MJD_UNIX


def tt_mjd(ts) -> Column:
    return mjd_utc(epoch_us(ts)) + (tai_minus_utc(ts) + 32.184) / 86400.0


def tdb_mjd(tt) -> Column:
    g = F.radians(357.53 + 35999.050 * ((as_col(tt) - MJD_J2000) / 36525.0))
    return as_col(tt) + (0.001657 * F.sin(g) + 0.000022 * F.sin(g + g)) / 86400.0


def j2000_days(ts) -> Column:
    return tt_mjd(ts) - MJD_J2000


def prime_meridian_deg(ts, system: str) -> Column:
    w0, rate = SYSTEMS[system]
    return w0 + rate * j2000_days(ts)


def system_offset_deg(ts, system: str) -> Column:
    """Meridian of `system` minus that of system III."""
    w0, rate = SYSTEMS[system]
    b0, base = SYSTEMS["III"]
    return (w0 - b0) + (rate - base) * j2000_days(ts)


def iii_to_ii(lon, ts) -> Column:
    return wrap_deg(as_col(lon) + system_offset_deg(ts, "II"))


def ii_to_iii(lon, ts) -> Column:
    return wrap_deg(as_col(lon) - system_offset_deg(ts, "II"))


def approx_meridian(mjd) -> Column:
    turns = (as_col(mjd) - MJD_J2000) / (ROTATION_PERIOD_S / 86400.0)
    return wrap_deg(360.0 * F.pmod(turns, F.lit(1.0)))


def approx_distance_au(mjd) -> Column:
    return 5.2 + 0.6 * F.cos(2.0 * math.pi * (as_col(mjd) - MJD_J2000) / 398.88)


def apparent_diameter_arcsec(distance_au) -> Column:
    return F.degrees(2.0 * REQ_KM / (as_col(distance_au) * AU_KM)) * 3600.0


def geometry(ts) -> dict[str, Column]:
    """Distance, light time, meridian, diameter and sub-observer latitude; NULL instant gives NULLs."""
    tdb = tdb_mjd(tt_mjd(ts))
    au = approx_distance_au(tdb)
    light = au * AU_KM / LIGHT_KM_S
    return {
        "distance_au": au,
        "light_time_s": light,
        "cm_iii": approx_meridian(tdb - light / 86400.0),
        "diameter_arcsec": apparent_diameter_arcsec(au),
        "sub_lat": 3.0 * F.sin(2.0 * math.pi * (tdb - MJD_J2000) / (11.86 * 365.25)),
    }


def drift_model_lon(t_us) -> Column:
    return wrap_deg(ANCHOR_LON + ANCHOR_RATE * ((as_col(t_us) - F.lit(ANCHOR_US)) / F.lit(float(DAY_US))))


def model_meridian(t_us) -> Column:
    return wrap_deg(360.0 * ((mjd_utc(t_us) - MJD_J2000) / (ROTATION_PERIOD_S / 86400.0)))


def drift_model_relative(t_us) -> Column:
    return wrap_diff(drift_model_lon(t_us), model_meridian(t_us))


def ticks_to_us(ticks) -> Column:
    """100 ns ticks since year 1 to microseconds since 1970; 0 means unset."""
    d = as_col(ticks) - F.lit(621355968000000000)
    floored = F.call_function("div", d - F.pmod(d, F.lit(10)), F.lit(10))  # exact in BIGINT, rounds down before 1970
    return F.when(as_col(ticks) != 0, floored)


def us_to_ticks(t_us) -> Column:
    return as_col(t_us) * F.lit(10) + F.lit(621355968000000000)
