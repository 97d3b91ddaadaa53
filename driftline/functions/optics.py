"""Air dispersion, limb darkening, resolution and colour arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import ARCSEC_PER_RAD, as_col, clip


def air_index(lam_nm, pressure_mbar, temp_c, rel_humidity, co2_ppm=450.0) -> Column:
    """n - 1 of air: dry dispersion scaled by pressure and temperature, minus the water-vapour term."""
    lam_um = F.greatest(as_col(lam_nm), F.lit(1e-3)) * 1e-3
    s2 = 1.0 / (lam_um * lam_um)
    dry = (8342.13 + 2406030.0 / (130.0 - s2) + 15997.0 / (38.9 - s2)) * 1e-8
    t = as_col(temp_c)
    warm = 6.1121 * F.exp((18.678 - t / 234.5) * (t / (257.14 + t)))
    cold = 6.1115 * F.exp((23.036 - t / 333.7) * (t / (279.82 + t)))
    vapour = as_col(rel_humidity) * F.when(t >= 0, warm).otherwise(cold)
    co2 = 1.0 + 0.540 * (as_col(co2_ppm) - 300.0) * 1e-6
    return dry * (as_col(pressure_mbar) * 100.0 / 101325.0) * (288.15 / (273.15 + t)) * co2 - vapour * (
        3.8020 - 0.0384 / s2
    ) * 1e-10


def dispersion_arcsec(z_deg, lam1, lam2, pressure_mbar=1013.25, temp_c=15.0, rel_humidity=0.5) -> Column:
    dn = air_index(lam1, pressure_mbar, temp_c, rel_humidity) - air_index(lam2, pressure_mbar, temp_c, rel_humidity)
    z = F.radians(clip(z_deg, 0.0, 89.9))
    return dn * F.tan(z) * (180.0 / math.pi) * 3600.0


def dispersion_px(arcsec, radius_px, diameter_arcsec) -> Column:
    r = as_col(radius_px)
    return F.when(r <= 0, F.lit(0.0)).otherwise(
        as_col(arcsec) / (as_col(diameter_arcsec) / (2.0 * F.when(r > 0, r)) + 1e-12)
    )


def simple_refraction_arcsec(z_deg, pressure_mbar, temp_c, lam_um) -> Column:
    sig2 = F.pow(1.0 / F.greatest(as_col(lam_um), F.lit(0.2)), 2)
    n1 = 1e-8 * (8342.54 + 2406147.0 / (130.0 - sig2) + 15998.0 / (38.9 - sig2))
    n1 = n1 * (as_col(pressure_mbar) / 1013.25) * (288.15 / (as_col(temp_c) + 273.15))
    z = F.radians(clip(z_deg, 0.0, 89.0))
    return F.degrees(n1 * F.tan(z)) * 3600.0


def limb_law(mu, u1=0.6, u2=0.2) -> Column:
    x = 1.0 - clip(mu, 0.0, 1.0)
    return 1.0 - u1 * x - u2 * x * x


def structure_function(r_px, r0_px) -> Column:
    return 6.88 * F.pow(as_col(r_px) / F.greatest(as_col(r0_px), F.lit(1e-6)), F.lit(5.0 / 3.0))


def lock_confidence(snr) -> Column:
    s = as_col(snr)
    raised = F.least(F.log1p(F.when(s > 0, s)) / math.log(21.0), F.lit(1.0))
    return F.when(s.isNull() | F.isnan(s) | (s <= 0) | (s == float("inf")), F.lit(0.0)).otherwise(raised)


def diffraction_floor_arcsec(lam_nm, aperture_m) -> Column:
    return 206265.0 * (as_col(lam_nm) * 1e-9) / F.greatest(as_col(aperture_m), F.lit(0.05))


def plate_scale(pixel_um, focal_mm) -> Column:
    """Arcsec per pixel; NULL unless both inputs are in their believable ranges."""
    p, f = as_col(pixel_um), as_col(focal_mm)
    ok = (p > 0.1) & (p < 1e3) & (f > 1.0) & (f < 1e5)
    return F.when(ok, ARCSEC_PER_RAD * p / (f * 1000.0))


def luma(r, g, b) -> Column:
    return 0.299 * as_col(r) + 0.587 * as_col(g) + 0.114 * as_col(b)


def _pos(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def red_excess(r, b) -> Column:
    return _pos(as_col(r) - as_col(b))


def orange_product(r, g, b) -> Column:
    return _pos(as_col(r) - as_col(g)) * red_excess(r, b)


def orange_score(r, g, b) -> Column:
    return orange_product(r, g, b) * (0.4 + _pos(as_col(r) - 0.5 * (as_col(g) + as_col(b))))


def to_ycbcr(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = as_col(r), as_col(g), as_col(b)
    return (
        luma(r, g, b),
        -0.168736 * r - 0.331264 * g + 0.5 * b + 0.5,
        0.5 * r - 0.418688 * g - 0.081312 * b + 0.5,
    )


def from_ycbcr(y, cb, cr) -> tuple[Column, Column, Column]:
    y, cb, cr = as_col(y), as_col(cb) - 0.5, as_col(cr) - 0.5
    return tuple(clip(x, 0.0, 1.0) for x in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb))
