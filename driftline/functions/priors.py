"""Trust rules for methods and central-meridian sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .angles import FEATURE_LAT, as_col, wrap_diff

# Central-meridian sources.
TRUSTED_SOURCES = [
    "spice", "spice_auto", "spice_legacy", "horizons", "horizons_sublon", "winjupos", "override", "user",
    "cm_override", "synthetic_truth", "synthetic",
]
WEAK_SOURCES = [
    "analytical", "analytic", "fallback", "unknown", "spice_auto_distance_only", "spice_distance_only", "",
]

# Reliability per family and per method (default family 0.9, default method 1.0).
FAMILY_PRIOR = {
    "ensemble": 1.15, "map": 1.10, "threshold": 1.05, "profile": 1.00, "isophote": 1.00, "robust": 1.10,
    "template": 0.95, "morph": 0.95, "image": 0.90, "spectral": 0.95, "extent": 0.85, "edge": 0.40, "extra": 0.90,
    "?": 0.70,
}
METHOD_PRIOR = {
    "ENS_MEDIAN": 1.4, "ENS_WMEAN": 1.3, "ENS_TRIM": 1.25, "ENS_MEDOID": 1.2, "MAP_DARK": 1.25, "QUAD_MOM": 1.2,
    "HU_MOM": 1.15, "FLUX_P1": 1.15, "FLUX_P2": 1.15, "GEOM_MED": 1.2, "MEAN_SHIFT": 1.15, "KDE_MODE": 1.1,
    "P_LADDER": 1.15, "MULTI_ISO": 1.15, "OTSU": 1.1, "PERC12": 1.15, "PERC18": 1.1, "CIV_WIN": 1.05, "MS_NCC": 1.0,
    "ENGINE": 1.05, "GS-MAP": 1.25, "GS-BARY": 1.2, "SPOMF": 0.35, "PHASE_CORR": 0.40, "RING_TMPL": 0.45,
    "PROJ_1D": 0.50, "FWHM_LON": 0.55, "MIN_PIX": 0.30, "MEC": 0.50, "RAD_SYM": 0.55, "STRUCT_T": 0.50,
    "SOBEL_RING": 0.45, "EDGE_W": 0.15, "EDGE_E": 0.15, "EDGE_N": 0.15, "EDGE_S": 0.15,
}
EDGE_METHODS = ["EDGE_W", "EDGE_E", "EDGE_N", "EDGE_S", "GS-EDGE-W", "GS-EDGE-E", "BOX_LEN", "MIN_PIX"]
CENTRES_IN_EDGE_FAMILY = ["ISOPHOTE", "OVAL", "MID", "MORPH", "MEAN_SHIFT", "BARY_IMG"]


def trusted_source(source) -> Column:
    s = F.lower(F.trim(F.coalesce(as_col(source), F.lit(""))))
    return ~s.isin(WEAK_SOURCES) & s.rlike("|".join(TRUSTED_SOURCES))


def in_core_band(lat) -> Column:
    return F.coalesce(as_col(lat).between(FEATURE_LAT - 8.0, FEATURE_LAT + 4.0), F.lit(False))


def in_wide_band(lat) -> Column:
    return F.coalesce(as_col(lat).between(FEATURE_LAT - 16.0, FEATURE_LAT + 10.0), F.lit(False))


def centre_method(method, family) -> Column:
    m = as_col(method)
    return ~(
        m.isin(EDGE_METHODS) | m.startswith("EDGE_") | ((as_col(family) == "edge") & ~m.isin(CENTRES_IN_EDGE_FAMILY))
    )


def map_edge_lock(lon, cm, margin=2.5) -> Column:
    return F.coalesce(F.abs(F.abs(wrap_diff(lon, cm)) - 90.0) < margin, F.lit(False))


def near_pipeline(lon, pipeline_lon, tol=20.0) -> Column:
    return F.coalesce(F.abs(wrap_diff(lon, pipeline_lon)) < tol, F.lit(False))


def prior_table(spark: SparkSession, prior: dict[str, float], key: str, value: str) -> DataFrame:
    """A few dozen fixed rows."""
    return spark.createDataFrame(sorted(prior.items()), f"{key} string, {value} double")


def with_prior_weight(
    hits: DataFrame, family_prior: DataFrame, method_prior: DataFrame, out: str = "prior_weight"
) -> DataFrame:
    """Declared weight x family prior x method prior, floored; both dimensions are fixed lists of known methods."""
    declared = F.when(F.coalesce(F.col("weight"), F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(F.col("weight"))
    joined = hits.join(F.broadcast(family_prior), "family", "left").join(F.broadcast(method_prior), "method_id", "left")
    w = declared * F.coalesce("family_prior", F.lit(0.9)) * F.coalesce("method_prior", F.lit(1.0))
    return joined.withColumn(out, F.greatest(w, F.lit(1e-6))).drop("family_prior", "method_prior")
