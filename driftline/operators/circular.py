"""Circular and robust statistics per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.angles import as_col, wrap_deg, wrap_diff

from .skew import attach, group_mad, group_median


def _over(agg: Column, window: WindowSpec | None) -> Column:
    return agg if window is None else agg.over(window)


def circular_mean(lon, weight=None, window: WindowSpec | None = None) -> Column:
    """Aggregate expression (or window expression): direction of the weighted resultant."""
    w = F.lit(1.0) if weight is None else as_col(weight)
    a = F.radians(as_col(lon))
    return wrap_deg(F.degrees(F.atan2(_over(F.sum(w * F.sin(a)), window), _over(F.sum(w * F.cos(a)), window))))


def circular_std_deg(lon, window: WindowSpec | None = None) -> Column:
    a = F.radians(as_col(lon))
    r = F.hypot(_over(F.avg(F.sin(a)), window), _over(F.avg(F.cos(a)), window))
    return F.degrees(F.sqrt(-2.0 * F.ln(F.least(F.greatest(r, F.lit(1e-12)), F.lit(1.0)))))


def mean_and_spread(df: DataFrame, keys: list[str], lon: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(lon).alias("n"),
        circular_mean(lon).alias("mean_lon"),
        circular_mean(lon, weight).alias("wmean_lon"),
        circular_std_deg(lon).alias("std_lon"),
    )


def circular_median(df: DataFrame, keys: list[str], lon: str, out: str) -> DataFrame:
    """Median of the differences about the circular mean, for groups of any size."""
    centre = df.groupBy(*keys).agg(circular_mean(lon).alias("_cm"))
    rows = attach(df.select(*keys, lon), centre, keys).withColumn("_d", wrap_diff(lon, "_cm"))
    return attach(centre, group_median(rows, keys, "_d", "_md"), keys, salts=1).select(
        *keys, wrap_deg(F.col("_cm") + F.col("_md")).alias(out)
    )


def mad_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = group_mad(df.select(*keys, value), keys, value, "med", "mad")
    return rows.groupBy(*keys).agg(F.max("med").alias("med"), F.max("mad").alias("mad"))
