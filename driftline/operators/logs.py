"""Header metadata by alias and usage-log summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import keep_largest

c = F.col

# Header keys per field, most authoritative first.
HEADER_ALIASES = {
    "aperture": ["APERTURE", "APERTUR", "TELAPERT", "TELDIAM", "APERDIA", "APERTURE_M", "APERTURE_MM", "PRIMARYAPERTURE"],
    "filter": ["FILTER", "FILTER1", "FILTER2", "INSFLNAM", "FILTBAND", "BAND", "WAVELENG", "WAVEBAND", "PASSBAND", "FILTERNAME"],
    "telescope": ["TELESCOP", "TELNAME", "OBSERVAT"],
    "instrument": ["INSTRUME", "CAMERA", "DETECTOR", "IMAGETYP"],
    "target": ["OBJECT", "TARGNAME", "OBJNAME", "TITLE"],
    "ra": ["OBJCTRA", "RA", "TELRA", "CRVAL1"],
    "dec": ["OBJCTDEC", "DEC", "TELDEC", "CRVAL2"],
    "pixel_um": ["XPIXSZ", "PIXSIZE1", "PIXEL", "XPIXELSZ"],
    "focal_mm": ["FOCALLEN", "FOCAL", "FOCLEN"],
    "gain": ["GAIN", "EGAIN", "GAINDB"],
    "temperature": ["CCD-TEMP", "CCDTEMP", "TEMPERAT"],
    "observer": ["OBSERVER", "AUTHOR"],
    "frame": ["FRAMETYP", "FRAME"],
}
RANGES = {"pixel_um": (0.1, 1e3), "focal_mm": (1.0, 1e5)}


def header_metadata(headers: DataFrame, file: str, aliases: dict[str, list[str]] = HEADER_ALIASES) -> DataFrame:
    """Key/value header rows to one row per file: the first usable value by alias priority, NULL when none.

    The alias list is fixed and broadcast; min_by combines map-side. Ranged numbers outside their range are skipped.
    """
    spark = headers.sparkSession
    rows = [(k, f, i) for f, keys in aliases.items() for i, k in enumerate(keys)]
    table = F.broadcast(spark.createDataFrame(rows, "key string, field string, prio int"))
    h = headers.select(file, F.upper(F.trim("key")).alias("key"), F.trim("value").alias("value"))
    h = h.where(~c("value").isin("", "None", "nan", "NaN")).join(table, "key")
    ok = F.lit(True)
    for f, (lo, hi) in RANGES.items():
        v = c("value").try_cast("double")
        ok = F.when(c("field") == f, F.coalesce((v > lo) & (v < hi), F.lit(False))).otherwise(ok)
    best = h.where(ok).groupBy(file, "field").agg(F.min_by("value", "prio").alias("v"))
    return best.groupBy(file).pivot("field", list(aliases)).agg(F.first("v"))


def usage_summary(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def last_state(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Latest fields per key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s"), F.count(F.lit(1)).alias("n_events")).select(
        key, "n_events", "s.*")


def merged_logs(logs: dict[str, DataFrame], devices: DataFrame, key: str) -> DataFrame:
    """Several logs with their names and the device label where known."""
    out = None
    for name, df in logs.items():
        part = df.withColumn("log", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.join(devices, key, "left")


def last_events(events: DataFrame, n: int, t: str, tie: str) -> DataFrame:
    """The last n events of the whole log; a bounded top-n."""
    return events.orderBy(F.desc(t), F.desc(tie)).limit(n)


def last_per_key(events: DataFrame, key: list[str], n: int, t: str, tie: str) -> DataFrame:
    return keep_largest(events, key, t, tie, F.least(F.lit(n), c("n"))).where("kept").drop("kept")
