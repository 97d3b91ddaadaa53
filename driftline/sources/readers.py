"""Observation tables, ephemeris tables, epoch documents, campaign caches, capture listings, logs and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.angles import finite, wrap_deg
from driftline.functions.parsing import decimal, parse_instant_us, parse_table_instant_us

from ..operators import skew
from . import append_log, table_source
from .table_source import OBSERVATION_COLUMNS

c = F.col

NUMERIC_COLUMNS = ["L_I", "L_II", "L_III", "Lat", "Length", "Width"]


def checked_observations(raw: DataFrame) -> DataFrame:
    """Text cells to numbers and `t_us`. `bad` names the cells that can't be read; without a date, `t_us` is NULL."""
    known = [x for x in OBSERVATION_COLUMNS if x in raw.columns]
    out = raw.withColumns({x: F.trim(F.coalesce(c(x), F.lit(""))) for x in known}).withColumn("t_us", parse_table_instant_us("Date", "Time"))
    numbers = [x for x in NUMERIC_COLUMNS if x in known]
    bad = F.array(F.when(c("t_us").isNull(), F.lit("Date")), *[F.when((c(x) != "") & decimal(x).isNull(), F.lit(x)) for x in numbers])
    return out.withColumn("bad", F.array_compact(bad)).withColumns({x: decimal(x) for x in numbers})


def typed_observations(raw: DataFrame) -> DataFrame:
    """Rows with a readable date; an unreadable number is NULL."""
    return checked_observations(raw).where("t_us is not null").drop("bad")


def observation_cells(spark: SparkSession, path: str) -> DataFrame:
    """The text cells of observation files with their place; every file finds its own separator."""
    table_source.register(spark)
    return spark.read.format("observation_table").load(path)


def read_observations(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Typed observations of a file, glob or folder; sorted by time unless a later step orders them anyway."""
    obs = typed_observations(observation_cells(spark, path))
    return obs.orderBy("t_us", "file", "block", "row") if ordered else obs


def rejected_observations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of observation files without a readable date, or with unreadable numbers, and why (`bad`)."""
    return checked_observations(observation_cells(spark, path)).where(F.size("bad") > 0)


def drift_points(obs: DataFrame, want: tuple[str, ...] = ("grs",)) -> DataFrame:
    """Longitude points of the wanted objects (a blank object counts), sigma 1.0."""
    hit = c("Object") == ""
    for w in want:
        hit = hit | F.lower("Object").contains(w.lower())
    keep = obs.where(hit & c("L_II").isNotNull()) if want else obs.where(c("L_II").isNotNull())
    src = F.when(c("Observer") != "", c("Observer")).otherwise(F.lit("jupos"))
    return keep.withColumns({"lon": wrap_deg("L_II"), "sigma": F.lit(1.0), "source": src})


def typed_ephemeris(raw: DataFrame) -> DataFrame:
    """Rows with a time and a central meridian. Where a time is given it decides, else jd, else mjd."""
    day = F.lit(86_400_000_000.0)
    from_jd = F.round((decimal("jd") - 2440587.5) * day).cast("bigint")
    from_mjd = F.round((decimal("mjd") - 40587.0) * day).cast("bigint")
    t = F.when(c("time").isNotNull(), parse_instant_us("time")).otherwise(F.coalesce(from_jd, from_mjd))
    return raw.select(
        t.alias("t_us"), decimal("cm_iii").alias("cm"), F.coalesce(decimal("sub_lat"), F.lit(0.0)).alias("sub_lat"),
        F.coalesce(decimal("np_pa"), F.lit(0.0)).alias("np_pa"), decimal("distance_au").alias("distance_au"),
    ).where("t_us is not null and cm is not null")


def read_ephemeris(spark: SparkSession, path: str) -> DataFrame:
    """Ephemeris files (delimited or JSON) with any of the known header spellings."""
    table_source.register(spark)
    return typed_ephemeris(spark.read.format("ephemeris_table").load(path))


EPOCH_SCHEMA = """series_id string, epoch_id string, t_utc string, kind string, headline struct<lon:double,lat:double,sigma:double>,
 publish struct<lon:double,lat:double>, result struct<lon_iii_deg:double,lat_deg:double,sigma_lon_deg:double>"""


def epochs(docs: DataFrame) -> DataFrame:
    """First finite position of the nested paths; documents without one are dropped; sigma defaults to 0.2.

    Secondary documents (kind other than research) count only for series that have no research document.
    """
    first = lambda *p: F.coalesce(*[finite(c(x)) for x in p])
    e = docs.withColumns({
        "lon": first("publish.lon", "headline.lon", "result.lon_iii_deg"),
        "lat": first("publish.lat", "headline.lat", "result.lat_deg"),
        "sigma": F.coalesce(first("headline.sigma", "result.sigma_lon_deg"), F.lit(0.2)),
    }).where("lon is not null and lat is not null")
    main = e.where("kind = 'research'")
    extra = e.where("kind <> 'research'").join(main.select("series_id").distinct(), "series_id", "left_anti")
    return main.unionByName(extra)


def read_epochs(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Epoch documents below a folder, one a file (or one a line). A document without a series belongs to that of its folder."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder, schema=EPOCH_SCHEMA, multiLine=not lines)
    file = c("_metadata.file_path")
    docs = docs.withColumns({"file": file, "series_id": F.coalesce("series_id", F.regexp_extract(file, r"([^/]+)/[^/]*$", 1))})
    main = F.lower(F.regexp_extract("file", r"([^/]*)$", 1)).contains("research")
    return epochs(docs.withColumn("kind", F.coalesce("kind", F.when(main, F.lit("research")).otherwise(F.lit("vlbi")))))


def latest_per_case(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last record per case; a max_by, so a case repeated very often is reduced before the shuffle."""
    rest = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def read_campaign_cache(spark: SparkSession, path: str, schema: str, key: str = "idx") -> DataFrame:
    """JSON lines; bad lines are dropped, the last line per case wins: by file name, then by place in the file."""
    lines = append_log.placed(spark.read.text(path))
    return append_log.last_records(append_log.readable(lines, schema), key)


def capture_list(files: DataFrame, path: str, exts: tuple[str, ...]) -> DataFrame:
    """Distinct paths with a wanted extension, sorted by name."""
    ext = F.lower(F.regexp_extract(c(path), r"\.([A-Za-z0-9]+)$", 1))
    return files.where(ext.isin([e.lower().lstrip(".") for e in exts])).select(path).distinct().orderBy(path)


def discover_captures(spark: SparkSession, paths: str | list[str], exts: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """Captures in folders, globs and single files, each once. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load([paths] if isinstance(paths, str) else paths)
    return capture_list(files.select("path"), "path", exts)


USAGE_SCHEMA = (
    "ts_utc string, unix double, action string, email string, display_name string, detail string, device string, raw string"
)


def read_usage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Usage lines of one or several logs with their place; an unreadable line keeps its text in `raw`."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").json(path, schema=USAGE_SCHEMA)
    return append_log.placed(rows)


PACKAGE_SCHEMA = """job_id bigint, time_utc string, utc_iso string, lon_iii_deg double, lat_deg double, length_deg double, width_deg double, method string,
 comment string, headline struct<lon:double,lat:double,width:double>, publish struct<cm_source:string,limb:double>, champion struct<ok:boolean>"""


def read_packages(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Job packages under one superset schema; what a package lacks is NULL."""
    return spark.read.schema(PACKAGE_SCHEMA).option("multiLine", not lines).json(path)


def sampled_frames(frames: DataFrame, step: int, limit: int, factor: int, width: int) -> DataFrame:
    """Every `step`-th frame, the first `limit` of them in each capture, pixels averaged over factor x factor blocks.

    The limit counts frames that are given out. Averages stay inside the frame row, whose height follows from its length.
    """
    w = width // factor
    taken = frames.where(c("frame_idx") % step == 0).withColumn("_back", -c("frame_idx"))
    f = skew.keep_largest(taken, ["capture_id"], "_back", "frame_idx", F.least(F.lit(limit), c("n"))).where("kept").select(frames.columns)
    h = F.floor(F.floor(F.size("data") / width) / factor).cast("int")
    offs = [(dy, dx) for dy in range(factor) for dx in range(factor)]

    def block(k):
        y, x = F.floor(k / w).cast("int") * factor, (k % w) * factor
        s = sum((F.get(c("data"), (y + dy) * width + x + dx) for dy, dx in offs), F.lit(0.0))
        return s / float(factor * factor)

    return f.withColumn("data", F.transform(F.sequence(F.lit(0), h * w - 1), block))
