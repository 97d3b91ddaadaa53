"""Row shapes for export, and the writers that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.angles import as_col, finite
from driftline.functions.parsing import parse_instant_us

from . import table_source
from .table_source import OBSERVATION_COLUMNS

c = F.col


def degrees_text(x, places: int = 3) -> Column:
    v = finite(x)
    return F.when(v.isNotNull(), F.format_string(f"%.{places}f", v)).otherwise(F.lit(""))


def measurement_rows(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """The fifteen observation columns as text; columns t_us, lon_iii, lat and any of lon_i, lon_ii, length, width.

    Rows without a time are skipped; missing numbers are blank.
    """
    text = {"Object": "GRS", "Observer": "", "Instrument": "", "Seeing": "", "Method": "GS-ORANGE", "Ref": "driftline", "Comment": ""}
    text.update(defaults or {})
    number = {"L_I": "lon_i", "L_II": "lon_ii", "L_III": "lon_iii", "Lat": "lat", "Length": "length", "Width": "width"}
    ts = F.timestamp_micros("t_us")
    cols = {
        "Date": F.date_format(ts, "yyyy-MM-dd"), "Time": F.date_format(ts, "HH:mm:ss"),
        **{k: degrees_text(v) if v in df.columns else F.lit("") for k, v in number.items()},
        **{k: F.coalesce(c(k).cast("string"), F.lit(v)) if k in df.columns else F.lit(v) for k, v in text.items()},
    }
    return df.where("t_us is not null").withColumns(cols)


def write_observations(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Observation files in one commit; other columns than the fifteen are left out."""
    table_source.register(df.sparkSession)
    cells = df.select(*[c(x) for x in OBSERVATION_COLUMNS if x in df.columns])
    cells.write.format("observation_table").option("sep", sep).mode(mode).save(path)


def package_rows(packages: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Published packages as measurement rows: `time_utc`, else `utc_iso`; packages without a time are skipped."""
    text = {"Method": "GS-ORANGE", **(defaults or {})}
    rows = packages.select(
        "*", parse_instant_us(F.coalesce("time_utc", "utc_iso")).alias("t_us"), c("lon_iii_deg").alias("lon_iii"), c("lat_deg").alias("lat"),
        c("length_deg").alias("length"), c("width_deg").alias("width"), c("method").alias("Method_"), c("comment").alias("Comment_"),
    ).drop("method", "comment").withColumnsRenamed({"Method_": "Method", "Comment_": "Comment"})
    return measurement_rows(rows, text)


def export_packages(packages: DataFrame, path: str, defaults: dict[str, str] | None = None) -> None:
    write_observations(package_rows(packages, defaults), path)


def drift_rows(points: DataFrame, by: list[str]) -> DataFrame:
    """Series points with the clipped flag of the fit."""
    return points.select(*by, "ord", "t_us", degrees_text("lon", 4).alias("lon"), (~c("kept")).cast("int").alias("clipped"))


def profile_rows(bins: DataFrame, by: list[str], numbers: list[str], counts: list[str] = ()) -> DataFrame:
    """Profile bins as text, blank where a bin has no evidence, and their counts."""
    return bins.select(*by, "bin", *[degrees_text(n, 4).alias(n) for n in numbers], *counts)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def write_batch(summary: DataFrame, path: str) -> None:
    """A batch summary as JSON documents and as CSV."""
    summary.write.mode("overwrite").json(f"{path}/json")
    write_csv(summary, f"{path}/csv")


def union_of_keys(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with the union of their columns; nested values become JSON text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    nested = [f.name for f in out.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    return out.withColumns({n: F.to_json(n) for n in nested}) if nested else out


def append_lines(df: DataFrame, path: str) -> None:
    """Plain appending; `append_log.AppendLog` keeps an order and takes a batch once."""
    df.write.mode("append").json(path)


def json_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.to_json(F.struct(*[x for x in df.columns])).alias("line"))


def report_documents(header: DataFrame, points: DataFrame, by: list[str], order: str) -> DataFrame:
    """Header fields and the ordered points of each series in one document.

    A document is one object of an exchange file, so its points must fit in a row; use the flat tables for large series.
    """
    rest = [x for x in points.columns if x not in by]
    packed = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *[x for x in rest if x != order]))).alias("points"))
    return header.join(packed, by)


def manifest(inputs: DataFrame, config: dict[str, str], content: str, name: str) -> DataFrame:
    """One row per input with its hash and the hash of the configuration."""
    conf = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]))
    return inputs.select(
        as_col(name).alias("input"), F.sha2(c(content).cast("binary"), 256).alias("sha256"), F.sha2(conf, 256).alias("config_sha256"))
