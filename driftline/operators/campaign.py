"""Audit campaigns: error summaries, grades, floors, resume. Cells can hold any share of the cases.

Counts, rates, sums and maxima combine map-side; quantiles come from the bucketed order statistics, so no cell is
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.angles import sky_error_arcsec

from .skew import attach, group_quantiles, order_statistics


def with_errors(df: DataFrame, lat0: float = -19.8) -> DataFrame:
    """Absolute and on-sky errors of each case."""
    return df.withColumns({
        "abs_dlon": F.abs("dlon"), "abs_dlat": F.abs("dlat"),
        "sky": sky_error_arcsec("dlon", "dlat", F.lit(lat0) + F.col("dlat"), "distance_au"),
    })


def measure_quantiles(df: DataFrame, keys: list[str], measures: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several measures in one pass: columns `<measure>_<prob>` per key."""
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in measures])).alias("e"),
    ).select(*keys, F.col("e.m").alias("_m"), F.col("e.v").alias("_x"))
    q = group_quantiles(long, [*keys, "_m"], "_x", probs)
    cols = [F.max(F.when(F.col("_m") == m, F.col(p))).alias(f"{m}_{p}") for m in measures for p in probs]
    return q.groupBy(*keys).agg(*cols)


def within(limit: float) -> Column:
    return F.avg(((F.col("abs_dlon") <= limit) & (F.col("abs_dlat") <= limit)).cast("double"))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, fail rate, bias, spread, quantiles, maxima and pass rates per cell; columns of `with_errors` and ok.

    For the overall row use `with_overall` first.
    """
    good = df.where("ok")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    agg = good.groupBy(*keys).agg(
        F.max("abs_dlon").alias("lon_max"), F.max("abs_dlat").alias("lat_max"), F.max("sky").alias("sky_max"),
        F.avg("dlon").alias("lon_bias"), F.stddev_pop("dlon").alias("lon_sd"), F.avg("dlat").alias("lat_bias"),
        F.stddev_pop("dlat").alias("lat_sd"), within(0.2).alias("within_02"), within(0.5).alias("within_05"),
        within(1.0).alias("within_10"),
    )
    q = measure_quantiles(good, keys, ["abs_dlon", "abs_dlat", "sky"], {"med": 0.5, "p90": 0.9, "p99": 0.99})
    out = n.join(agg, keys, "left").join(q, keys, "left")
    return out.withColumn("fail_rate", 1.0 - F.col("n_ok") / F.col("n"))


def with_overall(df: DataFrame, keys: list[str], label: str = "ALL") -> DataFrame:
    """Every row twice, once under its own cell and once under the overall cell."""
    own = F.struct(*[F.col(k).alias(k) for k in keys])
    total = F.struct(*[F.lit(label).alias(k) for k in keys])
    rest = [x for x in df.columns if x not in keys]
    return df.select(*rest, F.explode(F.array(own, total)).alias("_cell")).select(*rest, "_cell.*")


def method_audit(df: DataFrame, method: str) -> DataFrame:
    """Signed and absolute errors per method, the upper decile by the exclusive rule (maximum below ten rows)."""
    df = df.withColumns({"_al": F.abs("dlon"), "_aa": F.abs("dlat")})
    agg = df.groupBy(method).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dlon").alias("dlon_mean"), F.stddev_pop("dlon").alias("dlon_sd"),
        F.avg("dlat").alias("dlat_mean"), F.avg("_al").alias("abs_dlon_mean"), F.max("_al").alias("abs_dlon_max"),
        F.avg(((F.col("_al") <= 1.0) & (F.col("_aa") <= 1.0)).cast("double")).alias("within_1deg"),
    )
    med = group_quantiles(df, [method], "dlon", {"dlon_median": 0.5}).drop("n")
    top = F.lit(9) * (F.col("n") + 1)
    j = F.least(F.greatest(F.floor(top / 10), F.lit(1)), F.col("n") - 1)
    ranks = {"_a": F.when(F.col("n") >= 10, j - 1).otherwise(F.col("n") - 1),
             "_b": F.when(F.col("n") >= 10, j).otherwise(F.col("n") - 1)}
    d = order_statistics(df, [method], "_al", ranks)
    delta = top - 10 * j
    p90 = F.when(F.col("n") >= 10, (F.col("_a") * (10 - delta) + F.col("_b") * delta) / 10.0).otherwise(F.col("_b"))
    return agg.join(med, method).join(d.select(method, p90.alias("abs_dlon_p90")), method)


def cell_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sweep cell: medians, pass and catastrophe rates, method histogram; defaults when every case failed."""
    good = df.where("ok")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    agg = good.groupBy(*keys).agg(
        F.max("abs_dlon").alias("max_abs_dlon"), within(1.0).alias("within_1deg"), within(0.5).alias("within_0p5deg"),
        F.avg((F.col("abs_dlon") > 10.0).cast("double")).alias("catastrophic_rate"),
    )
    q = measure_quantiles(good, keys, ["abs_dlon", "abs_dlat"], {"median": 0.5, "p90": 0.9})
    per = good.groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("_k"))
    hist = per.groupBy(*keys).agg(  # one entry per method name
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "method", F.col("_k").cast("string")))), ",").alias(
            "methods")
    )
    out = n.join(agg, keys, "left").join(q, keys, "left").join(hist, keys, "left")
    return out.withColumns({
        "within_1deg": F.coalesce("within_1deg", F.lit(0.0)), "within_0p5deg": F.coalesce("within_0p5deg", F.lit(0.0)),
        "catastrophic_rate": F.coalesce("catastrophic_rate", F.lit(1.0)), "methods": F.coalesce("methods", F.lit("")),
    })


def proof_summary(df: DataFrame, keys: list[str], limits=(0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    good = df.where("ok")
    names = {0.1: "le_0_1", 0.25: "le_0_25", 0.5: "le_0_5", 1.0: "le_1_0"}
    agg = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ok"), F.avg("sky").alias("mean"), F.stddev_samp("sky").alias("stdev"),
        F.min("sky").alias("min"), F.max("sky").alias("max"),
        *[F.avg((F.col("sky") <= x).cast("double")).alias(names[x]) for x in limits],
    )
    q = group_quantiles(good, keys, "sky", {"median": 0.5, "p16": 0.16, "p84": 0.84, "p95": 0.95}).drop("n")
    return agg.join(q, keys)


def certify(df: DataFrame, keys: list[str], median_max: float, p95_max: float, max_max: float) -> DataFrame:
    """SHIP only if the ok ratio, median, p95 and maximum gates all hold."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.max(
        F.when(F.col("ok"), F.col("sky"))).alias("max_sky"))
    q = group_quantiles(df.where("ok"), keys, "sky", {"median_sky": 0.5, "p95_sky": 0.95}).drop("n")
    r = n.join(q, keys, "left")
    gates = {
        "ok_ratio": F.col("n_ok") / F.col("n") >= 0.95, "median_le": F.col("median_sky") <= median_max,
        "p95_le": F.col("p95_sky") <= p95_max, "max_le": F.col("max_sky") <= max_max,
    }
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit(False)).alias("v")) for k, v in gates.items()])
    failed = F.transform(F.filter(table, lambda g: ~g["v"]), lambda g: g["k"])
    r = r.withColumn("failed_gates", F.array_join(failed, ","))
    return r.withColumn("grade", F.when(F.col("failed_gates") == "", F.lit("SHIP")).otherwise(F.lit("HOLD")))


def calibration_grade(median: Column, p95: Column, rate: Column) -> Column:
    return (
        F.when((median <= 0.20) & (p95 <= 0.50) & (rate >= 0.95), F.lit("A"))
        .when((median <= 0.40) & (p95 <= 1.00) & (rate >= 0.85), F.lit("B"))
        .when((median <= 0.80) & (p95 <= 2.00) & (rate >= 0.70), F.lit("C")).otherwise(F.lit("D"))
    )


def stress_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median and nearest-rank p95 of the sky error, with a calibration grade."""
    good = df.where("ok")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("ok").alias("n_ok"))
    agg = good.groupBy(*keys).agg(F.max("sky").alias("max_sky"), within(1.0).alias("within_1deg"))
    ranks = {
        "median_sky": F.floor(F.col("n") / 2),
        "p95_sky": F.least(F.col("n") - 1, F.bround(0.95 * (F.col("n") - 1))),
    }
    s = order_statistics(good, keys, "sky", ranks).select(*keys, "median_sky", "p95_sky")
    r = n.join(agg, keys, "left").join(s, keys, "left").withColumn("within_1deg", F.coalesce("within_1deg", F.lit(0.0)))
    return r.withColumn("calibration_grade", calibration_grade(F.col("median_sky"), F.col("p95_sky"), F.col("within_1deg")))


def failure_modes(df: DataFrame, case: list[str], role: str) -> DataFrame:
    """Which estimator was best per image, how often the dark pair split, how often colour beat its better half.

    Columns dlon and sky per (case, role); one row per role and case.
    """
    one = df.groupBy(*case).agg(
        F.min_by(role, F.struct("sky", role)).alias("best"),
        *[F.max(F.when(F.col(role) == r, F.struct("dlon", "sky"))).alias(r) for r in ("template", "moment", "redness")],
    )
    split = F.coalesce(F.abs(F.abs("template.dlon") - F.abs("moment.dlon")) > 12.0, F.lit(False))
    rescue = split & (F.col("redness.sky") < F.least("template.sky", "moment.sky")) & (
        F.col("template.sky") != F.col("moment.sky"))
    return one.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("best").isin("template", "moment")).alias("dark_right"),
        F.count_if(F.col("best") == "redness").alias("colour_right"),
        F.count_if(~F.col("best").isin("template", "moment", "redness")).alias("other"),
        F.count_if(split).alias("dark_split"), F.count_if(rescue).alias("rescued_by_colour"),
    )


def error_floor(cells: DataFrame, by: list[str], x: str, y: str, thresholds: dict[str, float]) -> DataFrame:
    """Where the y curve first rises through each threshold along x; the last x if it never gets there.

    `cells` has one row per tier, a handful per key.
    """
    w = Window.partitionBy(*by).orderBy(x)
    whole = Window.partitionBy(*by)
    r = cells.withColumns({
        "_x2": F.lead(x).over(w), "_y2": F.lead(y).over(w),
        "_xl": F.max(x).over(whole), "_yl": F.max_by(y, x).over(whole),
    })
    cols = []
    for name, t in thresholds.items():
        cross = (F.col(y) <= t) & (F.col("_y2") > t)
        at = F.col(x) + (t - F.col(y)) / (F.col("_y2") - F.col(y)) * (F.col("_x2") - F.col(x))
        cols.append(F.coalesce(
            F.min_by(at, F.when(cross, F.col(x))), F.max(F.when(F.col("_yl") < t, F.col("_xl")))
        ).alias(name))
    return r.groupBy(*by).agg(*cols, F.min_by(y, F.when(F.col(y).isNotNull(), F.col(x))).alias("best"))


def stale_cases(matrix: DataFrame, cache: DataFrame, key: str, spec: list[str], close: list[str] = ()) -> DataFrame:
    """Cases to run: no cached row, a failed one, or one made with another specification."""
    cond = [matrix[key] == cache[key], cache["ok"]]
    cond += [matrix[s].eqNullSafe(cache[s]) for s in spec]
    cond += [F.abs(matrix[s] - cache[s]) <= 1e-9 for s in close]
    full = cond[0]
    for x in cond[1:]:
        full = full & x
    return matrix.join(cache, full, "left_anti")


def case_matrix(strata: DataFrame, stratum: str, count: str, seed0: int, stride: int, block: int = 10_000) -> DataFrame:
    """`count` numbered cases per stratum, numbered through all strata in stratum order, with seeds.

    Offsets are a running sum over the strata only; large strata are expanded block by block in many tasks.
    """
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    s = strata.withColumn("_off", F.coalesce(F.sum(count).over(before), F.lit(0)))
    blocks = F.sequence(F.lit(0), F.floor((F.col(count) - 1) / block).cast("bigint"))
    s = s.where(F.col(count) > 0).withColumn("_blk", F.explode(blocks)).repartition(stratum, "_blk")
    last = F.least(F.col(count) - 1, (F.col("_blk") + 1) * block - 1)
    s = s.withColumn("_k", F.explode(F.sequence(F.col("_blk") * block, last)))
    s = s.withColumn("idx", F.col("_off") + F.col("_k"))
    return s.withColumn("seed", F.lit(seed0) + F.col("idx") * stride).drop("_off", "_blk", "_k")


def attach_truth(measured: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Measured rows with their truth row; the measured side may repeat a key any number of times."""
    return attach(measured, truth, keys, how="inner")
