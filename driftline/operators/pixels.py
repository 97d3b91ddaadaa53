"""Stacking across frames: one value per (capture, y, x). Any number of frames per capture.

Means and weighted means combine map-side. Medians and trims use order statistics; each clipping round joins the small
per-pixel state (image size x captures) back to the pixel rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.angles import as_col
from driftline.functions.optics import lock_confidence, structure_function

from .skew import attach, cut, group_median, keep_largest, order_statistics
from .tracks import fried_parameter

c = F.col
PIX = ["capture_id", "y", "x"]


def stack_mean(px: DataFrame, keys=PIX) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg("v").alias("value"))


def stack_median(px: DataFrame, keys=PIX) -> DataFrame:
    return group_median(px, keys, "v", "value")


def stack_kappa_sigma(px: DataFrame, keys=PIX, kappa: float = 2.5, rounds: int = 3) -> DataFrame:
    """Start at the median; each round is the mean of values within kappa sigma of the last; sigma of all frames."""
    sd = px.groupBy(*keys).agg((F.stddev_pop("v") + 1e-12).alias("_sd"))
    state = cut(stack_median(px, keys).join(sd, keys))
    for _ in range(rounds):
        near = F.abs(c("v") - c("value")) <= kappa * c("_sd")
        r = attach(px, state, keys)
        state = cut(r.groupBy(*keys).agg(
            (F.sum(F.when(near, c("v")).otherwise(F.lit(0.0))) / (F.count_if(near) + 1e-12)).alias("value"),
            F.first("_sd").alias("_sd")))
    return state.drop("_sd")


def stack_weighted(px: DataFrame, weight: str, keys=PIX) -> DataFrame:
    """Weighted mean with weights clipped at zero; all-zero weights count equally."""
    w = F.greatest(c(weight), F.lit(0.0))
    total = F.sum(w)
    return px.groupBy(*keys).agg(
        F.when(total > 0, F.sum(w * c("v")) / F.when(total > 0, total)).otherwise(F.avg("v")).alias("value"))


def stack_trimmed(px: DataFrame, keys=PIX, frac: float = 0.1) -> DataFrame:
    """Mean without the int(frac n) smallest and largest values; copies of the border values are counted exactly."""
    k = F.floor(frac * c("n"))
    edge = order_statistics(px, keys, "v", {"_lo": k, "_hi": F.greatest(c("n") - 1 - k, k)})
    edge = edge.withColumn("_k", F.floor(frac * c("n")))
    r = attach(px, edge, keys)
    g = r.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("_k").alias("_k"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.first("_hi_below").alias("_hb"), F.avg("v").alias("_mean"), F.count_if(c("v") <= c("_lo")).alias("_le"),
        F.sum(F.when((c("v") > c("_lo")) & (c("v") < c("_hi")), c("v")).otherwise(F.lit(0.0))).alias("_mid"))
    kept = c("n") - 2 * c("_k")
    cutmean = (c("_mid") + c("_lo") * (c("_le") - c("_k")) + c("_hi") * (c("n") - c("_k") - c("_hb"))) / kept
    plain = (c("_k") <= 0) | (2 * c("_k") >= c("n"))
    return g.select(*keys, F.when(plain, c("_mean")).when(c("_lo") == c("_hi"), c("_lo")).otherwise(cutmean).alias("value"))


def stack_robust(px: DataFrame, weight: str, keys=PIX, sigma: float = 3.0, rounds: int = 2) -> DataFrame:
    """Median, MAD scale, then sigma-clipped weighted means; fewer than three frames give the weighted mean."""
    base = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_sw"),
        (F.sum(c(weight) * c("v")) / F.greatest(F.sum(weight), F.lit(1e-9))).alias("_wm"))
    med = cut(stack_median(px, keys))
    mad = group_median(attach(px, med, keys).withColumn("_dev", F.abs(c("v") - c("value"))), keys, "_dev", "_mad")
    state = cut(med.join(mad, keys).join(base, keys))
    for _ in range(rounds):
        r = attach(px, state, keys)
        w = c(weight) / F.greatest(c("_sw"), F.lit(1e-12))
        near = F.abs(c("v") - c("value")) <= sigma * F.greatest(1.4826 * c("_mad"), F.lit(1e-6))
        state = cut(r.groupBy(*keys).agg(
            (F.sum(F.when(near, w * c("v")).otherwise(F.lit(0.0))) / F.greatest(
                F.sum(F.when(near, w).otherwise(F.lit(0.0))), F.lit(1e-9))).alias("value"),
            *[F.first(x).alias(x) for x in ("_mad", "_n", "_sw", "_wm")]))
    return state.select(*keys, F.when(c("_n") < 3, c("_wm")).otherwise(c("value")).alias("value"))


STACKERS = {
    "mean": lambda px, w: stack_mean(px),
    "median": lambda px, w: stack_median(px),
    "quality_weighted": stack_weighted,
    "winsorized": lambda px, w: stack_trimmed(px),
    "kappa_sigma": lambda px, w: stack_kappa_sigma(px),
}


def lucky_stack(px: DataFrame, scores: DataFrame, fraction: float, method: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, header): stack of the best fraction of frames with a noise map, the threshold and the number used.

    `scores` has one row per frame with `score`; unknown methods fall back to kappa-sigma.
    """
    sel = keep_largest(scores, ["capture_id"], "score", "_tie", F.bround(fraction * c("n")).cast("bigint")).where("kept")
    sel = cut(sel.select("capture_id", "frame_idx", "score"))
    chosen = px.join(sel, ["capture_id", "frame_idx"])
    stack = STACKERS.get(method, STACKERS["kappa_sigma"])(chosen, "score")
    noise = chosen.groupBy(*PIX).agg(F.stddev_pop("v").alias("noise"))
    head = sel.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_used"), F.min("score").alias("threshold"))
    return stack.join(noise, PIX), head


def frame_weight(sharpness, snr) -> Column:
    return F.greatest(as_col(sharpness), F.lit(1e-3)) * (0.25 + 0.75 * lock_confidence(snr))


def weighted_accumulators(px: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, consistency): weighted mean per pixel, and the RMS pixel scatter of each capture."""
    g = px.groupBy(*PIX).agg(
        (F.sum(c(weight) * c("v")) / F.sum(weight)).alias("value"),
        F.greatest(F.avg(c("v") * c("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)).alias("_var"))
    return g.drop("_var"), g.groupBy("capture_id").agg(F.sqrt(F.avg("_var")).alias("consistency"))


def turbulence_weights(frames: DataFrame, drift: str, beta: float) -> DataFrame:
    """Weight per frame from its drift: 1/(1+d) times exp(-beta D(d)), D at the capture's own scale."""
    d = frames.withColumns({"dx": c(drift), "dy": F.lit(0.0)})
    r0 = fried_parameter(d, ["capture_id"], "frame_idx", "frame_idx", 1024).select("capture_id", "r0")
    r = attach(frames, r0, ["capture_id"])
    scale = F.when(c("r0") > 0, c("r0")).otherwise(F.lit(10.0))
    q = F.when(c(drift) > 0, 1.0 / (1.0 + c(drift))).otherwise(F.lit(1.0))
    return r.withColumn("weight", q * F.exp(-beta * structure_function(c(drift), scale))).drop("r0")


def drizzle(px: DataFrame, factor: int, pixfrac: float, height: int, width: int) -> DataFrame:
    """Deposit shifted square drops on a finer grid: columns v, y, x, dy, dx, q. One row per touched cell, then sums."""
    side = factor * pixfrac
    cells = int(math.floor(side)) + 2
    ly, lx = (c("y") + c("dy") + 0.5) * factor - side / 2.0, (c("x") + c("dx") + 0.5) * factor - side / 2.0
    d = px.withColumns({"_ly": ly, "_lx": lx})
    span = F.sequence(F.lit(0), F.lit(cells - 1))
    d = d.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
    d = d.withColumns({"oy": c("_i") + F.floor("_ly").cast("int"), "ox": c("_j") + F.floor("_lx").cast("int")})
    over = lambda lo, o: F.greatest(F.least(c(lo) + side, c(o) + 1.0) - F.greatest(c(lo), c(o).cast("double")), F.lit(0.0))
    d = d.withColumn("_a", F.least(over("_ly", "oy"), F.lit(1.0)) * F.least(over("_lx", "ox"), F.lit(1.0)))
    d = d.where((c("_a") > 1e-12) & c("oy").between(0, height * factor - 1) & c("ox").between(0, width * factor - 1))
    w = c("q") * c("_a")
    return d.groupBy("capture_id", "oy", "ox").agg(F.sum(w * c("v")).alias("num"), F.sum(w).alias("den")).withColumn(
        "value", F.when(c("den") > 1e-12, c("num") / c("den")).otherwise(F.lit(0.0)))


def calibrate(px: DataFrame, dark: DataFrame, flat: DataFrame) -> DataFrame:
    """Subtract the dark, divide by the flat over its median. Calibration frames hold one image: broadcast."""
    f = flat.groupBy().agg(F.percentile("f", 0.5).alias("_m"))
    flat = attach(flat, f, []).select("y", "x", (c("f") / (c("_m") + 1e-12)).alias("_f"))
    r = px.join(F.broadcast(dark), ["y", "x"], "left").join(F.broadcast(flat), ["y", "x"], "left")
    v = c("v") - F.coalesce("d", F.lit(0.0))
    return r.select("capture_id", "frame_idx", "y", "x", (v / F.when(F.abs("_f") > 1e-12, c("_f"))).alias("v"))


def cube_quality(px: DataFrame, min_frames: int, drop_max: float, clip_max: float, fill_min: float) -> DataFrame:
    """Capture check: frame count (one frame is exempt), flux drop, clipped share, disk fill."""
    per = px.groupBy("capture_id", "frame_idx").agg(F.avg("v").alias("m"), F.sum("v").alias("_s"))
    g = per.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("m").alias("mean_flux"),
        (1.0 - F.min("m") / (F.max("m") + 1e-12)).alias("flux_drop"))
    top = order_statistics(px, ["capture_id"], "v", {"_t": F.floor((c("n") - 1) * 0.9999)}).select("capture_id", "_t")
    r = attach(px, top, ["capture_id"])
    sat = F.when(c("_t") > 1000, F.lit(65535.0)).when(c("_t") > 1.5, F.lit(255.0)).otherwise(F.lit(1.0))
    s = r.groupBy("capture_id").agg(
        F.avg((c("v") >= 0.98 * sat).cast("double")).alias("clip_frac"),
        F.avg((c("v") >= 0.25 * c("_t")).cast("double")).alias("disk_fill"))
    q = g.join(s, "capture_id")
    reasons = F.array_compact(F.array(
        F.when((c("n_frames") < min_frames) & (c("n_frames") > 1), F.lit("few_frames")),
        F.when((c("n_frames") > 5) & (c("flux_drop") > drop_max), F.lit("flux_drop")),
        F.when(c("clip_frac") > clip_max, F.lit("clipped")), F.when(c("disk_fill") < fill_min, F.lit("no_disk"))))
    return q.withColumn("reasons", F.array_join(reasons, ",")).withColumn("ok", c("reasons") == "")
