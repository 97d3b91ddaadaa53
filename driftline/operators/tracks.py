"""Alignment-point tracks to wind profiles, jets and per-frame drift models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import planets as PL
from driftline.functions.angles import FLATTENING, as_col, clip

from .skew import Timeline, attach, attach_small, counted_median, cut, group_median, group_quantiles

N_BINS = 11


def lat_bin(lat, n_bins: int = N_BINS, top: float = 90.0) -> Column:
    """Equal-width bin of |lat|, the last one closed."""
    return F.least(F.floor(F.abs(as_col(lat)) / (top / n_bins)), F.lit(n_bins - 1)).cast("int")


def bin_skeleton(groups: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Every bin of every group, so that bins without rows appear."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))
    return groups.select("*", bins.alias("bin")).withColumn("abs_lat", (F.col("bin") + 0.5) * (90.0 / n_bins))


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("dx").isNotNull() & ~F.isnan("dx") & (F.col("snr") > 0.05) & (F.abs("dt_s") > 1e-9))


def gate_track(x, y, xc, yc, a_eq, dx, dy, prior_dx, prior_dy=0.0, limb_rr=0.93, floor_px=2.0, frac=0.3) -> Column:
    """Track passes if its point is well inside the limb and its residual to the prior is small."""
    u = (as_col(x) - as_col(xc)) / (as_col(a_eq) + 1e-12)
    v = (as_col(yc) - as_col(y)) / (as_col(a_eq) * (1.0 - FLATTENING) + 1e-12)
    pdx, pdy = as_col(prior_dx), as_col(prior_dy)
    lim = F.greatest(F.lit(floor_px), frac * (F.abs(pdx) + F.abs(pdy)) + 1.0)
    ok = (u * u + v * v <= limb_rr) & (F.abs(as_col(dx) - pdx) <= lim) & (F.abs(as_col(dy) - pdy) <= lim)
    return F.coalesce(ok, F.lit(False))


def wind_bins(tracks: DataFrame, by: list[str], planet: str, a_eq_px: float, n_bins: int = N_BINS) -> DataFrame:
    """Residual wind per |lat| bin: median of track winds after two rounds of 3.5 sigma MAD rejection.

    A bin stops when nothing is rejected or fewer than three tracks would stay; it then keeps the old median, as the
    last rejection still applies to the scatter. Bins without tracks stay NULL.
    """
    t = PL.with_constants(usable(tracks), planet).withColumn("u", PL.wind_at("ap_lat"))
    rate = -F.col("dx") / (F.col("dt_s") * PL.px_per_deg_lon("ap_lat", a_eq_px))
    du = F.radians(rate - PL.cloud_rate("ap_lat", "u")) * PL.parallel_radius_m("ap_lat")
    k = [*by, "bin"]
    rows = t.select(*by, "frame_idx", lat_bin("ap_lat", n_bins).alias("bin"), du.alias("du"))
    frames = rows.groupBy(*k, "frame_idx").agg(F.lit(1).alias("_one")).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_frames"))
    # from here on a value is one row, and the rounds are limits per bin that every value is held against
    counts = cut(rows.where(F.col("bin").isNotNull()).groupBy(*k, "du").agg(F.count(F.lit(1)).alias("c")))
    seen = cut(counts.groupBy(*k).agg(F.sum("c").alias("n_tracks")))
    state = counted_median(counts, k, F.col("du"), "c", "med").join(seen.withColumnRenamed("n_tracks", "_n"), k)
    state = cut(state.withColumn("done", F.lit(False)))

    def held(s: DataFrame, rounds: int) -> DataFrame:
        """The values that no limit of the rounds rejects."""
        r, kept = attach_small(counts, s, k), F.lit(True)
        for i in range(rounds):
            kept = kept & (F.col(f"_done{i}") | (F.abs(F.col("du") - F.col(f"_med{i}")) <= F.col(f"_lim{i}")))
        return r.where(kept)

    def spread(s: DataFrame, rounds: int) -> DataFrame:
        return counted_median(held(s, rounds), k, F.abs(F.col("du") - F.col("med")), "c", "mad")

    for i in range(2):
        lim = 3.5 * F.greatest(1.4826 * F.col("mad"), F.lit(1e-6))
        s = state.join(spread(state, i), k).withColumns({f"_done{i}": F.col("done"), f"_med{i}": F.col("med"), f"_lim{i}": lim})
        s = cut(s.drop("mad"))
        # a limit keeps the value nearest to the median, so no bin is lost here
        s = s.join(counted_median(held(s, i + 1), k, F.col("du"), "c", "_new", "_n1"), k)
        s = s.withColumn("done", F.col("done") | (F.col("_n") == F.col("_n1")) | (F.col("_n1") < 3))
        state = cut(s.withColumns({"med": F.when(F.col("done"), F.col("med")).otherwise(F.col("_new")), "_n": F.col("_n1")}).drop("_new", "_n1"))
    final = state.select(*k, "med").join(spread(state, 2), k).join(seen, k).join(frames, k)
    final = cut(final)
    whole = PL.with_constants(bin_skeleton(tracks.select(*by).distinct(), n_bins).join(final, k, "left"), planet)
    scale = F.radians(PL.parallel_radius_m("abs_lat"))
    whole = whole.withColumn("u", PL.wind_at("abs_lat"))
    model = PL.cloud_rate("abs_lat", "u")
    std = 1.4826 * F.col("mad")
    return whole.select(
        *by, "bin", "abs_lat", (model + F.col("med") / scale).alias("rate"), (std / scale).alias("rate_std"),
        model.alias("model_rate"), F.col("med").alias("resid"), std.alias("resid_std"),
        F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
    )


def evidence_bins(bins: DataFrame) -> DataFrame:
    return bins.where(F.col("resid").isNotNull() & F.col("resid_std").isNotNull()).withColumn(
        "resid_std", F.greatest("resid_std", F.lit(1e-9)))


def weighted_offset(df: DataFrame, by: list[str], value: Column, sigma: Column) -> DataFrame:
    """Inverse-variance mean, its error and chi-square; groups of at least two rows."""
    w = 1.0 / (sigma * sigma)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * value).alias("_wx"))
    r = attach(df.withColumns({"_v": value, "_s": sigma}), g, by).withColumn("_mu", F.col("_wx") / F.col("_w"))
    dev = (F.col("_v") - F.col("_mu")) / F.col("_s")
    return r.where("n >= 2").groupBy(*by).agg(
        F.max("n").alias("n_bins"), F.max("_mu").alias("mean"), F.max(1.0 / F.sqrt("_w")).alias("sigma"),
        F.sum(dev * dev).alias("chi2"),
    ).withColumn("reduced_chi2", F.col("chi2") / F.greatest(F.col("n_bins") - 1, F.lit(1)))


def offsets(bins: DataFrame, by: list[str], planet: str) -> DataFrame:
    """Uniform wind offset and uniform angular offset with the period correction it implies."""
    e = PL.with_constants(evidence_bins(bins), planet)
    fac = F.degrees(F.lit(86400.0)) / PL.parallel_radius_m("abs_lat")
    wind = weighted_offset(e, by, F.col("resid"), F.col("resid_std")).select(
        *by, "n_bins", F.col("mean").alias("u0_mps"), F.col("sigma").alias("u0_std"), F.col("reduced_chi2").alias("u0_rchi2"))
    ang = weighted_offset(e, by, F.col("resid") * fac, F.col("resid_std") * fac).select(
        *by, F.col("mean").alias("d_omega"), F.col("sigma").alias("d_omega_std"), F.col("reduced_chi2").alias("d_omega_rchi2"))
    out = PL.with_constants(wind.join(ang, by), planet)
    turn = PL.rotation_rate() * 86400.0
    return out.withColumns({
        "period_correction_s": -F.col("period_s") * F.col("d_omega") / turn,
        "equator_u": F.radians("d_omega") / 86400.0 * PL.parallel_radius_m(F.lit(0.0)),
        "preferred": F.when(F.col("d_omega_rchi2") < F.col("u0_rchi2"), F.lit("angular")).otherwise(F.lit("uniform_mps")),
    }).drop("req_km", "rpol_km", "period_s", "wind")


def profile_summary(bins: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("resid")
    n = F.count(r)
    return bins.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bins_total"), n.alias("n_evidence"), F.sqrt(F.avg(r * r)).alias("rms"),
        F.max(F.abs(r)).alias("max_abs"),
        F.when(n >= 3, F.corr(F.when(r.isNotNull(), F.col("model_rate")), F.col("rate"))).alias("rate_corr"),
    )


def jets(bins: DataFrame, by: list[str], bin_width: float, k_sigma: float = 3.0) -> DataFrame:
    """Strict local extrema between adjacent evidence bins, at least k sigma, refined by a parabola.

    The width counts neighbouring bins that keep the sign and more than half the peak; a missing bin ends the walk.
    A profile has a fixed handful of bins.
    """
    w = Window.partitionBy(*by).orderBy("bin")
    rows = F.array_sort(F.collect_list(F.struct("bin", "resid")).over(Window.partitionBy(*by)))
    b = bins.withColumns({"_all": rows, "_p": F.lag("resid").over(w), "_n": F.lead("resid").over(w)})
    c, p, n, s = F.col("resid"), F.col("_p"), F.col("_n"), F.greatest(F.col("resid_std"), F.lit(1e-9))
    peak = ((c > p) & (c > n)) | ((c < p) & (c < n))
    j = b.where(F.col("resid_std").isNotNull() & peak & (F.abs(c) >= k_sigma * s))
    denom = p - 2.0 * c + n
    j = j.withColumn("_shift", clip(F.when(F.abs(denom) > 1e-12, 0.5 * (p - n) / denom).otherwise(F.lit(0.0)), -1.0, 1.0))
    j = j.withColumn("u_mps", c - 0.25 * (p - n) * F.col("_shift"))
    ends = F.filter("_all", lambda x: F.coalesce(
        ~((x["resid"] * F.col("u_mps") > 0) & (F.abs(x["resid"]) > F.abs(F.col("u_mps") / 2.0))), F.lit(True)))
    j = j.withColumn("_ends", ends)
    left = F.coalesce(F.array_max(F.transform(F.filter("_ends", lambda x: x["bin"] < F.col("bin")), lambda x: x["bin"])),
                      F.lit(-1))
    last = F.array_max(F.transform("_all", lambda x: x["bin"]))
    right = F.coalesce(F.array_min(F.transform(F.filter("_ends", lambda x: x["bin"] > F.col("bin")), lambda x: x["bin"])),
                       last + 1)
    return j.select(
        *by, "bin", (F.col("abs_lat") + F.col("_shift") * bin_width).alias("abs_lat"), "u_mps",
        F.col("resid_std").alias("std_mps"), (F.abs("u_mps") / s).alias("significance"),
        F.when(F.col("u_mps") > 0, F.lit("prograde")).otherwise(F.lit("retrograde")).alias("direction"),
        ((right - left - 1) * bin_width).alias("fwhm"),
    )


def dx_profile(tracks: DataFrame, by: list[str], dt: Column, planet: str, a_eq_px: float, n_bins: int = N_BINS):
    """Shift to apply per |lat| bin and frame: clipped weighted mean, model where empty, smoothed, bounded.

    The bound on a bin uses its left neighbour after that one was bounded, so the last step folds over the bins of a
    frame, a fixed-length array.
    """
    k = [*by, "bin"]
    frames = tracks.select(*by).distinct().withColumn("_dt", dt)
    good = tracks.where(F.col("dx").isNotNull() & ~F.isnan("dx") & (F.col("snr") > 0.05)).select(
        *by, lat_bin("ap_lat", n_bins).alias("bin"), "dx", "dy", "snr")
    counts = cut(good.groupBy(*k, "dx", "snr").agg(F.count(F.lit(1)).alias("c")))
    r = attach_small(counts, counted_median(counts, k, F.col("dx"), "c", "_med"), k)
    mad = counted_median(r, k, F.abs(F.col("dx") - F.col("_med")), "c", "_mad")
    r = attach_small(r, mad, k)
    w = F.when(F.abs(F.col("dx") - F.col("_med")) < 3.0 * 1.4826 * (F.col("_mad") + 1e-9), F.col("snr") * F.col("c"))
    meas = r.groupBy(*k).agg(
        (-F.coalesce(F.sum(w * F.col("dx")) / (F.sum(w)), F.max("_med"))).alias("_dx"))
    whole = PL.with_constants(bin_skeleton(frames, n_bins).join(meas, k, "left"), planet).withColumn("u", PL.wind_at("abs_lat"))
    drift = PL.drift_px("abs_lat", "_dt", a_eq_px, "u")
    per = Window.partitionBy(*by)  # a frame has n_bins rows here
    near, order = per.orderBy("bin").rangeBetween(-1, 1), per.orderBy("bin")
    b = whole.select(
        *by, "bin", F.col("_dx").isNotNull().alias("filled"), F.coalesce("_dx", -drift).alias("dx"),
        (2.0 * F.abs(drift) + 1.5).alias("lim"),
    )
    only = lambda v: F.when(F.col("filled"), v)
    b = b.withColumn("_nf", F.count_if("filled").over(per)).withColumn("_m3", F.avg(only(F.col("dx"))).over(near))
    b = b.withColumn("s", F.when(F.col("filled") & (F.col("_nf") >= 3), F.col("_m3")).otherwise(F.col("dx")))
    b = b.withColumns({
        "mm": F.coalesce(F.median(only(F.abs("s"))).over(per), F.lit(0.0)), "sr": F.abs(F.lead(only(F.col("s"))).over(order)),
    })
    one = b.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "filled", "s", "lim", "mm", "sr"))).alias("_c"))

    def bounded(acc, x):
        left = F.abs(F.element_at(acc, -1)["keep"])
        v = F.array_sort(F.array_compact(F.array(F.abs(x["s"]), left, x["sr"])))
        n = F.size(v)
        mid = F.when(n == 1, F.get(v, F.lit(0))).when(n == 2, (F.get(v, F.lit(0)) + F.get(v, F.lit(1))) / 2.0).otherwise(
            F.get(v, F.lit(1)))
        lim = F.when(x["filled"], F.greatest(x["lim"], F.least(2.0 * mid + 1.5, 3.0 * x["mm"] + 1.5))).otherwise(x["lim"])
        dx = F.least(F.greatest(x["s"], -lim), lim)
        step = F.struct(
            x["bin"].alias("bin"), x["filled"].alias("filled"), dx.alias("dx"), F.when(x["filled"], dx).alias("keep"))
        return F.concat(acc, F.array(step))

    none = F.array(F.struct(
        F.lit(-1).alias("bin"), F.lit(False).alias("filled"), F.lit(None).cast("double").alias("dx"),
        F.lit(None).cast("double").alias("keep"))).cast("array<struct<bin:int,filled:boolean,dx:double,keep:double>>")
    out = one.select(*by, F.explode(F.aggregate("_c", none, bounded)).alias("e")).select(
        *by, "e.bin", "e.filled", F.col("e.dx").alias("dx_apply")).where("bin >= 0")
    # One latitude shift per frame: clipped mean of dy. Only built here, so that a query without it does not pay for it.
    g = attach(good, group_median(good, by, "dy", "_med"), by)
    md = group_median(g.withColumn("_dev", F.abs(F.col("dy") - F.col("_med"))), by, "_dev", "_mad")
    g = attach(g, md, by)
    dy = F.when(F.abs(F.col("dy") - F.col("_med")) < 3.0 * 1.4826 * (F.col("_mad") + 1e-9), F.col("dy"))
    shift = g.groupBy(*by).agg((-F.coalesce(F.avg(dy), F.max("_med"))).alias("dy_apply"))
    return out, shift


def rigid_rotation(df: DataFrame, by: list[str], xc, yc) -> DataFrame:
    """Least-squares angle per group; columns x, y, dx, dy. Fewer than two points give zero."""
    x, y = F.col("x") - as_col(xc), F.col("y") - as_col(yc)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * F.col("dy") - y * F.col("dx")).alias("_num"),
        F.sum(x * x + y * y).alias("_den"))
    theta = F.when((F.col("n") >= 2) & (F.col("_den") >= 1e-12), F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    return g.select(*by, "n", theta.alias("theta"))


def rotation_residual(df: DataFrame, by: list[str], xc: float, yc: float) -> DataFrame:
    """RMS distance from the rigid-rotation model in the equatorial band, in degrees; NULL below three tracks."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"))
    band = df.where(F.abs(F.col("y") - yc) < 0.4 * yc)
    fit = rigid_rotation(band, by, xc, yc).drop("n")
    r = attach(band, fit, by)
    x, y = F.col("x") - xc, F.col("y") - yc
    ex, ey = F.col("dx") + F.col("theta") * y, F.col("dy") - F.col("theta") * x
    per_px = 90.0 / max(math.hypot(2 * xc, 2 * yc), 1.0)
    out = r.groupBy(*by).agg((F.sqrt(F.avg(ex * ex + ey * ey)) * per_px).alias("rms_deg"))
    return total.join(out, by, "left").select(*by, F.when(F.col("n_all") >= 3, F.col("rms_deg")).alias("rms_deg"))


def frame_summary(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Drift RMS, mean snr, snr-weighted shift (snr above 0.05) per frame."""
    w = F.when(F.col("snr") > 0.05, F.col("snr"))
    move = lambda v: F.coalesce(-F.sum(w * F.col(v)) / F.sum(w), F.lit(0.0))
    return tracks.groupBy(*by).agg(
        F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("rms"), F.avg("snr").alias("snr"),
        move("dy").alias("dy"), move("dx").alias("dx"), F.count(F.lit(1)).alias("n"))


def fried_parameter(df: DataFrame, by: list[str], order: str, tie: str, span: int) -> DataFrame:
    """r0 in pixels from the median step between neighbouring drift vectors and the scatter of their lengths."""
    r = Timeline(df, by, order, tie, span).neighbour({"_px": "dx", "_py": "dy"}).df
    r = cut(r.withColumn("_step", F.hypot(F.col("dx") - F.col("_px"), F.col("dy") - F.col("_py"))))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.hypot("dx", "dy")).alias("rms"))
    d = g.join(group_median(r, by, "_step", "d"), by)
    ok = (F.col("n") >= 2) & (F.col("rms") >= 1e-6) & (F.col("d") >= 1e-6)
    r0 = F.col("d") * F.pow(0.43 / (F.col("rms") * F.col("rms")), F.lit(0.6))
    return d.select(*by, "n", "d", "rms", F.when(ok, F.greatest(F.lit(0.5), r0)).otherwise(F.lit(0.0)).alias("r0"))


def forensics(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """Stack report per capture from per-frame usage and shifts; columns usage, dy, dx and a frame order.

    Usage spread and concentration, drift slope and wander about a line, largest jump, sub-pixel dither, nominal gain.
    """
    f = cut(frames)
    t = F.col(order).cast("double")
    fr = lambda v: F.least(F.abs(F.col(v) - F.bround(v)), 1.0 - F.abs(F.col(v) - F.bround(v)))
    g = f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("usage").alias("usage_min"), F.max("usage").alias("usage_max"),
        (F.max("usage") / F.sum("usage")).alias("concentration"), F.avg("usage").alias("_use"),
        F.regr_slope("dy", t).alias("_sy"), F.regr_slope("dx", t).alias("_sx"), F.avg(t).alias("_tm"),
        F.avg("dy").alias("_my"), F.avg("dx").alias("_mx"),
        ((F.stddev_pop(fr("dy")) + F.stddev_pop(fr("dx"))) / 2.0).alias("dither"),
    )
    med = group_quantiles(f, by, "usage", {"usage_median": 0.5}).drop("n")
    r = attach(f, g, by)
    off = t - F.col("_tm")
    ry, rx = F.col("dy") - F.col("_my") - F.col("_sy") * off, F.col("dx") - F.col("_mx") - F.col("_sx") * off
    wander = r.groupBy(*by).agg(F.sqrt(F.avg((ry * ry + rx * rx) / 2.0)).alias("wander"))
    j = Timeline(f, by, order, order, 1024).neighbour({"_py": "dy", "_px": "dx"}).df
    jump = j.groupBy(*by).agg(
        F.coalesce(F.max(F.hypot(F.col("dy") - F.col("_py"), F.col("dx") - F.col("_px"))), F.lit(0.0)).alias("max_jump"))
    s = g.join(med, by).join(wander, by).join(jump, by).withColumns({
        "slope": F.hypot("_sy", "_sx"), "snr_gain": F.sqrt(F.greatest(F.col("n") * F.col("_use"), F.lit(1e-9))),
    })
    warn = F.array_compact(F.array(
        F.when((F.col("n") >= 6) & (F.col("concentration") > 0.30), F.lit("one_frame_dominates")),
        F.when((F.col("n") >= 6) & (F.col("usage_max") - F.col("usage_min") < 0.02), F.lit("usage_flat")),
        F.when(F.col("wander") > 3.0, F.lit("wander")), F.when(F.col("max_jump") > 25.0, F.lit("jump")),
        F.when((F.col("usage_min") < 0.005) & (F.col("n") >= 8), F.lit("unused_frames")),
    ))
    return s.withColumn("warnings", F.array_join(warn, ",")).drop("_use", "_sy", "_sx", "_tm", "_my", "_mx")
