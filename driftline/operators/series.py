"""Longitude series per feature: unwrap, weighted fits, clipping, prediction, interpolation, periodogram.

Sums combine map-side; ordered steps run on (series, time span) through `Timeline`; medians come from order statistics.
A series may therefore be any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.angles import sky_error_arcsec, wrap_deg, wrap_diff

from .skew import IN_TASK, Timeline, attach, attach_small, by_length, cut, group_median, median_in_place, order_statistics

DAY_US = 86_400_000_000


def timeline(df: DataFrame, by: list[str], t: str = "t_us", tie: str = "ord", span=DAY_US) -> Timeline:
    return Timeline(df, by, t, tie, span)


def unwrap(df: DataFrame, by: list[str], lon: str, out: str = "lon_u", t: str = "t_us", tie: str = "ord") -> DataFrame:
    """Continuous longitude: the first value plus the running sum of wrapped steps; keeps the step as `step`."""
    line = timeline(df, by, t, tie).neighbour({"_prev": lon})
    step = wrap_diff(lon, "_prev")
    stepped = line.df.withColumn("step", step).withColumn("_inc", F.coalesce("step", F.col(lon))).drop("_prev")
    return timeline(stepped, by, t, tie).running_sum({out: "_inc"}).df.drop("_inc")


def step_summary(df: DataFrame, by: list[str], lon: str, lat: str, warn_deg: float = 90.0) -> DataFrame:
    """Largest consecutive move per series, and whether any longitude step is too large to unwrap safely."""
    r = timeline(df, by).neighbour({"_plon": lon, "_plat": lat}).df
    d = wrap_diff(lon, "_plon")
    return r.groupBy(*by).agg(
        F.coalesce(F.max(F.abs(d)) > warn_deg, F.lit(False)).alias("unwrap_warning"),
        F.max(F.hypot(d, F.col(lat) - F.col("_plat"))).alias("max_jump"),
    )


def linear_fit(t: Column, y: Column, w: Column, kept: Column | None = None) -> dict[str, Column]:
    """Aggregates of a weighted straight-line fit over the `kept` rows; turn them into coefficients with `line_from_sums`."""
    of = (lambda v: v) if kept is None else (lambda v: F.when(kept, v))
    return {
        "_n": F.count(of(y)), "_w": F.sum(of(w)), "_wt": F.sum(of(w * t)), "_wy": F.sum(of(w * y)), "_wtt": F.sum(of(w * t * t)),
        "_wty": F.sum(of(w * t * y)), "_wyy": F.sum(of(w * y * y)),
    }


def line_from_sums(df: DataFrame, keep: list[str]) -> DataFrame:
    """a, b and their errors scaled by the residuals, from the sums of `linear_fit`. Two points give zero error."""
    s = {k: F.col(k) for k in ("_n", "_w", "_wt", "_wy", "_wtt", "_wty", "_wyy")}
    mt, my = s["_wt"] / s["_w"], s["_wy"] / s["_w"]
    stt = s["_wtt"] - s["_wt"] * mt
    b = F.try_divide(s["_wty"] - s["_wt"] * my, F.when(F.abs(stt) > 1e-12, stt))
    syy = F.greatest(s["_wyy"] - s["_wy"] * my, F.lit(0.0))
    rss = F.greatest(syy - b * (s["_wty"] - s["_wt"] * my), F.lit(0.0))
    chi2 = rss / F.greatest(s["_n"] - 2, F.lit(1))
    return df.select(
        *keep, F.col("_n").alias("n"), (my - b * mt).alias("a"), b.alias("b"),
        F.sqrt(chi2 * (1.0 / s["_w"] + mt * mt / stt)).alias("sigma_a"), F.sqrt(chi2 / stt).alias("sigma_b"),
        mt.alias("t_mean"), rss.alias("wrss"),
    )


def fit_lines(df: DataFrame, by: list[str], t: Column, y: Column, w: Column) -> DataFrame:
    sums = df.groupBy(*by).agg(*[v.alias(k) for k, v in linear_fit(t, y, w).items()])
    return line_from_sums(sums, by)


def clipped_in_place(df: DataFrame, by: list[str], clip_sigma: float, rounds: int, least: int) -> DataFrame:
    """The rows `fit_drift` works on, for series that fit in a task each: one shuffle, and every round is a few windows on it."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy("t_us", "ord")
    rows = df.withColumns({"_prev": F.lag("lon").over(order), "_lon0": F.first("lon").over(order), "n_total": F.count(F.lit(1)).over(whole)})
    rows = rows.where(F.col("n_total") >= least).withColumn("step", wrap_diff("lon", "_prev"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "lon_u": F.sum(F.coalesce("step", "lon", F.lit(0.0))).over(upto), "t_ref_us": F.min("t_us").over(whole), "lat_ref": F.avg("lat").over(whole),
    })
    rows = drift_rows(rows.dropna(subset=[*by, "t_us"]), by)
    kept, w, names = F.col("kept"), 1.0 / (F.col("sigma") * F.col("sigma")), [x for x in rows.columns if x != "kept"]
    for _ in range(rounds):
        sums = linear_fit(F.col("t"), F.col("y"), w, kept)
        r = line_from_sums(rows.withColumns({k: v.over(whole) for k, v in sums.items()}), [*names, "kept"])
        r = r.withColumn("_sc", (F.col("y") - F.col("a") - F.col("b") * F.col("t")) / F.col("sigma")).select(*names, "kept", "_sc")
        r = median_in_place(r, by, F.when(kept, F.col("_sc")), "_med").withColumn("_dev", F.abs(F.col("_sc") - F.col("_med")))
        r = median_in_place(r, by, F.when(kept, F.col("_dev")), "_mad")
        far = F.col("_dev") > clip_sigma * F.greatest(1.4826 * F.col("_mad"), F.lit(1e-6))
        rows = r.withColumn("kept", kept & ~far).select(*names, "kept")
    return cut(rows)


def drift_rows(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(
        *by, "t_us", "ord", "lon", "lat_ref", "t_ref_us", "n_total", "_lon0", F.abs("step").alias("_step"),
        ((F.col("t_us") - F.col("t_ref_us")) / float(DAY_US)).alias("t"),
        (F.col("lon_u") - F.col("_lon0")).alias("y"),
        F.greatest("sigma", F.lit(1e-3)).alias("sigma"), F.lit(True).alias("kept"),
    )


def clipped_by_rounds(df: DataFrame, by: list[str], clip_sigma: float, rounds: int, least: int) -> DataFrame:
    """The same rows for series of any length: medians by order statistics, a checkpoint a round."""
    start = df.groupBy(*by).agg(
        F.min("t_us").alias("t_ref_us"), F.count(F.lit(1)).alias("n_total"), F.avg("lat").alias("lat_ref"),
        F.min_by("lon", F.struct("t_us", "ord")).alias("_lon0"),
    ).where(F.col("n_total") >= least)
    rows = cut(drift_rows(attach_small(unwrap(df, by, "lon"), cut(start), by, "inner"), by))
    w = 1.0 / (F.col("sigma") * F.col("sigma"))
    for _ in range(rounds):
        fit = fit_lines(rows.where("kept"), by, F.col("t"), F.col("y"), w)
        r = attach_small(rows, cut(fit.select(*by, "a", "b")), by)
        r = r.withColumn("_sc", (F.col("y") - F.col("a") - F.col("b") * F.col("t")) / F.col("sigma")).drop("a", "b")
        r = attach_small(r, cut(group_median(r.where("kept"), by, "_sc", "_med")), by)
        dev = r.where("kept").withColumn("_dev", F.abs(F.col("_sc") - F.col("_med")))
        r = attach_small(r, cut(group_median(dev, by, "_dev", "_mad")), by)
        far = F.abs(F.col("_sc") - F.col("_med")) > clip_sigma * F.greatest(1.4826 * F.col("_mad"), F.lit(1e-6))
        rows = cut(r.withColumn("kept", F.col("kept") & ~far).drop("_sc", "_med", "_mad"))
    return rows


def fit_drift(df: DataFrame, by: list[str], clip_sigma: float = 3.0, rounds: int = 3, least: int = 3, in_task: int = IN_TASK):
    """(fits, points): clipped weighted drift fits and the points with their `kept` flag.

    Columns t_us, ord, lon, lat, sigma. Each round fits the kept points, standardises the residuals and drops those
    beyond `clip_sigma` robust sigmas of their median. A quadratic control is fitted to what is left. Series of at most
    `in_task` points go through the rounds in one task, without a shuffle between them; longer ones spread over many.
    """
    parts = [f(d, by, clip_sigma, rounds, least) for f, d in zip((clipped_in_place, clipped_by_rounds), by_length(df, by, in_task)) if d is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = 1.0 / (F.col("sigma") * F.col("sigma"))

    def line(points: DataFrame) -> DataFrame:
        return fit_lines(points.where("kept"), by, F.col("t"), F.col("y"), w)

    lin = cut(line(rows).where(F.col("n") >= least).drop("wrss"))
    r = attach_small(rows.where("kept"), lin.select(*by, "a", "b", "t_mean"), by, "inner")
    res = F.col("y") - F.col("a") - F.col("b") * F.col("t")
    u = F.col("t") - F.col("t_mean")
    sums = {"_s0": w, "_s1": w * u, "_s2": w * u * u, "_s3": w * u * u * u, "_s4": w * u * u * u * u,
            "_y0": w * F.col("y"), "_y1": w * u * F.col("y"), "_y2": w * u * u * F.col("y")}
    second = r.groupBy(*by).agg(
        F.sqrt(F.avg(res * res)).alias("rms"), F.sum(w * res * res).alias("_chi_l"),
        *[F.sum(v).alias(k) for k, v in sums.items()],
    )
    s = {k: F.col(k) for k in sums}

    def det(m):
        (a, b, c_), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c_ * (d * h - e * g)

    base = [[s["_s0"], s["_s1"], s["_s2"]], [s["_s1"], s["_s2"], s["_s3"]], [s["_s2"], s["_s3"], s["_s4"]]]
    rhs = [s["_y0"], s["_y1"], s["_y2"]]
    d0 = det(base)
    coef = []
    for j in range(3):
        m = [[rhs[i] if k == j else base[i][k] for k in range(3)] for i in range(3)]
        coef.append(F.try_divide(det(m), F.when(F.abs(d0) > 1e-12, d0)))
    quad = cut(second.select(*by, "rms", "_chi_l", *[x.alias(n) for x, n in zip(coef, ("_q0", "_q1", "_q2"))]))
    q = attach_small(r.select(*by, "ord", "t", "t_mean", "y", "sigma"), quad, by)
    rq = F.col("y") - F.col("_q0") - F.col("_q1") * u - F.col("_q2") * u * u
    third = q.groupBy(*by).agg(F.sum(w * rq * rq).alias("_chi_q"))
    info = rows.groupBy(*by).agg(
        F.first("t_ref_us").alias("t_ref_us"), F.first("n_total").alias("n_total"), F.first("lat_ref").alias("lat_ref"),
        F.first("_lon0").alias("_lon0"), F.coalesce(F.max("_step") > 90.0, F.lit(False)).alias("unwrap_warning"),
    )
    f = lin.join(info, by).join(quad, by).join(third, by)
    six = F.col("n") >= 6
    dq = F.greatest(F.col("n") - 3, F.lit(1))
    fstat = (F.col("_chi_l") - F.col("_chi_q")) / F.greatest(F.col("_chi_q") / dq, F.lit(1e-12))
    tm = F.col("t_mean")
    f = f.withColumns({
        "f_stat": F.when(six, fstat),
        "quad_a": F.when(six, F.col("_lon0") + F.col("_q0") - F.col("_q1") * tm + F.col("_q2") * tm * tm),
        "quad_b": F.when(six, F.col("_q1") - 2.0 * F.col("_q2") * tm),
        "quad_c": F.when(six, F.col("_q2")),
    })
    model = F.when(F.coalesce(F.col("f_stat") > 4.0, F.lit(False)), F.lit("quadratic")).otherwise(F.lit("linear"))
    fits = f.select(
        *by, "t_ref_us", wrap_deg(F.col("_lon0") + F.col("a")).alias("lon0"), F.col("b").alias("rate"),
        F.col("sigma_b").alias("sigma_rate"), "n_total", F.col("n").alias("n_used"), "rms",
        (F.col("_chi_l") / F.greatest(F.col("n") - 2, F.lit(1))).alias("reduced_chi2"), "lat_ref", "unwrap_warning",
        "f_stat", "quad_a", "quad_b", "quad_c", model.alias("model"),
    )
    return fits, rows.select(*by, "t_us", "ord", "lon", "kept")


def predict(fits: DataFrame, days_from_ref: Column) -> DataFrame:
    """Longitude and one-sigma cone at given days after each fit's reference."""
    f = fits.withColumn("days", days_from_ref)
    d = F.col("days")
    quad = F.col("quad_a") + F.col("quad_b") * d + F.col("quad_c") * d * d
    raw = F.when(F.col("model") == "quadratic", quad).otherwise(F.col("lon0") + F.col("rate") * d)
    cone = F.hypot(F.col("sigma_rate") * F.greatest(d, F.lit(0.0)), F.col("rms"))
    return f.withColumns({"pred_lon": wrap_deg(raw), "pred_sigma": cone})


def differential_series(df: DataFrame, by: list[str], ref_index: int, distance_au: float):
    """(points, header): differences from a reference epoch, straight-line models and residual RMS."""
    t_ref = order_statistics(df, by, "t_us", {"_tr": F.least(F.lit(ref_index), F.col("n") - 1)}).select(
        *by, F.col("_tr").cast("bigint").alias("ref_t"))
    rows = attach(df, t_ref, by)
    ref = rows.where("t_us = ref_t").groupBy(*by).agg(
        F.min_by(F.struct("lon", "lat", "ord"), "ord").alias("ref"))
    rows = cut(attach(rows, ref, by).select(
        *by, "t_us", "ord", "lon", "lat", "sigma", F.col("ref.ord").alias("ref_ord"),
        ((F.col("t_us") - F.col("ref_t")) / float(DAY_US)).alias("days"), wrap_diff("lon", "ref.lon").alias("dlon"),
        (F.col("lat") - F.col("ref.lat")).alias("dlat"),
    ))
    s = F.greatest("sigma", F.lit(0.05))
    w = 1.0 / (s * s)
    rows = rows.withColumn("dsky", sky_error_arcsec("dlon", "dlat", "lat", distance_au))
    lon = fit_lines(rows, by, F.col("days"), F.col("dlon"), w).select(
        *by, F.col("a").alias("_a"), F.col("b").alias("drift_lon"), F.col("sigma_b").alias("drift_sigma"))
    lat = fit_lines(rows, by, F.col("days"), F.col("dlat"), F.lit(1.0)).select(
        *by, F.col("a").alias("_aa"), F.col("b").alias("drift_lat"))
    model = lon.join(lat, by)
    pts = attach(rows, model, by).withColumns({
        "model_dlon": F.col("_a") + F.col("drift_lon") * F.col("days"),
        "model_dlat": F.col("_aa") + F.col("drift_lat") * F.col("days"),
    }).withColumn("residual", F.col("dlon") - F.col("model_dlon"))
    rs = sky_error_arcsec("residual", F.col("dlat") - F.col("model_dlat"), "lat", distance_au)
    head = pts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("ref_ord").alias("ref_ord"), F.first("drift_lon").alias("drift_lon"),
        F.first("drift_lat").alias("drift_lat"), F.first("drift_sigma").alias("drift_sigma"),
        F.sqrt(F.sum(w * F.col("residual") * F.col("residual")) / F.sum(w)).alias("rms_lon"),
        F.sqrt(F.avg(rs * rs)).alias("rms_sky"),
    )
    return pts.drop("_a", "_aa", "drift_lon", "drift_lat", "drift_sigma"), head


def interpolate_table(obs: DataFrame, table: DataFrame, by: list[str], span=DAY_US) -> DataFrame:
    """Observations with meridian, tilt and position angle interpolated between the bracketing table rows.

    Both tables share one ordered line per key; the last and next table row come from `Timeline.known`. Outside the
    table the end row is used. A distance is given only where both ends have one.
    """
    fields = F.struct("t_us", "cm", "sub_lat", "np_pa", "distance_au")
    none = F.lit(None).cast(table.select(fields.alias("f")).schema["f"].dataType)
    both = obs.select(*by, "t_us", "ord", none.alias("_row"), F.lit(True).alias("_obs")).unionByName(
        table.select(*by, "t_us", "ord", fields.alias("_row"), F.lit(False).alias("_obs"))
    )
    line = Timeline(both, by, "t_us", "ord", span)
    # Two passes over the same rows; each carries one summary row per span.
    r = line.known({"_p": "_row"}).known({"_q": "_row"}, forward=False).df.where("_obs")
    p, q = (lambda x: F.col(f"_p.{x}")), (lambda x: F.col(f"_q.{x}"))
    r = r.where(F.col("_p").isNotNull() | F.col("_q").isNotNull())
    both_in = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    u = F.when(both_in, (F.col("t_us") - p("t_us")) / F.greatest((q("t_us") - p("t_us")).cast("double"), F.lit(1e-3)))
    r = r.withColumn("_u", u)
    mix = lambda x: F.coalesce(p(x) + F.col("_u") * (q(x) - p(x)), p(x), q(x))
    dist = F.when(both_in, p("distance_au") + F.col("_u") * (q("distance_au") - p("distance_au"))).otherwise(
        F.coalesce(p("distance_au"), q("distance_au")))
    return r.select(
        *by, "ord", "t_us",
        F.coalesce(wrap_deg(p("cm") + F.col("_u") * wrap_diff(q("cm"), p("cm"))), p("cm"), q("cm")).alias("cm"),
        mix("sub_lat").alias("sub_lat"),
        F.coalesce(p("np_pa") + F.col("_u") * wrap_diff(q("np_pa"), p("np_pa")), p("np_pa"), q("np_pa")).alias("np_pa"),
        dist.alias("distance_au"),
    )


def detrend(df: DataFrame, by: list[str], t: Column, y: str) -> DataFrame:
    """Residuals of a straight line, with mean level, slope and residual RMS on each row."""
    d = df.withColumn("_t", t)
    f = d.groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col("_t")).alias("slope"), F.avg("_t").alias("_tm"), F.avg(y).alias("level"))
    r = attach(d, f, by).withColumn(
        "residual", F.col(y) - F.col("level") - F.coalesce("slope", F.lit(0.0)) * (F.col("_t") - F.col("_tm")))
    rms = r.groupBy(*by).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    return attach(r.drop("_t", "_tm"), rms, by)


def periodogram(df: DataFrame, by: list[str], t_days: Column, y: str, periods: list[float]) -> DataFrame:
    """Share of variance explained by a cosine plus a sine at each trial period. One pass of sums per period."""
    mean = df.groupBy(*by).agg(F.avg(y).alias("_m"))
    r = attach(df.withColumn("_t", t_days), mean, by).withColumn("_y", F.col(y) - F.col("_m"))
    r = r.select(*by, "_t", "_y", F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period"))
    r = r.withColumn("_x", 2.0 * math.pi / F.col("period") * F.col("_t"))
    r = r.withColumns({"_c": F.cos("_x"), "_s": F.sin("_x")})
    pairs = {"cc": "_c*_c", "ss": "_s*_s", "cs": "_c*_s", "cy": "_c*_y", "sy": "_s*_y", "yy": "_y*_y"}
    g = r.groupBy(*by, "period").agg(*[F.sum(F.expr(e)).alias(k) for k, e in pairs.items()])
    g = g.withColumns({"ac": F.col("cy") / (F.col("cc") + 1e-12), "as": F.col("sy") / (F.col("ss") + 1e-12)})
    rss = F.expr("yy - 2*ac*cy - 2*`as`*sy + ac*ac*cc + `as`*`as`*ss + 2*ac*`as`*cs")
    return g.select(*by, "period", (1.0 - rss / (F.col("yy") + 1e-12)).alias("power"))


def crossings(df: DataFrame, by: list[str], rel: str, min_gap_us: int = 3_600_000_000) -> DataFrame:
    """Downward zero crossings of a relative angle at the meridian, linear in its sine, at least a gap apart.

    The gap is measured to the last crossing that was kept.
    """
    r = timeline(df, by).neighbour({"_pt": "t_us", "_prel": rel}).df
    s0, s1 = F.sin(F.radians("_prel")), F.sin(F.radians(F.col(rel)))
    c0, c1 = F.cos(F.radians("_prel")), F.cos(F.radians(F.col(rel)))
    hit = r.where((s0 > 0.0) & (s1 <= 0.0) & (c0 + c1 > 0.0)).withColumn(
        "event_us", F.col("_pt") + (F.col("t_us") - F.col("_pt")) * (-s0) / (s1 - s0))
    return spaced(hit.select(*by, "ord", F.round("event_us").cast("bigint").alias("t_us")), by, min_gap_us)


#: Spans whose summaries meet in one row, and blocks of them likewise.
BLOCK_SPANS = 256


def _first_beyond(xs: Column, i: Column, gap: int) -> Column:
    """0-based index of the first element of a sorted time array more than a gap after element i; the size if there is none. By bisection."""
    t = F.get(xs, i) + F.lit(gap)
    bits = F.sequence(F.lit(1), F.ceil(F.log2(F.size(xs) + 1)).cast("int") + 1)

    def halve(s: Column, _) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        beyond = F.get(xs, F.least(mid, F.size(xs) - 1)) > t
        open_ = s["lo"] < s["hi"]
        return F.struct(
            F.when(open_ & ~beyond, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & beyond, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(bits, F.struct((i + 1).cast("int").alias("lo"), F.size(xs).alias("hi")), halve)["lo"]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _last_of_chains(xs: Column, gap: int) -> Column:
    """For each element of a sorted time array the last one of the chain that starts there, by pointer doubling."""
    places = F.sequence(F.lit(0), F.size(xs) - 1)
    step = F.transform(places, lambda i: _let(_first_beyond(xs, i, gap), lambda j: F.when(j < F.size(xs), j).otherwise(i.cast("int"))))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(xs) + 1)).cast("int") + 1)
    ends = F.aggregate(rounds, step, lambda p, _: F.when(F.exists(p, lambda i: F.get(p, i) != i), F.transform(p, lambda i: F.get(p, i))).otherwise(p))
    return F.transform(ends, lambda i: F.get(xs, i))


def _through(s: Column, last: Column, gap: int) -> Column:
    """The last kept time after a stretch of the line, from the last kept time before it (NULL: none yet).

    A stretch is (at, end, rest): times at which a chain can enter, the last kept time of each, and that of a chain which enters after all of them.
    """
    j = F.when(last.isNull(), 0).otherwise(F.size(F.filter(s["at"], lambda t: t <= last + F.lit(gap))))
    return F.when(j < F.size(s["at"]), F.get(s["end"], j)).otherwise(F.coalesce(s["rest"], last))


def spaced(events: DataFrame, by: list[str], min_gap_us: int, span: int | None = None) -> DataFrame:
    """The first event of each key and then each event more than a gap after the last one kept.

    Events shuffle on (key, span). In a span every event points to the first one beyond the gap, and pointer doubling gives the last event of each
    chain. A chain enters a span within a gap of its start or at the next event, so a span is summed up by few (entry, end)
    pairs. Summaries combine in blocks of `BLOCK_SPANS`, the blocks of a key in order; the way back tells each span the last event
    kept before it, and the span then finishes alone. However long a chain is, its spans are separate work.
    """
    gap, span = min_gap_us, max(span or DAY_US, min_gap_us)
    none = F.lit(None).cast("bigint")
    row = F.struct(F.col("t_us"), F.col("ord"), *[F.col(x) for x in events.columns if x not in ("t_us", "ord", *by)])
    spans = events.where("t_us is not null").groupBy(*by, F.floor(F.col("t_us") / F.lit(span)).cast("bigint").alias("_ch")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    spans = cut(spans.withColumn("_xs", F.transform("_rows", lambda r: r["t_us"])))
    near = F.size(F.filter("_xs", lambda t: t <= F.col("_ch") * span + gap)) + 1
    entry = F.struct(F.slice("_xs", F.lit(1), near).alias("at"), F.slice(_last_of_chains(F.col("_xs"), gap), F.lit(1), near).alias("end"), none.alias("rest"))
    stretch = spans.select(*by, "_ch", entry.alias("_s"))

    def over(rest: Column, start: Column) -> Column:
        return F.aggregate(rest, start, lambda last, x: _through(x["_s"], last, gap))

    blocks = stretch.groupBy(*by, F.floor(F.col("_ch") / BLOCK_SPANS).cast("bigint").alias("_blk")).agg(F.array_sort(F.collect_list(F.struct("_ch", "_s"))).alias("_of"))
    first, rest = F.get("_of", F.lit(0))["_s"], F.slice("_of", F.lit(2), F.greatest(F.size("_of") - 1, F.lit(0)))
    whole = F.struct(first["at"].alias("at"), F.transform(first["end"], lambda e: over(rest, e)).alias("end"), over(rest, none).alias("rest"))
    blocks = cut(blocks.withColumn("_s", whole))

    def befores(parts: Column, start: Column) -> Column:
        """The last kept time before each part."""
        def step(s: Column, x: Column) -> Column:
            return F.struct(_through(x["_s"], s["last"], gap).alias("last"), F.concat(s["all"], F.array(s["last"])).alias("all"))

        return F.aggregate(parts, F.struct(start.alias("last"), F.array().cast("array<bigint>").alias("all")), step, lambda s: s["all"])

    keys = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_blk", "_s"))).alias("_of"))
    into = keys.select(*by, F.explode(F.arrays_zip(F.transform("_of", lambda x: x["_blk"]).alias("_blk"), befores(F.col("_of"), none).alias("_last"))).alias("_p"))
    into = blocks.join(into.select(*by, "_p._blk", "_p._last"), [*by, "_blk"])
    into = into.select(*by, F.explode(F.arrays_zip(F.transform("_of", lambda x: x["_ch"]).alias("_ch"), befores(F.col("_of"), F.col("_last")).alias("_last"))).alias("_p"))

    def keep(s: Column, r: Column) -> Column:
        fits = s["last"].isNull() | (r["t_us"] > s["last"] + F.lit(gap))
        return F.when(fits, F.struct(r["t_us"].alias("last"), F.concat(s["kept"], F.array(r)).alias("kept"))).otherwise(s)

    done = spans.join(into.select(*by, "_p._ch", "_p._last"), [*by, "_ch"])
    empty = F.filter("_rows", lambda r: F.lit(False))
    kept = F.aggregate("_rows", F.struct(F.col("_last").alias("last"), empty.alias("kept")), keep, lambda s: s["kept"])
    return done.select(*by, F.explode(kept).alias("_r")).select(*by, "_r.*").select(*events.columns)


def visible_windows(df: DataFrame, by: list[str], rel: str, limit: float) -> DataFrame:
    """Runs of samples with |rel| within the limit: start, first sample outside (or the last sample), nearest sample."""
    inside = F.abs(F.col(rel)) <= limit
    r = timeline(df.withColumn("_in", inside), by).neighbour({"_pin": "_in"}).neighbour({"_nt": "t_us"}, offset=1).df
    r = r.withColumn("_start", (F.col("_in") & ~F.coalesce("_pin", F.lit(False))).cast("int"))
    r = timeline(r, by).running_sum({"_run": "_start"}).df.where("_in")
    return r.groupBy(*by, "_run").agg(
        F.min("t_us").alias("start_us"), F.max(F.coalesce("_nt", F.col("t_us"))).alias("end_us"),
        F.min_by("t_us", F.struct(F.abs(rel), F.col("t_us"))).alias("peak_us"), F.count(F.lit(1)).alias("n_samples"),
    ).drop("_run")


def close_approaches(df: DataFrame, by: list[str], sep: str, front: Column, below: float, min_gap_us: int) -> DataFrame:
    """Local minima of a separation series below a threshold, at least a gap apart."""
    r = timeline(df.withColumn("_front", front), by).neighbour({"_p": sep}).neighbour({"_n": sep}, offset=1).df
    x = F.col(sep)
    hit = r.where((x <= F.col("_p")) & (x <= F.col("_n")) & (x < below) & F.col("_front"))
    return spaced(hit.select(*by, "ord", "t_us", sep), by, min_gap_us)


def closest_per_day(df: DataFrame, by: list[str], rel: str) -> DataFrame:
    day = F.call_function("div", F.col("t_us"), F.lit(DAY_US)).alias("day")
    return df.groupBy(*by, day).agg(
        F.min_by("t_us", F.struct(F.abs(rel), F.col("t_us"))).alias("t_us"), F.min(F.abs(rel)).alias("rel"))


def frame_offsets(df: DataFrame, by: list[str], stamp: str, index: str, cadence: str) -> DataFrame:
    """Seconds from the first stamp if every frame has one, else index x cadence, else NULL with a reason."""
    g = df.groupBy(*by).agg(
        F.min(stamp).alias("_t0"), F.count(stamp).alias("_ns"), F.count(F.lit(1)).alias("_n"), F.max(cadence).alias("_cad"))
    r = attach(df, g, by)
    stamped = F.col("_ns") == F.col("_n")
    dt = F.when(stamped, (F.col(stamp) - F.col("_t0")) / 1e6).when(F.col("_cad") > 0, F.col(index) * F.col("_cad"))
    src = F.when(stamped, F.lit("stamp")).when(F.col("_cad") > 0, F.lit("cadence")).otherwise(F.lit("refused"))
    return r.withColumns({"dt_s": dt, "source": src}).drop("_t0", "_ns", "_n", "_cad")
