"""Grading and publication rules on wide job rows. Flags are arrays, grades are CASE chains, all row-local."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.angles import as_col, clip, sky_error_arcsec, timing_sigma_by_period, timing_sigma_by_rate, wrap_deg, wrap_diff
from driftline.functions.priors import in_core_band, in_wide_band, trusted_source

c = F.col


def flags(*conditions: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions]))


def has(array, *names: str) -> Column:
    return F.arrays_overlap(as_col(array), F.array(*[F.lit(n) for n in names]))


def truthy(x) -> Column:
    """NULL, NaN and zero count as missing, as in an `or` chain."""
    v = as_col(x)
    return F.when(~F.isnan(v) & (v != 0), v)


def publish_quality(df: DataFrame) -> DataFrame:
    """Flags, absolute_ok, publish_ok and grade of the published answer.

    Columns pub_lon, pub_lat, pipe_lon, cm_source, limb, def_spread, time_err, orange_ok, orange_near_limb, orange_lon,
    definition. A locked colour seed demotes method scatter and pipeline distance to a warning.
    """
    core, wide, trusted = in_core_band("pub_lat"), in_wide_band("pub_lat"), trusted_source("cm_source")
    dpp = F.abs(wrap_diff("pub_lon", "pipe_lon"))
    seed = F.coalesce(
        c("orange_ok") & ~c("orange_near_limb") & core
        & (F.upper("definition").contains("ORANGE") | F.coalesce(F.abs(wrap_diff("pub_lon", "orange_lon")) < 3.0, F.lit(False))),
        F.lit(False))
    df = df.withColumns({"_core": core, "_wide": wide, "cm_trusted": trusted, "_seed": seed, "_dpp": dpp})
    spread = c("def_spread")
    fl = flags(
        ("CM_UNTRUSTED", ~c("cm_trusted")), ("LAT_OUT_OF_BAND", ~c("_wide")), ("LAT_OUTSIDE_CORE", c("_wide") & ~c("_core")),
        ("LIMB_SPREAD_FAIL", c("limb") > 10.0), ("LIMB_SPREAD_WARN", (c("limb") > 2.5) & (c("limb") <= 10.0)),
        ("DEFINITION_SCATTER_FAIL", (spread > 40.0) & ~c("_seed")),
        ("DEFINITION_SCATTER_WARN", (spread > 12.0) & ((spread <= 40.0) | c("_seed"))),
        ("PUBLISH_VS_PIPE_FAIL", (c("_dpp") > 30.0) & ~c("_seed")),
        ("TIMING_UNCERTAINTY_HIGH", timing_sigma_by_rate(F.coalesce("time_err", F.lit(0.0))) > 0.6),
    )
    df = df.withColumn("flags", fl)
    hard = has("flags", "LAT_OUT_OF_BAND", "PUBLISH_VS_PIPE_FAIL", "DEFINITION_SCATTER_FAIL")
    soft = has("flags", "LIMB_SPREAD_FAIL", "LAT_OUTSIDE_CORE")
    df = df.withColumns({"_hard": hard, "_soft": soft})
    grade = (
        F.when(c("_hard") | ~c("_wide"), F.lit("REJECT"))
        .when(c("_seed") & c("_core") & c("cm_trusted"), F.when(c("_soft"), F.lit("CAUTION")).otherwise(F.lit("GOOD")))
        .when(c("_soft") | ~c("cm_trusted") | has("flags", "LAT_OUTSIDE_CORE", "LIMB_SPREAD_WARN"), F.lit("CAUTION"))
        .when(F.size("flags") > 0, F.lit("FAIR")).otherwise(F.lit("GOOD"))
    )
    return df.withColumns({
        "absolute_ok": c("cm_trusted") & ~c("_hard") & c("_core") & c("_wide") & (c("_seed") | ~c("_soft")),
        "publish_ok": (~c("_hard") & c("_core")) | c("_seed"), "grade": grade, "publish_vs_pipeline": c("_dpp"),
    }).drop("_core", "_wide", "_seed", "_dpp", "_hard", "_soft")


def candidate_score(definition, lon, lat, cm, pipe_lon) -> Column:
    """Latitude band first, then distance from the meridian, label bonus and pipeline agreement; NULL without longitude."""
    d = F.upper(F.coalesce(as_col(definition), F.lit("")))
    rel = F.abs(wrap_diff(lon, cm))
    core, wide = in_core_band(lat), in_wide_band(lat)
    s = F.when(core, F.lit(100.0)).when(wide, F.lit(40.0)).otherwise(F.lit(-80.0))
    s = s + F.when(rel > 75.0, F.lit(-50.0)).when(rel > 55.0, F.lit(-20.0)).when(rel.isNotNull(), F.lit(10.0)).otherwise(F.lit(0.0))
    s = s + (
        F.when(d.contains("ORANGE"), F.lit(45.0)).when(d == "UNBEATABLE_AUTO", F.lit(50.0))
        .when(d.startswith("CHAMPION"), F.lit(35.0)).when(d.startswith("GS-MAP"), F.lit(25.0))
        .when(d.startswith("GS-BARY"), F.lit(5.0)).otherwise(F.lit(0.0))
    )
    s = s + F.when(core & (F.abs(wrap_diff(lon, pipe_lon)) <= 30.0), F.lit(15.0)).otherwise(F.lit(0.0))
    return F.when(as_col(lon).isNotNull(), s)


def best_candidate(cands: DataFrame, key: list[str], ord_: str) -> DataFrame:
    """Highest score per job, first on ties. A job has a handful of candidates."""
    s = candidate_score("definition", "lon", "lat", "cm", "pipe_lon")
    r = cands.withColumn("score", s).where(c("score").isNotNull())
    best = F.max_by(F.struct("definition", "lon", "lat", "score"), F.struct(c("score"), -c(ord_)))
    return r.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def agreement_class(sky: Column, labels=("MATCH", "NEAR", "FAIR", "DIFFERENT")) -> Column:
    return (
        F.when(sky <= 1.0, F.lit(labels[0])).when(sky <= 2.0, F.lit(labels[1])).when(sky <= 5.0, F.lit(labels[2]))
        .when(sky.isNotNull(), F.lit(labels[3]))
    )


def pair_difference(a_lon, a_lat, b_lon, b_lat, distance_au) -> dict[str, Column]:
    """First minus second; a missing latitude on either side counts as no latitude difference."""
    dlon = wrap_diff(a_lon, b_lon)
    dlat = F.coalesce(as_col(a_lat) - as_col(b_lat), F.lit(0.0))
    lat0 = F.coalesce(as_col(b_lat), as_col(a_lat), F.lit(-22.0))
    return {"dlon": dlon, "dlat": dlat, "sky": sky_error_arcsec(dlon, dlat, lat0, distance_au)}


def manual_agreement(sky: Column, cm_source) -> Column:
    s = F.lower(F.coalesce(as_col(cm_source), F.lit("")))
    ok = s.rlike("winjupos|override|spice|horizons")
    return (
        F.when(sky.isNull(), F.lit("NO_MANUAL_PICK")).when((sky <= 1.0) & ok, F.lit("EQUAL"))
        .when(sky <= 1.0, F.lit("MATCH_FEATURE_CM_WEAK")).when(sky <= 2.0, F.lit("NEAR")).when(sky <= 5.0, F.lit("FAIR"))
        .otherwise(F.lit("DIFFERENT"))
    )


def suite_quality(df: DataFrame) -> DataFrame:
    """0-100 score with flags, caps, floors and vetoes; columns n_in n_out n_clusters sig_lon sig_lat lon lat pipe_lon cm
    cm_source has_time time_err pipe_sky pipe_grade a_eq."""
    d = F.abs(wrap_diff("lon", "pipe_lon"))
    rel = F.abs(wrap_diff("lon", "cm"))
    src = F.lower(F.coalesce("cm_source", F.lit("")))
    pg = F.upper(F.coalesce("pipe_grade", F.lit("")))
    pro, synth = src.rlike("spice|winjupos|horizons|override"), src.contains("synth")
    needs = pg.rlike("NEEDS_WORK|POOR")
    off = F.abs(c("lat") + 22.0)
    no = F.lit(False)
    yes = lambda x: F.coalesce(x, no)
    near = yes(d < 15.0)
    rules = [
        ("PIPELINE_AGREE", yes(d < 8.0), 12.0), ("PIPELINE_NEAR", yes((d >= 8.0) & (d < 15.0)), 6.0),
        ("PIPELINE_DISAGREE", yes(d > 30.0), -25.0), ("LOW_INLIERS", c("n_in") < 4, -25.0),
        ("MODERATE_INLIERS", (c("n_in") >= 4) & (c("n_in") < 8), -8.0),
        ("MULTI_CLUSTER", c("n_clusters") >= 3, F.when(near, F.lit(-6.0)).otherwise(F.lit(-12.0))),
        ("MANY_OUTLIERS", (c("n_out") > c("n_in")) & (c("n_in") < 12) & ~near, -12.0),
        ("HIGH_LON_SCATTER", c("sig_lon") > 1.5, -18.0), ("MED_LON_SCATTER", (c("sig_lon") > 0.6) & (c("sig_lon") <= 1.5), -6.0),
        ("HIGH_LAT_SCATTER", c("sig_lat") > 1.0, -10.0), ("LAT_OFF_BAND", off > 6.0, -25.0),
        ("LAT_MARGINAL", (off > 3.5) & (off <= 6.0), -8.0), ("NEAR_LIMB", yes(rel > 70), -12.0),
        ("OFF_CM", yes((rel > 50) & (rel <= 70)), -6.0), ("WEAK_CM_SOURCE", ~pro & ~synth, -10.0),
        ("NO_TIME", ~c("has_time"), -12.0), ("LARGE_TIME_ERROR", c("has_time") & (c("time_err") > 30), -10.0),
        ("LARGE_PIPELINE_SIGMA", yes(c("pipe_sky") > 3.0), -12.0),
        ("PIPELINE_NEEDS_WORK", needs, F.when(near, F.lit(-12.0)).otherwise(F.lit(-20.0))),
        ("SMALL_DISK_PX", yes(c("a_eq") < 40), -15.0),
    ]
    score = F.lit(100.0)
    for _, cond, pts in rules:
        score = score + F.when(cond, pts if isinstance(pts, Column) else F.lit(pts)).otherwise(F.lit(0.0))
    score = score + F.when(pro, F.lit(5.0)).otherwise(F.lit(0.0)) + F.when(yes(c("pipe_sky") <= 1.0), F.lit(5.0)).otherwise(
        F.lit(0.0)) + F.when(~needs & pg.contains("FAIR"), F.lit(-6.0)).otherwise(F.lit(0.0)) + F.when(
        yes(c("a_eq") > 80), F.lit(3.0)).otherwise(F.lit(0.0))
    df = df.withColumns({"flags": flags(*[(n, cond) for n, cond, _ in rules]), "_near": near, "_s": clip(score, 0.0, 100.0)})

    def cap(v: Column, cond: Column, top: float) -> Column:
        return F.when(cond, F.least(v, F.lit(top))).otherwise(v)

    s = cap(c("_s"), has("flags", "PIPELINE_NEEDS_WORK", "NEAR_LIMB"), 68.0)
    s = cap(s, has("flags", "LARGE_PIPELINE_SIGMA"), 72.0)
    s = cap(s, has("flags", "PIPELINE_DISAGREE"), 45.0)
    s = cap(s, has("flags", "MULTI_CLUSTER") & ~has("flags", "PIPELINE_AGREE"), 69.0)
    floor = F.when(has("flags", "NEAR_LIMB", "PIPELINE_NEEDS_WORK"), F.lit(42.0)).otherwise(F.lit(50.0))
    df = df.withColumn("_c", s)
    held = c("_near") & ~has("flags", "LAT_OFF_BAND") & (c("n_in") >= 4)
    df = df.withColumn("score", F.when(held, F.greatest("_c", floor)).otherwise(c("_c")))
    veto = has(
        "flags", "PIPELINE_NEEDS_WORK", "NEAR_LIMB", "LAT_OFF_BAND", "HIGH_LON_SCATTER", "MULTI_CLUSTER",
        "PIPELINE_DISAGREE", "LARGE_PIPELINE_SIGMA", "WJ_MISMATCH") | (c("n_in") < 10)
    grade = (
        F.when((c("score") >= 85) & ~veto, F.lit("EXCELLENT")).when(c("score") >= 70, F.lit("GOOD"))
        .when(c("score") >= 55, F.lit("FAIR")).when(c("score") >= 40, F.lit("MARGINAL")).otherwise(F.lit("POOR"))
    )
    return df.withColumn("grade", grade).drop("_near", "_s", "_c")


def gate_table(checks: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])


def gate_summary(df: DataFrame, gates: str, order: list[str]) -> DataFrame:
    """Failed gate names in their listed order, counts and whether all passed."""
    names = F.map_keys(F.map_filter(gates, lambda k, v: ~v))
    failed = F.filter(F.array(*[F.lit(n) for n in order]), lambda n: F.array_contains(names, n))
    return df.withColumns({
        "failed": F.array_join(failed, ","), "n_total": F.size(gates), "n_pass": F.size(gates) - F.size(names),
    }).withColumn("locked", c("n_pass") == c("n_total"))


def lock_checks() -> dict[str, Column]:
    """Thirteen gates on job columns; all must hold for the automatic lock."""
    lat = c("lat")
    return {
        "trusted_cm": trusted_source("cm_source"), "cm_crosscheck": c("dcm").isNull() | (c("dcm") <= 0.35),
        "finite_pos": c("lon").isNotNull() & lat.isNotNull(), "lat_core": lat.between(-28.0, -16.0),
        "no_map_edge": ~has("job_flags", "FINAL_MAP_EDGE", "WEAK_DARK_CORE"), "limb_stable": c("limb") <= 1.35,
        "def_tight": c("sig_def") <= 1.0, "dark_core": c("dark") >= 0.12, "nav_stable": c("nav_stable"),
        "dual_agree": c("dual_agree"), "score_high": c("score") >= 88, "gs_or_strong": c("gs_lock") | (c("score") >= 92),
        "sigma_sky_tight": c("sigma_sky") <= 2.5,
    }


def desk_grade(df: DataFrame) -> DataFrame:
    src = F.lower(F.coalesce("cm_source", F.lit("")))
    weak = src.isin("analytical", "analytic", "fallback", "", "unknown")
    unsure = ~weak & ~F.coalesce("cm_trusted", F.lit(False)) & ~src.rlike("spice|horizons|winjupos|override|synthetic")
    rules = [
        ("CM_WEAK", weak, -40.0), ("CM_UNTRUSTED", unsure, -25.0), ("LIMB_UNSTABLE", c("limb") > 5.0, -20.0),
        ("LIMB_ELEVATED", (c("limb") > 2.5) & (c("limb") <= 5.0), -8.0), ("DEFINITION_SCATTER", c("def_spread") > 12.0, -15.0),
        ("LAT_OUT_OF_BAND", ~c("lat").between(-36.0, -10.0), -30.0), ("MATCHES_MANUAL", c("sky_manual") <= 1.0, 5.0),
        ("DIFFERS_FROM_MANUAL", c("sky_manual") > 5.0, -10.0),
    ]
    score = F.lit(100.0)
    for _, cond, pts in rules:
        score = score + F.when(cond, F.lit(pts)).otherwise(F.lit(0.0))
    df = df.withColumns({"flags": flags(*[(n, x) for n, x, _ in rules]), "score": clip(score, 0.0, 100.0)})
    g = (
        F.when((c("score") >= 85) & ~has("flags", "CM_WEAK", "LAT_OUT_OF_BAND"), F.lit("DESK_EXCELLENT"))
        .when(c("score") >= 70, F.lit("DESK_GOOD")).when(c("score") >= 50, F.lit("DESK_FAIR")).otherwise(F.lit("DESK_HOLD"))
    )
    return df.withColumn("desk_grade", g)


def budget_grade(sigma_total, injection_mean, optical_floor) -> Column:
    s = as_col(sigma_total)
    inj = F.coalesce(F.nanvl(as_col(injection_mean), F.lit(99.0)), F.lit(99.0))
    top = F.greatest(F.lit(0.35), F.lit(0.15), 2.0 * as_col(optical_floor))
    return (
        F.when((s <= top) & (inj <= 0.8), F.lit("METHOD_EXCELLENT")).when((s <= 1.0) & (inj <= 1.5), F.lit("METHOD_GOOD"))
        .when(s <= 2.0, F.lit("RESEARCH_GOOD")).when(s <= 5.0, F.lit("RESEARCH_FAIR")).otherwise(F.lit("NEEDS_WORK"))
    )


def root_sum_squares(*parts) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + as_col(p) * as_col(p)
    return F.sqrt(total)


def error_budget(df: DataFrame) -> DataFrame:
    """Quadrature totals and sky terms; columns lat, distance_au, rand_*, def_*, bias_* (lon, lat), sigma_xc, sigma_yc,
    sigma_a, a_eq, sigma_cm, time_err, closure_sky."""
    per_px = F.degrees(1.0 / (c("a_eq") + 1e-12))
    nav_lon = per_px * F.hypot(c("sigma_xc"), 0.5 * c("sigma_a")) / 0.7
    nav_lat = per_px * F.hypot(c("sigma_yc"), 0.5 * c("sigma_a"))
    df = df.withColumns({"nav_lon": nav_lon, "nav_lat": nav_lat, "t_lon": timing_sigma_by_period("time_err")})
    sys_lon = root_sum_squares("def_lon", "nav_lon", "t_lon", "sigma_cm", "bias_lon")
    sys_lat = root_sum_squares("def_lat", "nav_lat", "bias_lat")
    sky = lambda a, b: sky_error_arcsec(a, b, "lat", "distance_au")
    df = df.withColumns({
        "total_lon": root_sum_squares("rand_lon", "def_lon", "nav_lon", "t_lon", "sigma_cm", "bias_lon"),
        "total_lat": root_sum_squares("rand_lat", "def_lat", "nav_lat", "bias_lat"),
        "sky_random": sky("rand_lon", "rand_lat"), "sky_system": sky(sys_lon, sys_lat),
        "sky_nav": sky("nav_lon", "nav_lat"), "sky_time": sky("t_lon", 0.0),
    })
    base = F.hypot("sky_random", "sky_system")
    return df.withColumn("sky_total", F.when(c("closure_sky") > 0, F.hypot(base, 0.5 * c("closure_sky"))).otherwise(base))


def position_sigma(cm, time, limb_lon, limb_lat, definition, method_lon, method_lat) -> tuple[Column, Column]:
    lon = root_sum_squares(cm, time, limb_lon, definition, F.greatest(as_col(method_lon), F.lit(0.05)))
    lat = root_sum_squares(limb_lat, F.greatest(as_col(method_lat), F.lit(0.05)), 0.12)
    return lon, lat


def running_std(values: Column) -> Column:
    """Sample deviation of an array, value by value in its order (Welford); NULL below two. Unlike the aggregate function, it has the same last bit
    on every run, however the rows are spread."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def add(s, x):
        m = s["m"] + (x - s["m"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), m.alias("m"), (s["q"] + (x - s["m"]) * (x - m)).alias("q"))

    return F.aggregate(values, zero, add, lambda s: F.when(s["n"] > 1, F.sqrt(s["q"] / (s["n"] - 1))))


def spread_flags(df: DataFrame, keys: list[str], dlon: Column, dlat: Column, ord_: str) -> DataFrame:
    """Sample spread about a reference and the stability verdict; NULL verdict below three values.

    A spread may stand exactly on its limit, so rows are taken in the order of `ord_`; a key is a case, which is bounded (`unique_hits`).
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c(ord_).alias("o"), dlon.alias("lon"), dlat.alias("lat")))).alias("_r"))
    values = lambda name: F.filter(F.col("_r")[name], lambda x: x.isNotNull())
    g = g.select(
        *keys, F.size("_r").cast("long").alias("n"), running_std(values("lon")).alias("sigma_lon"), running_std(values("lat")).alias("sigma_lat"),
        F.array_max(F.transform(values("lon"), F.abs)).alias("max_dlon"))
    ok = (c("sigma_lon") <= 0.55) & (c("max_dlon") <= 1.4) & (c("sigma_lat") <= 0.45)
    return g.withColumn("stable", F.when(c("n") >= 3, ok))


def injection_bias(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bias, scatter and mean sky error of recovered trials; fewer than five give zero bias and no sky error."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dlon").alias("_bl"), F.avg("dlat").alias("_ba"),
        F.stddev_samp("dlon").alias("_sl"), F.avg("sky").alias("_sk"))
    weak = c("n") < 5
    return g.select(
        *keys, "n", F.when(weak, F.lit(0.0)).otherwise(c("_bl")).alias("bias_lon"),
        F.when(weak, F.lit(0.0)).otherwise(c("_ba")).alias("bias_lat"), F.when(~weak, c("_sl")).alias("scatter_lon"),
        F.when(~weak, c("_sk")).alias("mean_sky"))


def filter_closure(df: DataFrame, keys: list[str], distance_au: float) -> DataFrame:
    """Residual scatter of per-filter positions about a line in 1/wavelength^2, relative to the G filter (or the first).

    Columns filter, rank, lam, lon, lat: one row per filter, at most five per key.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(*keys)
    pivot = F.min_by(F.struct("lon", "lat"), F.when(c("filter") == "G", F.lit(-1)).otherwise(c("rank"))).over(by)
    r = df.withColumns({"_p": pivot, "_n": F.count(F.lit(1)).over(by)}).where("_n >= 2")
    r = r.withColumns({"_x": 1e6 / (c("lam") * c("lam")), "_yl": wrap_diff("lon", "_p.lon"), "_ya": c("lat") - c("_p.lat")})
    for y, o in (("_yl", "_rl"), ("_ya", "_ra")):
        slope = F.regr_slope(c(y), c("_x")).over(by)
        r = r.withColumn(o, c(y) - F.avg(y).over(by) - F.coalesce(slope, F.lit(0.0)) * (c("_x") - F.avg("_x").over(by)))
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("_rl").alias("res_lon"), F.stddev_samp("_ra").alias("res_lat"),
        F.avg("lat").alias("_lat0"))
    return g.withColumn("closure_sky", sky_error_arcsec("res_lon", "res_lat", "_lat0", distance_au)).drop("_lat0")


def difficulty(hits: DataFrame, case: list[str], sota: DataFrame) -> DataFrame:
    """0-1 difficulty from inliers, scatter, latitude, grade and the 10-90 % circular span of five or more methods."""
    from pyspark.sql import Window

    from .circular import circular_mean

    by = Window.partitionBy(*case)
    r = hits.where(~c("method_id").contains("EDGE")).withColumn("_d", wrap_diff("lon", circular_mean("lon", None, by)))
    span = r.groupBy(*case).agg(
        F.when(F.count(F.lit(1)) >= 5, F.percentile("_d", 0.9) - F.percentile("_d", 0.1)).alias("span"))
    s = sota.join(span, case, "left")
    g = F.coalesce("grade", F.lit(""))
    step = lambda *cases: _chain(cases)
    score = (
        step((c("n_in") < 8, 0.35), (c("n_in") < 15, 0.15)) + step((c("sig_lon") > 1.0, 0.35), (c("sig_lon") > 0.4, 0.15))
        + step((c("sig_lat") > 0.8, 0.15)) + step((F.abs(c("lat") + 22.0) > 4.0, 0.25))
        + step((g.rlike("POOR|MARGINAL"), 0.2), (g.contains("FAIR"), 0.1))
        + step(((c("n_out") > 2 * F.greatest(c("n_in"), F.lit(1))) & (c("n_in") < 12), 0.15))
        + step((c("span") > 15, 0.3), (c("span") > 6, 0.15))
    )
    return s.withColumn("difficulty", clip(score, 0.0, 1.0))


def _chain(cases) -> Column:
    out = F.lit(0.0)
    for cond, pts in reversed(cases):
        out = F.when(cond, F.lit(pts)).otherwise(out)
    return out


def first_source(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """Each field from the first source that has it, with the source label; sources are keyed once per key."""
    out = base.select(key)
    for label, df in sources:
        out = out.join(df.select(key, *[c(f).alias(f"_{label}_{f}") for f in fields]), key, "left")
    cols = {}
    for f in fields:
        cols[f] = F.coalesce(*[c(f"_{label}_{f}") for label, _ in sources])
        cols[f"{f}_source"] = F.coalesce(*[F.when(c(f"_{label}_{f}").isNotNull(), F.lit(label)) for label, _ in sources])
    return out.select(key, *[v.alias(k) for k, v in cols.items()])


def rim_block(we: Column, ee: Column, extent: Column, gold_we: Column, gold_ee: Column, gold_extent: Column) -> dict[str, Column]:
    """West and east edges, extent and circular midpoint with fallbacks; the extent of the own edges comes before others."""
    ext = F.coalesce(extent, F.abs(wrap_diff(ee, we)), gold_extent)
    w, e = F.coalesce(we, gold_we), F.coalesce(ee, gold_ee)
    wr, er = F.radians(w), F.radians(e)
    mid = wrap_deg(F.degrees(F.atan2(0.5 * (F.sin(wr) + F.sin(er)), 0.5 * (F.cos(wr) + F.cos(er)))))
    return {"west": w, "east": e, "extent": ext, "mid": mid}


def citation(definition, lon, lat_c, lat_g, sigma, cm, source, grade) -> Column:
    full = as_col(lon).isNotNull() & as_col(lat_c).isNotNull() & as_col(lat_g).isNotNull() & as_col(sigma).isNotNull() & as_col(
        cm).isNotNull()
    text = F.format_string(
        "%s lon=%.4f lat_c=%.3f lat_g=%.3f sigma=%.3f CM=%.4f (%s) grade=%s", as_col(definition), as_col(lon), as_col(lat_c),
        as_col(lat_g), as_col(sigma), as_col(cm), as_col(source), as_col(grade))
    return F.when(full, text).otherwise(F.lit("Measure incomplete"))


def samples_covariance(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sample covariance of every pair of columns, one row per key."""
    cols = [
        F.covar_samp(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[i:]
    ]
    return df.groupBy(*keys).agg(*cols)


