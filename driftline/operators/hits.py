"""Many estimates of one position: neighbours, ensembles, outlier rejection, champion choice.

A case holds at most one row per method and the catalogue of methods is finite, so windows by case are bounded by the
catalogue size whatever the share of rows a source produces. `unique_hits` establishes that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.angles import as_col, wrap_deg, wrap_diff

from .circular import circular_mean

CLUSTER_DEG = 18.0


def unique_hits(df: DataFrame, case: list[str], method: str, order: str) -> DataFrame:
    """Last row per case and method; a max_by combines map-side, so repeats never meet in one task unreduced."""
    rest = [x for x in df.columns if x not in (*case, method)]
    last = df.groupBy(*case, method).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*case, method, "_r.*")


def neighbour_count(df: DataFrame, case: list[str], lon: str, radius: float, out: str = "n_near") -> DataFrame:
    """Rows of the case within `radius` degrees on the circle, itself included.

    A sorted range frame counts them; rows near the seam are repeated one turn away, so no pairs are formed.
    """
    x = F.col(lon)
    copies = F.array_compact(
        F.array(x, F.when(x < radius, x + 360.0), F.when(x >= 360.0 - radius, x - 360.0))
    )
    spread = df.select("*", F.posexplode(copies).alias("_copy", "_x"))
    near = Window.partitionBy(*case).orderBy(F.col("_x") / radius).rangeBetween(-1, 1)
    return spread.withColumn(out, F.count(F.lit(1)).over(near)).where("_copy = 0").drop("_copy", "_x")


def first_by(case: list[str], *order: Column):
    return F.row_number().over(Window.partitionBy(*case).orderBy(*order))


def densest_centre(df: DataFrame, case: list[str], lon: str, ord_: str, radius: float, out: str) -> DataFrame:
    """Circular mean of the rows around the row with most neighbours (first one on ties), on every row."""
    by = Window.partitionBy(*case)
    rows = neighbour_count(df, case, lon, radius, "_nn")
    rows = rows.withColumn("_seed", F.max_by(lon, F.struct("_nn", -F.col(ord_))).over(by))
    inside = F.abs(wrap_diff(lon, "_seed")) <= radius
    rows = rows.withColumn(out, circular_mean(lon, inside.cast("double"), by))
    return rows.drop("_nn", "_seed")


def reject_lon_outliers(df: DataFrame, case: list[str], lon: str, ord_: str, limit: float = CLUSTER_DEG) -> DataFrame:
    """Adds `centre`, `kept`, `reason`. Fewer than three rows are all kept; a case is never emptied."""
    by = Window.partitionBy(*case)
    rows = densest_centre(df, case, lon, ord_, limit, "centre")
    rows = rows.withColumn("_d", F.abs(wrap_diff(lon, "centre")))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_in", F.count_if(F.col("_d") <= limit).over(by))
    best = first_by(case, F.col("_d"), F.col(ord_)) == 1
    kept = (F.col("_n") < 3) | (F.col("_d") <= limit) | ((F.col("_in") == 0) & best)
    return rows.withColumn("kept", kept).withColumn(
        "reason", F.when(~F.col("kept"), F.lit("lon_cluster_outlier"))
    ).drop("_d", "_n", "_in")


def max_spread(df: DataFrame, case: list[str], lon: str, lat: str) -> DataFrame:
    """Largest circular longitude distance and latitude range per case, without forming pairs.

    The point farthest from p is the one nearest to p's antipode, which is a neighbour in sorted order.
    """
    x = F.col(lon)
    marks = df.select(
        *case, lat, F.explode(F.array(
            F.struct(x.alias("at"), x.alias("p"), F.lit(None).cast("double").alias("anti")),
            F.struct(wrap_deg(x + 180.0).alias("at"), F.lit(None).cast("double").alias("p"),
                     wrap_deg(x + 180.0).alias("anti")),
        )).alias("m"),
    ).select(*case, lat, "m.*")
    by = Window.partitionBy(*case)
    run = by.orderBy("at")
    before = F.coalesce(
        F.last("p", ignorenulls=True).over(run.rangeBetween(Window.unboundedPreceding, 0)), F.max("p").over(by)
    )
    after = F.coalesce(
        F.first("p", ignorenulls=True).over(run.rangeBetween(0, Window.unboundedFollowing)), F.min("p").over(by)
    )
    near = F.least(F.abs(wrap_diff(before, "anti")), F.abs(wrap_diff(after, "anti")))
    far = marks.withColumn("_near", F.when(F.col("anti").isNotNull(), near))
    n = F.count("p")
    return far.groupBy(*case).agg(
        n.alias("n"),
        F.when(n >= 2, 180.0 - F.min("_near")).otherwise(F.lit(0.0)).alias("lon_spread"),
        F.when(n >= 2, F.max(lat) - F.min(lat)).otherwise(F.lit(0.0)).alias("lat_spread"),
    )


def ensembles(df: DataFrame, case: list[str], lon: str, lat: str, weight: str, ord_: str) -> DataFrame:
    """Weighted mean, median, 20 % trimmed mean and medoid per case with at least two rows."""
    by = Window.partitionBy(*case)
    r = df.select(*case, lon, lat, weight, ord_).withColumn("_n", F.count(F.lit(1)).over(by)).where("_n >= 2")
    r = r.withColumn("_c", circular_mean(lon, None, by)).withColumn("_d", wrap_diff(lon, "_c"))
    r = r.withColumn("_med", wrap_deg(F.col("_c") + F.median("_d").over(by))).withColumn(
        "_mlat", F.median(lat).over(by)
    )
    r = r.withColumn("_rank", first_by(case, F.abs("_d"), F.col(ord_)))
    keep = F.col("_rank") <= F.greatest(F.lit(2), F.floor(F.col("_n") * 0.8))
    off = F.round(F.abs(wrap_diff(lon, "_med")) + F.abs(F.col(lat) - F.col("_mlat")), 9)  # equal distances stay ties
    w = F.col(weight) / (F.sum(weight).over(by) + 1e-12)
    r = r.withColumns({"_keep": keep, "_off": off, "_w": w})
    medoid = F.min_by(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")), F.struct("_off", ord_))
    k = F.col("_keep").cast("double")
    one = r.groupBy(*case).agg(
        F.struct(circular_mean(lon, "_w").alias("lon"), F.sum(F.col("_w") * F.col(lat)).alias("lat")).alias("ENS_WMEAN"),
        F.struct(F.max("_med").alias("lon"), F.max("_mlat").alias("lat")).alias("ENS_MEDIAN"),
        F.struct(
            circular_mean(lon, k).alias("lon"), (F.sum(k * F.col(lat)) / F.sum(k)).alias("lat")
        ).alias("ENS_TRIM"),
        medoid.alias("ENS_MEDOID"),
    )
    names = ("ENS_WMEAN", "ENS_MEDIAN", "ENS_TRIM", "ENS_MEDOID")
    weights = (3.5, 3.5, 3.0, 3.2)
    rows = F.array(*[
        F.struct(F.lit(m).alias("method_id"), F.lit(w).alias("weight"), F.col(m).alias("p"))
        for m, w in zip(names, weights)
    ])
    return one.select(*case, F.explode(rows).alias("e")).select(
        *case, "e.method_id", "e.weight", F.col("e.p.lon").alias("lon"), F.col("e.p.lat").alias("lat")
    )


def family_ensembles(df: DataFrame, case: list[str], families: list[str]) -> DataFrame:
    """Circular mean per case and listed family with at least two rows."""
    g = df.where(F.col("family").isin(families)).groupBy(*case, "family")
    return g.agg(
        F.count(F.lit(1)).alias("n"), circular_mean("lon").alias("lon"), F.avg("lat").alias("lat")
    ).where("n >= 2")


def preferred(case: list[str], method: str, preference: list[str], weight: str, ord_: str, value: Column) -> Column:
    """`value` of the first method present in the preference list, else of the heaviest row (first on ties)."""
    rank = F.lit(1_000_000)
    for i, m in reversed(list(enumerate(preference))):
        rank = F.when(F.col(method) == m, F.lit(i)).otherwise(rank)
    heavy = F.when(rank == 1_000_000, -F.col(weight)).otherwise(F.lit(0.0))
    return F.min_by(value, F.struct(rank.alias("r"), heavy.alias("w"), F.col(ord_).alias("o")))


def primary_row(case: list[str], preference: list[str]) -> Column:
    pick = F.struct("method_id", "lon", "lat", "length", "width")
    return preferred(case, "method_id", preference, "weight", "ord", pick).over(Window.partitionBy(*case))


def suite_scatter(hits: DataFrame, case: list[str], preference: list[str]) -> DataFrame:
    """Population scatter about the preferred primary, within 12 and 8 degrees, with ok and failed counts."""
    counts = hits.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    good = hits.where(F.col("ok") & ~F.col("method_id").contains("EDGE")).withColumn("_p", primary_row(case, preference))
    dl, da = wrap_diff("lon", "_p.lon"), F.col("lat") - F.col("_p.lat")
    near_l, near_a = F.when(F.abs(dl) < 12.0, dl), F.when(F.abs(da) < 8.0, da)
    sc = good.groupBy(*case).agg(
        F.max("_p.method_id").alias("primary_id"),
        F.when(F.count(near_l) >= 2, F.stddev_pop(near_l)).otherwise(F.lit(0.0)).alias("scatter_lon"),
        F.when(F.count(near_a) >= 2, F.stddev_pop(near_a)).otherwise(F.lit(0.0)).alias("scatter_lat"),
    )
    return counts.join(sc, case, "left")


def definition_scatter(
    hits: DataFrame, case: list[str], preference: list[str], max_dlon=8.0, max_dlat=5.0, floor=0.15, cap=(3.0, 2.0)
) -> DataFrame:
    """Weighted RMS of the other definitions about the primary, with a fallback floor and caps."""
    r = hits.withColumn("_p", primary_row(case, preference))
    dl, da = wrap_diff("lon", "_p.lon"), F.col("lat") - F.col("_p.lat")
    near = (F.abs(dl) <= max_dlon) & (F.abs(da) <= max_dlat)
    w = F.when(near, F.col("weight"))

    def rms(d: Column, top: float) -> Column:
        value = F.sqrt(F.try_divide(F.sum(w * d * d), F.sum(w)))
        return F.least(F.when(F.count(w) >= 2, value).otherwise(F.lit(floor)), F.lit(top))

    return r.groupBy(*case).agg(
        F.max("_p.method_id").alias("primary_id"), F.max("_p.lon").alias("lon"), F.max("_p.lat").alias("lat"),
        rms(dl, cap[0]).alias("sys_lon"), rms(da, cap[1]).alias("sys_lat"),
    )


def by_role(hits: DataFrame, case: list[str], role: str, weight: str, means: list[str]) -> DataFrame:
    """One row per case and role, to which every hit of the role contributes.

    `lon` is the weighted circular mean, lat and `means` are weighted means, `n_hits` counts the hits. Sums combine map-side.
    """
    w, a = F.col(weight), F.radians("lon")
    return hits.groupBy(*case, role).agg(
        wrap_deg(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a))))).alias("lon"),
        *[(F.sum(w * F.col(x)) / F.sum(w)).alias(x) for x in ("lat", *means)], F.count(F.lit(1)).alias("n_hits"),
    )


# Estimator roles from most to least trusted.
ROLES = ["gs_map", "gs_tmpl", "engine", "map_dark", "template", "moment"]


def champion_centre(df: DataFrame, case: list[str], role: str, dark: str, cm, lat0: float = -22.0) -> DataFrame:
    """Best centre of up to six estimator roles, with leave-one-out scatter.

    Map-edge locks and rows outside the wide latitude window are dropped. The densest ten-degree group sets the seed,
    the most trusted role within twelve degrees of it is the primary and is moved 40 % towards the weighted mean of its
    neighbours. Leave-one-out values come from totals minus the own row.
    """
    by = Window.partitionBy(*case)
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(ROLES))):
        rank = F.when(F.col(role) == name, F.lit(i)).otherwise(rank)
    rel = F.abs(wrap_diff("lon", cm))
    maps = F.col(role).isin("gs_map", "map_dark")
    d = F.coalesce(F.col(dark), F.lit(0.0))
    w = F.exp(-0.5 * F.pow((F.col("lat") - lat0) / 4.5, 2)) * F.when(rel > 85.0, F.lit(0.25)).otherwise(F.lit(1.0))
    w = w * F.when(d > 0, 1.0 + F.least(F.lit(1.5), d)).when((d == 0) & maps, F.lit(0.85)).otherwise(F.lit(1.0))
    w = w * F.when(F.col(role).isin("gs_map", "gs_tmpl"), F.lit(1.40)).otherwise(F.lit(1.0))
    w = w * F.when(F.col(role) == "engine", F.lit(1.15)).otherwise(F.lit(1.0))
    w = w * F.when((d < 0.05) & F.col(role).isin("gs_map", "map_dark", "moment"), F.lit(0.35)).otherwise(F.lit(1.0))
    good = df.withColumns({"_r": rank, "_rel": rel, "_w": w, "_dark": d}).where(
        (F.col("_r") < 99) & F.col("lat").between(-36.0, -10.0) & (F.abs(F.col("_rel") - 90.0) >= 3.0)
    )
    good = neighbour_count(good, case, "lon", 10.0, "_nn")
    good = good.withColumn("_seed", F.max_by("lon", F.struct("_nn", -F.col("_r"))).over(by))
    close = F.abs(wrap_diff("lon", "_seed")) <= 12.0
    good = good.withColumn(
        "_p", F.min_by(F.struct(F.col(role).alias("role"), "lon", "lat"), F.when(close, F.col("_r"))).over(by)
    )
    good = good.withColumn("_in", F.abs(wrap_diff("lon", "_p.lon")) <= 12.0)
    wi = F.when(F.col("_in"), F.col("_w")).otherwise(F.lit(0.0))
    a = F.radians("lon")
    good = good.withColumns({"_wi": wi, "_s": wi * F.sin(a), "_c": wi * F.cos(a), "_wl": wi * F.col("lat")})
    tot = {f"_T{x}": F.sum(f"_{x}").over(by) for x in ("wi", "s", "c", "wl")}
    good = good.withColumns(tot).withColumn("_ni", F.count_if("_in").over(by))
    mean_lon = wrap_deg(F.degrees(F.atan2(F.col("_Ts"), F.col("_Tc"))))
    many = F.col("_ni") >= 2
    good = good.withColumns({
        "_plon": F.when(many, wrap_deg(F.col("_p.lon") + 0.40 * wrap_diff(mean_lon, "_p.lon"))).otherwise(F.col("_p.lon")),
        "_plat": F.when(many, 0.60 * F.col("_p.lat") + 0.40 * F.col("_Twl") / F.col("_Twi")).otherwise(F.col("_p.lat")),
    })
    loo_lon = wrap_diff(
        wrap_deg(F.degrees(F.atan2(F.col("_Ts") - F.col("_s"), F.col("_Tc") - F.col("_c")))), "_plon"
    )
    loo_lat = F.try_divide(F.col("_Twl") - F.col("_wl"), F.col("_Twi") - F.col("_wi")) - F.col("_plat")
    three = F.col("_ni") >= 3
    good = good.withColumns({
        "_jl": F.when(F.col("_in"), F.when(three, loo_lon).otherwise(wrap_diff("lon", "_plon"))),
        "_ja": F.when(F.col("_in"), F.when(three, loo_lat).otherwise(F.col("lat") - F.col("_plat"))),
    })
    pick = lambda name, col: F.max(F.when(F.col(role) == name, F.col(col)))
    one = good.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_good"), F.max("_ni").alias("n_in"), F.max("_plon").alias("_plon"),
        F.max("_plat").alias("_plat"), F.max("_p.role").alias("_role"),
        F.stddev_samp("_jl").alias("_sl"), F.stddev_samp("_ja").alias("_sa"),
        pick("gs_map", "lon").alias("_ml"), pick("gs_map", "lat").alias("_ma"), pick("gs_map", "_dark").alias("_md"),
        pick("gs_tmpl", "lon").alias("_tl"), pick("gs_tmpl", "lat").alias("_ta"), pick("gs_tmpl", "_dark").alias("_td"),
    )
    fac = F.when(F.col("n_in") >= 3, F.sqrt(F.col("n_in") / (F.col("n_in") - 1.0))).otherwise(F.lit(1.0))
    alone = F.col("n_in") < 2
    sl = F.when(alone, F.lit(0.7)).otherwise(F.col("_sl") * fac)
    sa = F.when(alone, F.lit(0.45)).otherwise(F.col("_sa") * fac)
    gl, ga = F.abs(wrap_diff("_ml", "_tl")), F.abs(F.col("_ma") - F.col("_ta"))
    lock = F.coalesce((gl <= 1.25) & (ga <= 1.5) & ((F.col("_md") >= 0.08) | (F.col("_td") >= 0.08)), F.lit(False))
    root2 = F.sqrt(F.lit(2.0))
    return one.select(
        *case, "n_good", "n_in", lock.alias("dual_lock"),
        F.when(lock, wrap_deg(F.col("_ml") + 0.5 * wrap_diff("_tl", "_ml"))).otherwise(F.col("_plon")).alias("lon"),
        F.when(lock, 0.5 * (F.col("_ma") + F.col("_ta"))).otherwise(F.col("_plat")).alias("lat"),
        F.when(lock, F.lit("gs_map")).otherwise(F.col("_role")).alias("role"),
        F.when(lock, F.least(sl, F.greatest(F.lit(0.08), gl / root2))).otherwise(sl).alias("sigma_lon"),
        F.when(lock, F.least(sa, F.greatest(F.lit(0.06), ga / root2))).otherwise(sa).alias("sigma_lat"),
    )


def evidence(df: DataFrame, case: list[str], lon0, lat0, score: str, disk: Column, measurable: Column) -> DataFrame:
    """Readiness score from agreement, support, signal and disk quality, with reasons."""
    by = Window.partitionBy(*case)
    r = df.withColumns({
        "_dl": F.abs(wrap_diff("lon", lon0)), "_da": F.abs(F.col("lat") - as_col(lat0)), "_q": disk, "_m": measurable,
    })
    r = r.withColumns({"_ml": F.median("_dl").over(by), "_ma": F.median("_da").over(by)})
    g = r.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n"), (1.4826 * F.median(F.abs(F.col("_dl") - F.col("_ml")))).alias("disp_lon"),
        (1.4826 * F.median(F.abs(F.col("_da") - F.col("_ma")))).alias("disp_lat"),
        F.max("_dl").alias("_xl"), F.max("_da").alias("_xa"), F.median(score).alias("_sc"),
        F.max("_q").alias("_q"), F.bool_and("_m").alias("_m"),
    )
    al = F.exp(-0.5 * F.pow(F.col("disp_lon") / 8.0, 2))
    aa = F.exp(-0.5 * F.pow(F.col("disp_lat") / 3.5, 2))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    conf = unit(
        0.38 * F.sqrt(al * aa) + 0.27 * F.least(F.lit(1.0), F.col("n") / 3.0)
        + 0.20 * unit(F.coalesce(F.col("_sc"), F.lit(0.0)) / 3.0) + 0.15 * F.col("_q")
    )
    g = g.withColumns({"agreement": F.sqrt(al * aa), "confidence": conf})
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < 2, F.lit("few_estimators")), F.when(F.col("_xl") > 18.0, F.lit("lon_disagreement")),
        F.when(F.col("_xa") > 8.0, F.lit("lat_disagreement")), F.when(~F.col("_m"), F.lit("disk_gate")),
    ))
    unsure = (F.col("confidence") < 0.45) | (F.col("n") < 2) | ~F.col("_m") | (F.col("_xa") > 8.0)
    return g.select(
        *case, "n", "disp_lon", "disp_lat", "agreement", "confidence", unsure.alias("indeterminate"),
        F.array_join(reasons, ",").alias("reasons"),
    )


def stable_limb(df: DataFrame, case: list[str], ord_: str) -> DataFrame:
    """Weighted disk centre and scale of limb probes; columns lon, lat, xc, yc, a_eq."""
    by = Window.partitionBy(*case)
    ok = F.col("lat").between(-36.0, -10.0)
    spread = df.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_if(ok).alias("n_stable"),
        *[(F.max(x) - F.min(x)).alias(f"{x}_spread") for x in ("xc", "yc", "a_eq")],
        *[F.median(x).alias(f"_m_{x}") for x in ("xc", "yc", "a_eq")],
    )
    v = neighbour_count(df.where(ok), case, "lon", 8.0, "_nn")
    v = v.withColumn("_seed", F.max_by("lon", F.struct("_nn", -F.col(ord_))).over(by))
    v = v.withColumn("_am", F.median("a_eq").over(by))
    w = F.exp(-0.5 * F.pow(F.abs(wrap_diff("lon", "_seed")) / 4.0, 2)) * F.exp(
        -0.5 * F.pow((F.col("a_eq") - F.col("_am")) / (0.03 * F.col("_am") + 1e-6), 2)
    )
    v = v.withColumn("_w", F.greatest(w, F.lit(1e-3)))
    s = v.groupBy(*case).agg(*[(F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias(x) for x in ("xc", "yc", "a_eq")])
    return spread.join(s, case, "left").select(
        *case, "n_probes", "n_stable", "xc_spread", "yc_spread", "a_eq_spread",
        *[F.coalesce(F.col(x), F.col(f"_m_{x}")).alias(x) for x in ("xc", "yc", "a_eq")],
    )


def top_per_family(df: DataFrame, case: list[str], weight: str, ord_: str, per: int = 2, above: int = 8, least: int = 6):
    """At most `per` rows per family by weight, only in cases with more than `above` rows that keep at least `least`."""
    by = Window.partitionBy(*case)
    r = df.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn(
        "_k", first_by([*case, "family"], F.desc(weight), F.col(ord_)) <= per
    )
    r = r.withColumn("_left", F.count_if("_k").over(by))
    return r.where((F.col("_n") <= above) | (F.col("_left") < least) | F.col("_k")).drop("_n", "_k", "_left")


def size_choice(df: DataFrame, case: list[str]) -> DataFrame:
    """Length and width: the measured moment extent, else the template's, else 12 x 8; columns ml mw mlat tl tw."""
    from driftline.functions.angles import FEATURE_LAT

    shape = (F.col("ml") >= 1.5) & (F.col("ml") <= 30) & (F.col("mw") >= 1) & (F.col("mw") <= 20) & (
        F.col("ml") / F.greatest(F.col("mw"), F.lit(1e-6)) <= 8
    )
    m = shape & F.col("mlat").between(FEATURE_LAT - 14, FEATURE_LAT + 10) & F.col("ml").between(4, 28) & F.col(
        "mw").between(2, 16)
    t = F.col("tl").between(5, 22) & F.col("tw").between(3, 14)
    pick = lambda a, b, d: F.when(m, a).when(t, b).otherwise(F.lit(d))
    return df.select(
        *case, pick(F.col("ml"), F.col("tl"), 12.0).alias("length"), pick(F.col("mw"), F.col("tw"), 8.0).alias("width"),
        pick(F.lit("moment_map_extent"), F.lit("template_prior_size"), "literature_default_size").alias("size_source"),
    )


# Base weights and blend weights of the four image methods.
METHOD_WEIGHTS = {"template": 2.6, "moment": 2.6, "map_dark": 2.5, "redness": 2.4}
CORROBORATION_DEG, LAT_CORROBORATION_DEG = 8.0, 3.0
LON_BLEND = {"template": 0.5, "moment": 0.5, "redness": 3.5}
LAT_BLEND = {"template": 0.25, "moment": 0.75, "redness": 0.5}


def _blend(names, pos, weight, present) -> Column:
    """Weighted circular mean over the named methods that are present."""
    s = sum((F.when(present[n], weight[n] * F.sin(F.radians(pos[n]))).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    k = sum((F.when(present[n], weight[n] * F.cos(F.radians(pos[n]))).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    return wrap_deg(F.degrees(F.atan2(s, k)))


def _average(names, val, weight, present) -> Column:
    top = sum((F.when(present[n], weight[n] * val[n]).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    low = sum((F.when(present[n], weight[n] + F.lit(0.0)).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    return top / F.when(low != 0, low)


def image_consensus(df: DataFrame, case: list[str], role: str) -> DataFrame:
    """Position from the template, moment, map_dark and redness rows of a case (one each at most).

    Columns lon, lat, score, contrast, length, width. A tight dark cluster, the colour lock, the template or the moment
    gives the seed, in that order; methods beyond twelve degrees of it are dropped; a corroborated template is blended
    with moment and colour, an uncorroborated one is replaced by its peers. The colour primary then overrides on usable
    frames unless it is isolated from a tight dark cluster.
    """
    from driftline.functions.angles import FEATURE_LAT

    dark, names = ("template", "moment", "map_dark"), ("template", "moment", "map_dark", "redness")
    sane = df.where(F.col(role).isin(list(names)) & F.col("lat").between(FEATURE_LAT - 14.0, FEATURE_LAT + 10.0))
    fields = ("lon", "lat", "score", "contrast", "length", "width")
    wide = sane.groupBy(*case).agg(*[
        F.max(F.when(F.col(role) == n, F.struct(*fields))).alias(n) for n in names
    ])
    lon, lat = {n: F.col(f"{n}.lon") for n in names}, {n: F.col(f"{n}.lat") for n in names}
    has = {n: F.col(n).isNotNull() for n in names}
    gap = lambda a, b: F.abs(wrap_diff(lon[a], lon[b]))
    tight = {n: has[n] & lat[n].between(FEATURE_LAT - 6.0, FEATURE_LAT + 6.0) for n in names}
    false = F.lit(False)
    yes = lambda x: F.coalesce(x, false)
    bell = lambda n: F.exp(-0.5 * F.pow((lat[n] - FEATURE_LAT) / 5.0, 2))
    tq = F.when(has["template"], (F.col("template.contrast") + 0.01 * F.col("template.score")) * bell("template"))
    size_ok = F.col("moment.length").between(4.0, 22.0) & F.col("moment.width").between(2.0, 14.0)
    mq = F.when(has["moment"], F.when(size_ok, F.lit(2.0)).otherwise(F.lit(0.15)) * bell("moment"))
    wide = wide.withColumns({"_tq": F.coalesce(tq, F.lit(0.0)), "_mq": F.coalesce(mq, F.lit(0.0))})
    near = {(a, b): yes(tight[a] & tight[b] & (gap(a, b) <= 12.0)) for a in dark for b in dark}
    wide = wide.withColumns({f"_c_{a}": sum((near[a, b].cast("int") for b in dark), F.lit(0)) for a in dark})
    best = F.greatest(*[F.col(f"_c_{a}") for a in dark])
    lead = F.lit(None).cast("string")
    for a in reversed(dark):
        lead = F.when(F.col(f"_c_{a}") == best, F.lit(a)).otherwise(lead)
    wide = wide.withColumns({"_lead": lead, "_dark_tight": best >= 2})
    core = {n: yes(sum(((F.col("_lead") == a) & near[a, n]).cast("int") for a in dark) > 0) for n in dark}
    one = {n: F.lit(1.0) for n in names}
    split = yes(gap("template", "moment") > 12.0)
    any_dark = has["template"] | has["moment"] | has["map_dark"]
    alone = tight["redness"] & any_dark
    for n in dark:
        alone = alone & (~has[n] | yes(gap("redness", n) > 12.0))
    heavy = F.when(has["template"], lon["template"]).when(has["moment"], lon["moment"]).when(
        has["map_dark"], lon["map_dark"]).otherwise(lon["redness"])
    seed = (
        F.when(F.col("_dark_tight"), _blend(dark, lon, one, core))
        .when(has["redness"] & (split | alone), lon["redness"])
        .when(has["template"] & (F.col("_tq") >= 0.05), lon["template"])
        .when(has["moment"] & (F.col("_mq") >= 1.0), lon["moment"])
        .otherwise(heavy)
    )
    n_all = sum((has[n].cast("int") for n in names), F.lit(0))
    wide = wide.withColumns({"_seed": seed, "_split": split, "_n": n_all})
    wide = wide.withColumns({f"_k_{n}": yes(F.abs(wrap_diff(lon[n], "_seed")) <= 12.0) for n in names})
    kept_n = sum((F.col(f"_k_{n}").cast("int") for n in names), F.lit(0))
    both = (F.col("_n") == 2) & (kept_n == 1) & ~F.col("_dark_tight")
    wide = wide.withColumns({f"_k_{n}": has[n] & (F.col(f"_k_{n}") | both) for n in names})
    apart = yes(gap("template", "moment") > 10.0)
    drop_m = apart & (F.col("_tq") >= 0.05) & (F.col("_mq") < 1.0) & (F.col("_n") > 2)
    drop_t = apart & ~drop_m & (F.col("_mq") >= 1.0) & (F.col("_tq") < 0.03) & ~F.col("_dark_tight")
    drop_d = yes(gap("map_dark", "template") > 10.0) & (F.col("_tq") >= 0.05)
    wide = wide.withColumns({
        "_k_template": (F.col("_k_template") | drop_m) & ~drop_t,
        "_k_moment": (F.col("_k_moment") | drop_t) & ~drop_m,
        "_k_map_dark": F.col("_k_map_dark") & ~drop_d,
    })
    none = ~(F.col("_k_template") | F.col("_k_moment") | F.col("_k_map_dark") | F.col("_k_redness"))
    wide = wide.withColumn("_none", none)
    wide = wide.withColumns({f"_k_{n}": F.col(f"_k_{n}") | (F.col("_none") & has[n]) for n in names})
    use = {n: F.col(f"_k_{n}") for n in names}
    boost = F.when(F.col("_tq") >= 0.05, F.lit(2.5)).otherwise(F.lit(1.0))
    wt = {n: F.lit(w) * (boost if n == "template" else F.lit(1.0)) for n, w in METHOD_WEIGHTS.items()}
    wide = wide.withColumns({"_lon": _blend(names, lon, wt, use), "_lat": _average(names, lat, wt, use)})
    others = ("map_dark", "moment", "redness")
    n_oth = sum((use[n].cast("int") for n in others), F.lit(0))
    worst = F.greatest(F.lit(0.0), *[F.when(use[n], gap("template", n)) for n in others])
    wide = wide.withColumns({"_worst": worst, "_no": n_oth, "_om": _blend(others, lon, one, use)})
    tcon = F.coalesce(F.col("template.contrast"), F.lit(0.0))
    colour = has["redness"] & F.col("_split") & ~F.col("_dark_tight") & use["redness"]
    corroborated = (F.col("_no") == 0) | (F.col("_worst") <= CORROBORATION_DEG)
    locked, peers = use["template"] & (tcon >= 0.04) & corroborated, use["template"] & ~corroborated
    agree = use["template"] & (F.col("_no") > 0) & (F.abs(wrap_diff(lon["template"], "_om")) <= 6.0)
    base = {n: F.lit(w) for n, w in METHOD_WEIGHTS.items()}
    trio = ("template", "moment", "redness")
    some = {"template": F.lit(True), "moment": use["moment"], "redness": use["redness"]}
    lat_mix = use["moment"] & (F.abs(lat["moment"] - lat["template"]) <= LAT_CORROBORATION_DEG)
    lonw, latw = {n: F.lit(w) for n, w in LON_BLEND.items()}, {n: F.lit(w) for n, w in LAT_BLEND.items()}
    state = (
        F.when(colour, F.lit("redness_dark_split")).when(locked, F.lit("template_pos"))
        .when(peers, F.lit("peer_cluster")).when(agree, F.lit("template_agrees")).otherwise(F.lit("consensus"))
    )
    wide = wide.withColumn("_state", state)
    s = F.col("_state")
    wide = wide.withColumns({
        "_lon2": F.when(s == "redness_dark_split", lon["redness"])
        .when(s == "template_pos", _blend(trio, lon, lonw, some))
        .when(s == "peer_cluster", _blend(others, lon, base, use))
        .when(s == "template_agrees", lon["template"]).otherwise(F.col("_lon")),
        "_lat2": F.when(s == "redness_dark_split", lat["redness"])
        .when(s == "template_pos", F.when(lat_mix, _average(trio, lat, latw, some)).otherwise(
            0.80 * lat["template"] + 0.20 * F.col("_lat")))
        .when(s == "peer_cluster", _average(others, lat, base, use))
        .when(s == "template_agrees", 0.75 * lat["template"] + 0.25 * F.col("_lat")).otherwise(F.col("_lat")),
    })
    gaps = [F.when(has[n], gap("redness", n)) for n in dark]
    red_ok = use["redness"] & (F.col("redness.score") > 0) & tight["redness"]
    red_ok = yes(red_ok) & ~(F.col("_dark_tight") & yes(F.least(*gaps) > 12.0))
    wide = wide.withColumn("colour_primary", red_ok)
    wide = wide.withColumns({
        "lon": F.when(F.col("colour_primary"), lon["redness"]).otherwise(F.col("_lon2")),
        "lat": F.when(F.col("colour_primary"), lat["redness"]).otherwise(F.col("_lat2")),
    })
    total = sum((F.when(use[n], wt[n]).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    sq = lambda v: sum((F.when(use[n], wt[n] * v(n) * v(n)).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    nk = sum((use[n].cast("int") for n in names), F.lit(0))
    return wide.select(
        *case, F.col("_n").alias("n_methods"), nk.alias("n_kept"), F.col("_dark_tight").alias("dark_tight"),
        F.round(F.col("_seed"), 6).alias("seed_lon"), s.alias("path"),
        F.col("_lon2").alias("consensus_lon"), F.col("_lat2").alias("consensus_lat"), "colour_primary", "lon", "lat",
        F.when(nk >= 2, F.sqrt(sq(lambda n: wrap_diff(lon[n], "lon")) / total)).otherwise(F.lit(0.5)).alias("rms_lon"),
        F.when(nk >= 2, F.sqrt(sq(lambda n: lat[n] - F.col("lat")) / total)).otherwise(F.lit(0.3)).alias("rms_lat"),
    )


def method_error(df: DataFrame, a_eq_px, distance_au) -> DataFrame:
    """Floors the method RMS at 0.35 px, adds the sky error and a 0-1 quality."""
    from driftline.functions.angles import sky_error_arcsec

    px = F.degrees(0.35 / (as_col(a_eq_px) + 1e-12))
    df = df.withColumns({"err_lon": F.greatest("rms_lon", px), "err_lat": F.greatest("rms_lat", px)})
    df = df.withColumn("sky_arcsec", sky_error_arcsec("err_lon", "err_lat", "lat", distance_au))
    return df.withColumn("quality", F.greatest(F.lit(0.0), 1.0 - F.col("sky_arcsec") / 10.0))
