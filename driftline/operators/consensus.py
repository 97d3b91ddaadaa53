"""Robust consensus of many estimates of one position, as expressions over one array per case.

A case holds at most one row per method, so its rows travel as one array; a case with more rows than `MOST` is an error, never
cut. Clusters are a fold over that array; scores, clip rounds and weights are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.angles import wrap_deg, wrap_diff
from driftline.functions.priors import centre_method, map_edge_lock, near_pipeline

from .images import quantile, settle

c = F.col

#: Rows a case may hold; the catalogue of methods is far smaller.
MOST = 2000

# The feature's latitude and half band, and the name of the row that stands for the pipeline.
LAT0, HALF, SEED = -22.0, 8.0, "PIPELINE_SEED"
# Methods that strengthen a cluster.
STRONG = ["ENGINE", "MS_NCC", "MAP_DARK", "BARY_IMG", "ENS_MEDIAN", "QUAD_MOM", "MULTI_ISO", "PIPELINE_SEED", "OVAL",
          "MID", "MORPH", "ISOPHOTE"]
# Reach of a cluster in longitude and latitude; clip limit, rounds and scale floor.
REACH_LON, REACH_LAT, CLIP, ROUNDS, FLOOR = 14.0, 8.0, 2.8, 4, 0.05


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def summed(arr: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))


def median(arr: Column) -> Column:
    return bind(F.array_sort(arr), lambda a: quantile(a, 0.5))


def circular_median(lons: Column) -> Column:
    """Median of the offsets from the circular mean."""
    mean = F.degrees(F.atan2(summed(lons, lambda v: F.sin(F.radians(v))), summed(lons, lambda v: F.cos(F.radians(v)))))
    return bind(mean, lambda m: wrap_deg(m + median(F.transform(lons, lambda v: wrap_diff(v, m)))))


def scale_of(arr: Column) -> Column:
    """Scaled median absolute deviation with a floor."""
    mad = bind(median(arr), lambda m: median(F.transform(arr, lambda v: F.abs(v - m))))
    return F.greatest(1.4826 * mad, F.lit(FLOOR))


def field(arr: Column, name: str) -> Column:
    return F.transform(arr, lambda p: p[name])


def near_pipe(lon: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(wrap_diff(lon, c("pipe_lon"))) < tolerance, F.lit(False))


def gather(hits: DataFrame, case: list[str], per_family: int, beyond: int, least: int) -> DataFrame:
    """One row per case: `pts` by falling weight, `edges` (ids at the map's edge) and `cut` (ids beyond the family limit).

    Cases with more than `beyond` rows keep the `per_family` heaviest rows of each family if at least `least` remain.
    """
    m = c("method_id")
    known = F.when(~F.isnan("pipe_lon"), c("pipe_lon")), F.when(~F.isnan("pipe_lat"), c("pipe_lat"))
    rows = hits.where(centre_method("method_id", "family") & ~m.startswith("ENS_") & (m != "P_LADDER"))
    rows = rows.withColumns({"pipe_lon": known[0], "pipe_lat": known[1]})
    rows = rows.withColumn("edge", map_edge_lock("lon", "cm") & ~near_pipeline("lon", "pipe_lon", 22.0))
    family = Window.partitionBy(*case, "edge", "family")
    rows = rows.withColumns({
        "_rank": F.row_number().over(family.orderBy(F.desc("prior_weight"), "ord")), "_first": F.min("ord").over(family)})
    item = F.struct("ord", "_first", "_rank", "edge", m.alias("id"), "family", "lon", "lat", c("prior_weight").alias("w"))
    d = rows.groupBy(*case).agg(
        F.collect_list(item).alias("rows"), *[F.max(x).alias(x) for x in ("cm", "pipe_lon", "pipe_lat")])
    too_many = F.raise_error(F.lit(f"a case holds more than {MOST} rows")).cast("boolean")
    d = settle(d.where(F.when(F.size("rows") > MOST, too_many).otherwise(F.lit(True))))
    d = settle(d.withColumns({
        "edges": F.transform(F.filter("rows", lambda p: p["edge"]), lambda p: p["id"]), "all": F.filter("rows", lambda p: ~p["edge"])}))
    few = F.filter("all", lambda p: p["_rank"] <= per_family)
    d = settle(d.withColumn("limited", (F.size("all") > beyond) & (F.size(few) >= least)))
    kept = F.when(c("limited"), few).otherwise(c("all"))
    d = settle(d.withColumns({
        "kept": F.transform(kept, lambda p: F.struct(
            -p["w"], F.when(c("limited"), p["_first"]).otherwise(p["ord"]).cast("long"), p["ord"].cast("long"), p["id"], p["lon"], p["lat"],
            F.abs(p["lat"] - LAT0) <= HALF)),
        "cut": F.transform(F.filter("all", lambda p: c("limited") & (p["_rank"] > per_family)), lambda p: p["id"])}))
    kind = "array<struct<neg:double,tie:bigint,ord:bigint,id:string,lon:double,lat:double,ok:boolean>>"
    last = F.lit(2**62)
    lat = F.coalesce("pipe_lat", F.lit(LAT0))
    seed = F.struct(F.lit(-4.0), last, last, F.lit(SEED), c("pipe_lon"), lat, F.abs(lat - LAT0) <= HALF + 2)
    lonely = c("pipe_lon").isNotNull() & ~F.exists(c("kept").cast(kind), lambda p: near_pipe(p["lon"], 20.0))
    return settle(d.select(
        *case, "cm", "pipe_lon", "pipe_lat", "edges", "cut",
        F.array_sort(F.when(lonely, F.concat(c("kept").cast(kind), F.array(seed).cast(kind))).otherwise(c("kept").cast(kind))).alias("pts")))


def clustered(pts: Column) -> Column:
    """Greedy clusters: the heaviest free row opens one; it takes all free rows in reach of its circular median until none is.

    Each step of the fold adds rows to the open cluster or closes it and opens the next, so there are at most as many as rows.
    """
    head = lambda a: F.slice(a, 1, 1)
    rest = lambda a: F.filter(a, lambda p, i: i > 0)

    def step(s: Column, _: Column) -> Column:
        open_, free = s["open"], s["free"]
        reach = lambda p, mid: (F.abs(wrap_diff(p["lon"], mid)) <= REACH_LON) & (F.abs(p["lat"] - open_[0]["lat"]) < REACH_LAT)

        def grown(mid: Column) -> Column:
            more = F.filter(free, lambda p: reach(p, mid))
            left = F.filter(free, lambda p: ~reach(p, mid))
            state = lambda o, f, d: F.struct(o.alias("open"), f.alias("free"), d.alias("done"))
            return F.when(F.size(more) > 0, state(F.concat(open_, more), left, s["done"])).when(
                F.size(free) > 0, state(head(free), rest(free), F.concat(s["done"], F.array(open_)))).otherwise(s)

        return bind(circular_median(field(open_, "lon")), grown)

    start = F.struct(head(pts).alias("open"), rest(pts).alias("free"), F.slice(F.array(pts), 1, 0).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.size(pts)), start, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def rated(clusters: Column, strong: list[str]) -> Column:
    """Clusters by falling score: size, weight, latitude, edge, pipeline, strong methods, meridian; the first wins a tie."""
    names = F.array(*[F.lit(x) for x in strong]) if strong else F.array().cast("array<string>")

    def score(g: Column, mid: Column) -> Column:
        away = F.abs(wrap_diff(mid, c("pipe_lon")))
        at_meridian = F.coalesce(F.abs(wrap_diff(mid, c("cm"))) < 8, F.lit(False))
        support = 2.0 * F.size(g) - summed(g, lambda p: p["neg"]) - 2.5 * F.abs(median(field(g, "lat")) - LAT0)
        locked = map_edge_lock(mid, c("cm")) & ~near_pipe(mid, 18.0)
        pull = F.when(away < 12, 35.0 - 1.5 * away).when(away < 25, 12.0 - 0.6 * (away - 12.0)).when(
            away >= 25, -(40.0 + 0.5 * F.least(away, F.lit(90.0)))).otherwise(F.lit(0.0))
        trap = F.when(at_meridian & (away > 25), F.lit(100.0)).when(at_meridian, F.lit(4.0)).otherwise(F.lit(0.0))
        return support - F.when(locked, F.lit(60.0)).otherwise(F.lit(0.0)) + pull + 4.0 * F.size(
            F.array_intersect(field(g, "id"), names)) - trap

    return F.array_sort(F.transform(clusters, lambda g, i: bind(
        circular_median(field(g, "lon")),
        lambda mid: F.struct((-score(g, mid)).alias("neg"), i.alias("i"), mid.alias("mid"), F.size(g).alias("n")))))


def chosen(ranked: str) -> Column:
    """The best cluster; one far from the pipeline gives way to the best of those near it that have two rows or more."""
    away = lambda r: F.abs(wrap_diff(r["mid"], c("pipe_lon")))
    close = F.array_sort(F.transform(
        F.filter(ranked, lambda r: (away(r) < 22) & (r["n"] >= 2)), lambda r, j: F.struct((r["neg"] - 25.0 + 0.5 * away(r)).alias("neg"), j.alias("j"), r["i"].alias("i"))))
    plain = F.struct(F.get(ranked, F.lit(0))["neg"].alias("neg"), F.get(ranked, F.lit(0))["i"].alias("i"))
    first = F.struct(F.get(close, F.lit(0))["neg"].alias("neg"), F.get(close, F.lit(0))["i"].alias("i"))
    return F.when((away(F.get(ranked, F.lit(0))) > 30) & (F.size(close) > 0), first).otherwise(plain)


def clip_round(d: DataFrame) -> DataFrame:
    """One round: rows beyond the clip limit of either axis, or barred, go; a round that would leave fewer than five keeps the nearer half."""
    d = settle(d.withColumns({
        "_dl": F.transform("keep", lambda p: wrap_diff(p["lon"], c("mlon"))), "_da": F.transform("keep", lambda p: p["lat"] - c("mlat"))}))
    d = settle(d.withColumns({"_sl": scale_of(c("_dl")), "_sa": scale_of(c("_da"))}))
    barred = lambda p: (~p["ok"] & (F.abs(p["lat"] - LAT0) > HALF + 2)) | (map_edge_lock(p["lon"], c("cm")) & ~near_pipe(p["lon"], 22.0))
    far = lambda i: (F.abs(F.get("_dl", i)) > CLIP * c("_sl")) | (F.abs(F.get("_da", i)) > CLIP * c("_sa"))
    good = F.filter("keep", lambda p, i: ~(far(i) | barred(p)))
    d = settle(d.withColumn("_good", good))
    order = F.array_sort(F.transform("keep", lambda p, i: F.struct((F.abs(F.get("_dl", i)) + F.abs(F.get("_da", i))).alias("far"), i.alias("i"), p.alias("p"))))
    half = F.greatest(F.lit(5), F.floor(F.size("keep") / 2).cast("int"))
    nearer = F.transform(F.slice(order, F.lit(1), half), lambda x: x["p"])
    d = settle(d.withColumn("_next", F.when((F.size("_good") < 5) & (F.size("_good") < F.size("keep")), nearer).otherwise(c("_good"))))
    changed = (F.size("keep") >= 3) & (F.size("_next") < F.size("keep"))
    return settle(d.withColumns({
        "keep": F.when(changed, c("_next")).otherwise(c("keep")),
        "mlon": F.when(changed, circular_median(field(c("_next"), "lon"))).otherwise(c("mlon")),
        "mlat": F.when(changed, median(field(c("_next"), "lat"))).otherwise(c("mlat"))}).drop("_dl", "_da", "_sl", "_sa", "_good", "_next"))


def toward(value: str, pipe: str, share: float) -> Column:
    return F.when(c(pipe).isNull(), c(value)).otherwise((1.0 - share) * c(value) + share * c(pipe))


def robust_consensus(
    hits: DataFrame, case: list[str], strong: list[str] = STRONG, per_family: int = 2, beyond: int = 8, least: int = 6
) -> DataFrame:
    """Columns method_id, family, lon, lat, prior_weight, ord and per case cm, pipe_lon, pipe_lat.

    One row per case with any centre method: position, sigmas, n_in, n_out, n_clusters, score, effective count, and the ids that stayed
    (`inliers`, with `weights`), were rejected (`outliers`) or fell to the family limit (`cut`). Without a usable row all of the former are null.
    """
    d = gather(hits, case, per_family, beyond, least)
    d = settle(d.withColumn("clusters", F.when(F.size("pts") >= 2, clustered(c("pts")))))
    d = settle(d.withColumn("ranked", F.when(c("clusters").isNotNull(), rated(c("clusters"), strong))))
    d = settle(d.withColumn("best", F.when(c("clusters").isNotNull(), chosen("ranked"))))
    d = settle(d.withColumn("keep", F.coalesce(F.get("clusters", c("best.i")), c("pts"))))
    d = settle(d.withColumns({"mlon": circular_median(field(c("keep"), "lon")), "mlat": median(field(c("keep"), "lat"))}))
    close = near_pipe(c("mlon"), 12.0)
    d = settle(d.withColumns({
        "mlon": F.when(close, wrap_deg(c("mlon") + 0.15 * wrap_diff("pipe_lon", "mlon"))).otherwise(c("mlon")),
        "mlat": F.when(close, toward("mlat", "pipe_lat", 0.15)).otherwise(c("mlat"))}))
    for _ in range(ROUNDS):
        d = clip_round(d)
    return weighed(d, case)


def weighed(d: DataFrame, case: list[str]) -> DataFrame:
    """Weighted position and sigmas of what the rounds kept."""
    d = settle(d.withColumns({
        "_dl": F.transform("keep", lambda p: wrap_diff(p["lon"], c("mlon"))), "_da": F.transform("keep", lambda p: p["lat"] - c("mlat"))}))
    d = settle(d.withColumns({"ml": scale_of(c("_dl")), "ma": scale_of(c("_da"))}))
    bonus = lambda p: F.coalesce(1.0 + F.greatest(F.lit(0.0), 1.0 - F.abs(wrap_diff(p["lon"], c("pipe_lon"))) / 15.0), F.lit(1.0))
    raw = F.transform("keep", lambda p, i: -p["neg"] / (1.0 + F.pow(F.get("_dl", i) / c("ml"), F.lit(2.0)) + F.pow(F.get("_da", i) / c("ma"), F.lit(2.0)))
                      * F.when(p["ok"], F.lit(1.0)).otherwise(F.lit(0.35)) * F.when(c("pipe_lon").isNull(), F.lit(1.0)).otherwise(bonus(p)))
    d = settle(d.withColumn("_w", raw))
    d = settle(d.withColumn("_t", summed(c("_w")) + 1e-12))
    d = settle(d.withColumn("_q", F.transform("keep", lambda p, i: F.struct(p["id"].alias("id"), p["lon"].alias("lon"), p["lat"].alias("lat"), (F.get("_w", i) / c("_t")).alias("w")))))
    over = lambda f: summed(c("_q"), lambda q: q["w"] * f(q))
    mean = F.degrees(F.atan2(over(lambda q: F.sin(F.radians(q["lon"]))), over(lambda q: F.cos(F.radians(q["lon"])))))
    d = settle(d.withColumns({"lon": wrap_deg(mean), "lat": F.try_divide(over(lambda q: q["lat"]), over(lambda q: F.lit(1.0)))}))
    away = F.abs(wrap_diff("pipe_lon", "lon"))
    d = settle(d.withColumn("blend", F.coalesce((away > 4.0) & (away < 18.0), F.lit(False))))
    d = settle(d.withColumns({
        "lon": F.when(c("blend"), wrap_deg(c("lon") + 0.12 * wrap_diff("pipe_lon", "lon"))).otherwise(c("lon")),
        "lat": F.when(c("blend"), toward("lat", "pipe_lat", 0.12)).otherwise(c("lat"))}))
    d = settle(d.withColumns({
        "sl": F.sqrt(over(lambda q: F.pow(wrap_diff(q["lon"], c("lon")), F.lit(2.0)))), "sa": F.sqrt(over(lambda q: F.pow(q["lat"] - c("lat"), F.lit(2.0)))),
        "n_eff": 1.0 / (over(lambda q: q["w"]) + 1e-12)}))
    shrink = 1.0 / F.sqrt(F.greatest(F.least(c("n_eff"), F.lit(3.0)), F.lit(1.0)))
    n = F.size("pts")
    one = F.get("pts", F.lit(0))
    pick = lambda many, single: F.when(n >= 2, many).when(n == 1, single)
    ids = F.when(n > 0, F.array_sort(F.array_distinct(field(c("keep"), "id"))))
    gone = F.array_sort(F.array_except(F.array_union(field(c("pts"), "id"), c("edges")), field(c("keep"), "id")))
    return d.select(
        *case, pick(c("lon"), one["lon"]).alias("lon"), pick(c("lat"), one["lat"]).alias("lat"),
        pick(F.greatest(c("sl") * shrink, c("ml") * 0.5, F.lit(0.08)), F.lit(1.5)).alias("sigma_lon"),
        pick(F.greatest(c("sa") * shrink, c("ma") * 0.5, F.lit(0.05)), F.lit(0.8)).alias("sigma_lat"),
        pick(F.size("keep"), F.lit(1)).alias("n_in"), pick(F.size(gone), F.size("edges")).alias("n_out"),
        pick(F.size("clusters"), F.lit(1)).alias("n_clusters"), pick(-c("best.neg"), F.lit(None).cast("double")).alias("score"),
        pick(c("n_eff"), F.lit(1.0)).alias("n_eff"), F.array_join(ids, ",").alias("inliers"),
        F.array_join(gone, ",").alias("outliers"), F.array_join(F.array_sort("cut"), ",").alias("cut"),
        F.transform("_q", lambda q: F.struct(q["id"].alias("id"), q["w"].alias("weight"))).alias("weights"))
