"""Circular statistics and method-consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import priors as PR
from driftline.operators import circular as C
from driftline.operators import hits as H

from .registry import D, R, W, query
from .scalars import c, out, sky_sql
from .tables import FAMILIES

CASE = ["case_id"]
LAT0 = A.FEATURE_LAT


def cmean(lon, w="1"):
    return W(f"degrees(atan2(sum(({w})*sin(radians({lon}))),sum(({w})*cos(radians({lon})))))")


@query(
    "a01_circular_mean",
    f"""SELECT series_id, count(*) AS n, {R(cmean('lon'), 'mean_lon')}, {R(cmean('lon', '1/(sigma*sigma)'), 'wmean_lon')}
FROM d_steady GROUP BY 1""",
)
def _(t):
    df = t.steady.groupBy("series_id").agg(
        F.count("*").alias("n"), C.circular_mean("lon").alias("m"),
        C.circular_mean("lon", 1.0 / (c("sigma") * c("sigma"))).alias("w"),
    )
    return out(df, ["series_id", "n"], mean_lon=c("m"), wmean_lon=c("w"))


@query(
    "a02_circular_std",
    """SELECT series_id, round(degrees(sqrt(-2*ln(least(greatest(sqrt(pow(avg(cos(radians(lon))),2)+pow(avg(sin(radians(lon))),2)),1e-12),1)))),6) AS std_lon
FROM d_steady GROUP BY 1""",
)
def _(t):
    return t.steady.groupBy("series_id").agg(F.round(C.circular_std_deg("lon"), 6).alias("std_lon"))


@query(
    "a03_circular_median",
    f"""WITH m AS (SELECT series_id, {cmean('lon')} AS cm FROM d_steady GROUP BY 1)
SELECT series_id, {R(W('any_value(cm)+median(' + D('lon', 'cm') + ')'), 'median_lon')} FROM d_steady JOIN m USING (series_id) GROUP BY 1""",
)
def _(t):
    return out(C.circular_median(t.steady, ["series_id"], "lon", "m"), ["series_id"], median_lon=c("m"))


@query(
    "a04_mad",
    f"""WITH m AS (SELECT series_id, median(lat) AS med FROM d_series GROUP BY 1)
SELECT series_id, {R('any_value(med)', 'med')}, {R('1.4826*median(abs(lat-med))', 'mad')} FROM d_series JOIN m USING (series_id) GROUP BY 1""",
)
def _(t):
    return out(C.mad_table(t.series, ["series_id"], "lat"), ["series_id"], med=c("med"), mad=c("mad"))


_ENS = f"""WITH g AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM d_good),
m AS (SELECT case_id, {cmean('lon')} AS cm FROM g WHERE n>=2 GROUP BY 1),
e AS (SELECT g.*, cm, {D('lon', 'cm')} AS d FROM g JOIN m USING (case_id)),
md AS (SELECT case_id, {W('any_value(cm)+median(d)')} AS ml, median(lat) AS ma FROM e GROUP BY 1),
r AS (SELECT e.*, ml, ma, row_number() OVER (PARTITION BY case_id ORDER BY abs(d), ord) AS rk,
 row_number() OVER (PARTITION BY case_id ORDER BY round(abs({D('lon', 'ml')})+abs(lat-ma),9), ord) AS mk FROM e JOIN md USING (case_id))
"""


@query(
    "a05_ensembles",
    _ENS
    + f"""SELECT case_id, 'ENS_WMEAN' AS method_id, 3.5e0 AS weight, {R(cmean('lon', 'weight'), 'lon')}, {R('sum(weight*lat)/sum(weight)', 'lat')} FROM r GROUP BY 1
UNION ALL SELECT case_id, 'ENS_MEDIAN', 3.5e0, round(ml,6), round(ma,6) FROM md
UNION ALL SELECT case_id, 'ENS_TRIM', 3.0e0, round({cmean('lon')},6), round(avg(lat),6) FROM r WHERE rk<=greatest(2,floor(n*0.8e0)) GROUP BY 1
UNION ALL SELECT case_id, 'ENS_MEDOID', 3.2e0, round(lon,6), round(lat,6) FROM r WHERE mk=1""",
)
def _(t):
    df = H.ensembles(t.good_hits, CASE, "lon", "lat", "weight", "ord")
    return out(df, ["case_id", "method_id", "weight"], lon=c("lon"), lat=c("lat"))


@query(
    "a06_family_ensembles",
    f"""SELECT case_id, family, count(*) AS n, {R(cmean('lon'), 'lon')}, {R('avg(lat)', 'lat')} FROM d_good
WHERE family IN ('click','view','error') GROUP BY 1,2 HAVING count(*)>=2""",
)
def _(t):
    df = H.family_ensembles(t.good_hits, CASE, ["click", "view", "error"])
    return out(df, ["case_id", "family", "n"], lon=c("lon"), lat=c("lat"))


PREF = ["click_0", "view_1", "error_2"]


def pref_sql(src):
    return f"""(SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE method_id WHEN 'click_0' THEN 0
 WHEN 'view_1' THEN 1 WHEN 'error_2' THEN 2 ELSE 9 END, CASE WHEN method_id IN ('click_0','view_1','error_2') THEN 0 ELSE -weight END, ord) AS pk FROM {src})"""


@query(
    "a07_suite_scatter",
    f"""WITH p AS (SELECT case_id, method_id AS primary_id, lon AS pl, lat AS pa FROM {pref_sql('d_good')} WHERE pk=1),
s AS (SELECT case_id, any_value(primary_id) AS primary_id, coalesce(stddev_pop({D('lon', 'pl')}) FILTER (WHERE abs({D('lon', 'pl')})<12),0) AS sl,
 coalesce(stddev_pop(lat-pa) FILTER (WHERE abs(lat-pa)<8),0) AS sa FROM d_good JOIN p USING (case_id) GROUP BY 1)
SELECT case_id, n_total, n_ok, n_failed, primary_id, {R('sl', 'scatter_lon')}, {R('sa', 'scatter_lat')} FROM
(SELECT case_id, count(*) AS n_total, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed FROM d_hits GROUP BY 1)
LEFT JOIN s USING (case_id)""",
)
def _(t):
    df = H.suite_scatter(t.hits, CASE, PREF)
    keys = ["case_id", "n_total", "n_ok", "n_failed", "primary_id"]
    return out(df, keys, scatter_lon=c("scatter_lon"), scatter_lat=c("scatter_lat"))


_NN = f"""nn AS (SELECT a.case_id, a.ord, a.lon, count(*) AS n_near FROM d_good a JOIN d_good b
 ON a.case_id=b.case_id AND abs({D('a.lon', 'b.lon')})<=18 GROUP BY 1,2,3),
seed AS (SELECT case_id, lon AS s FROM nn QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n_near DESC, ord)=1),
ctr AS (SELECT case_id, {cmean('lon')} AS centre FROM d_good JOIN seed USING (case_id) WHERE abs({D('lon', 's')})<=18 GROUP BY 1)"""


@query("j05_neighbour_count", f"WITH {_NN} SELECT case_id, ord, n_near FROM nn")
def _(t):
    return H.neighbour_count(t.good_hits, CASE, "lon", 18.0).select("case_id", "ord", "n_near")


@query("a08_densest_centre", f"WITH {_NN} SELECT case_id, {R('centre', 'centre')} FROM ctr")
def _(t):
    df = H.densest_centre(t.good_hits, CASE, "lon", "ord", 18.0, "centre")
    return df.groupBy("case_id").agg(F.round(F.max("centre"), 6).alias("centre"))


@query(
    "a09_reject_outliers",
    f"""WITH {_NN}, d AS (SELECT g.*, centre, abs({D('lon', 'centre')}) AS d, count(*) OVER (PARTITION BY case_id) AS n FROM d_good g JOIN ctr USING (case_id)),
e AS (SELECT *, count(*) FILTER (WHERE d<=18) OVER (PARTITION BY case_id) AS ni, row_number() OVER (PARTITION BY case_id ORDER BY d, ord) AS rk FROM d),
k AS (SELECT *, n<3 OR d<=18 OR (ni=0 AND rk=1) AS kept FROM e)
SELECT case_id, ord, {R('centre', 'centre')}, kept, CASE WHEN NOT kept THEN 'lon_cluster_outlier' END AS reason FROM k""",
)
def _(t):
    df = H.reject_lon_outliers(t.good_hits, CASE, "lon", "ord")
    return out(df, ["case_id", "ord", "kept", "reason"], centre=c("centre"))


@query(
    "j07_pairwise_spread",
    f"""SELECT s.case_id, s.n, {R('coalesce(p.ml,0)', 'lon_spread')}, {R('coalesce(p.ma,0)', 'lat_spread')} FROM
(SELECT case_id, count(*) AS n FROM d_good GROUP BY 1) s LEFT JOIN
(SELECT a.case_id, max(abs({D('a.lon', 'b.lon')})) AS ml, max(abs(a.lat-b.lat)) AS ma FROM d_good a JOIN d_good b ON a.case_id=b.case_id AND a.ord<b.ord GROUP BY 1) p USING (case_id)""",
)
def _(t):
    df = H.max_spread(t.good_hits, CASE, "lon", "lat")
    return out(df, ["case_id", "n"], lon_spread=c("lon_spread"), lat_spread=c("lat_spread"))


@query(
    "a10_definition_scatter",
    f"""WITH p AS (SELECT case_id, method_id AS primary_id, lon AS pl, lat AS pa FROM {pref_sql('d_good')} WHERE pk=1),
d AS (SELECT case_id, primary_id, pl, pa, {D('lon', 'pl')} AS dl, lat-pa AS da, weight FROM d_good JOIN p USING (case_id)),
s AS (SELECT case_id, any_value(primary_id) AS primary_id, any_value(pl) AS lon, any_value(pa) AS lat,
 count(*) FILTER (WHERE abs(dl)<=8 AND abs(da)<=5) AS k, sqrt(sum(weight*dl*dl) FILTER (WHERE abs(dl)<=8 AND abs(da)<=5)/sum(weight) FILTER (WHERE abs(dl)<=8 AND abs(da)<=5)) AS sl,
 sqrt(sum(weight*da*da) FILTER (WHERE abs(dl)<=8 AND abs(da)<=5)/sum(weight) FILTER (WHERE abs(dl)<=8 AND abs(da)<=5)) AS sa FROM d GROUP BY 1)
SELECT case_id, primary_id, {R('lon', 'lon')}, {R('lat', 'lat')}, {R('least(CASE WHEN k>=2 THEN sl ELSE 0.15 END,3)', 'sys_lon')},
{R('least(CASE WHEN k>=2 THEN sa ELSE 0.15 END,2)', 'sys_lat')} FROM s""",
)
def _(t):
    df = H.definition_scatter(t.good_hits, CASE, PREF)
    return out(
        df, ["case_id", "primary_id"], lon=c("lon"), lat=c("lat"), sys_lon=c("sys_lon"), sys_lat=c("sys_lat")
    )


METHODS = [f"{family}_{k}" for family in FAMILIES for k in range(4)]
#: Every method has a role. Several hits of a role in a case count as one: their weighted mean.
ROLE_OF = {m: H.ROLES[i % len(H.ROLES)] for i, m in enumerate(METHODS)}
HALF = {m: "moment" if int(m[-1]) < 2 else "template" for m in METHODS}
MEANS = ["score", "length", "width"]


def with_role(df, mapping, name="role"):
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.try_element_at(m, c("method_id")))


def role_rows(t, mapping):
    """One row per case and role; rounded so that sums in another order give the same number."""
    r = H.by_role(with_role(t.good_hits, mapping), CASE, "role", "weight", MEANS)
    return r.withColumns({x: F.round(x, 9) for x in ("lon", "lat", *MEANS)})


def role_rows_sql(mapping):
    means = ", ".join(f"round(sum(weight*{x})/sum(weight),9) AS {x}" for x in ("lat", *MEANS))
    return f"(SELECT case_id, role, round({cmean('lon', 'weight')},9) AS lon, {means}, count(*) AS n_hits FROM (SELECT *, {role_sql(mapping)} AS role FROM d_good) GROUP BY 1,2)"


def role_sql(mapping):
    return "CASE method_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_CHAMP = f"""WITH b AS (SELECT *, score AS dark, abs({D('lon', '((case_id*7)%360)')}) AS rel FROM {role_rows_sql(ROLE_OF)}),
g AS (SELECT *, CASE role WHEN 'gs_map' THEN 0 WHEN 'gs_tmpl' THEN 1 WHEN 'engine' THEN 2 WHEN 'map_dark' THEN 3 WHEN 'template' THEN 4 ELSE 5 END AS rk,
 exp(-0.5*pow((lat+22.0)/4.5,2))*CASE WHEN rel>85 THEN 0.25 ELSE 1 END
 *CASE WHEN dark>0 THEN 1+least(1.5e0,dark) WHEN role IN ('gs_map','map_dark') THEN 0.85 ELSE 1 END
 *CASE WHEN role IN ('gs_map','gs_tmpl') THEN 1.4e0 ELSE 1 END*CASE WHEN role='engine' THEN 1.15e0 ELSE 1 END
 *CASE WHEN dark<0.05 AND role IN ('gs_map','map_dark','moment') THEN 0.35e0 ELSE 1 END AS w
 FROM b WHERE role IS NOT NULL AND lat BETWEEN -36 AND -10 AND abs(rel-90)>=3),
nn AS (SELECT a.case_id, a.rk, a.lon, count(*) AS k FROM g a JOIN g b ON a.case_id=b.case_id AND abs({D('a.lon', 'b.lon')})<=10 GROUP BY 1,2,3),
seed AS (SELECT case_id, lon AS s FROM nn QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY k DESC, rk)=1),
p AS (SELECT g.case_id, role AS prole, lon AS pl, lat AS pa FROM g JOIN seed USING (case_id) WHERE abs({D('lon', 's')})<=12
 QUALIFY row_number() OVER (PARTITION BY g.case_id ORDER BY rk)=1),
i AS (SELECT g.*, prole, pl, pa FROM g JOIN p USING (case_id) WHERE abs({D('lon', 'pl')})<=12),
m AS (SELECT case_id, count(*) AS ni, any_value(prole) AS prole, any_value(pl) AS pl, any_value(pa) AS pa, {cmean('lon', 'w')} AS ml, sum(w*lat)/sum(w) AS ma FROM i GROUP BY 1),
q AS (SELECT *, CASE WHEN ni>=2 THEN {W('pl+0.4e0*' + D('ml', 'pl'))} ELSE pl END AS ql, CASE WHEN ni>=2 THEN 0.6e0*pa+0.4e0*ma ELSE pa END AS qa FROM m),
loo AS (SELECT a.case_id, a.rk, {cmean('b.lon', 'b.w')} AS jl, sum(b.w*b.lat)/sum(b.w) AS ja FROM i a JOIN i b ON a.case_id=b.case_id AND a.rk<>b.rk GROUP BY 1,2),
s AS (SELECT q.case_id, CASE WHEN any_value(ni)>=3 THEN stddev_samp({D('jl', 'ql')})*sqrt(any_value(ni)/(any_value(ni)-1.0e0)) END AS sl3,
 CASE WHEN any_value(ni)>=3 THEN stddev_samp(ja-qa)*sqrt(any_value(ni)/(any_value(ni)-1.0e0)) END AS sa3 FROM q JOIN loo USING (case_id) GROUP BY 1),
s2 AS (SELECT case_id, stddev_samp({D('lon', 'ql')}) AS sl2, stddev_samp(lat-qa) AS sa2 FROM i JOIN q USING (case_id) GROUP BY 1),
pair AS (SELECT a.case_id, a.lon AS gl, a.lat AS ga, b.lon AS tl, b.lat AS ta FROM g a JOIN g b ON a.case_id=b.case_id AND a.role='gs_map' AND b.role='gs_tmpl'
 WHERE abs({D('a.lon', 'b.lon')})<=1.25 AND abs(a.lat-b.lat)<=1.5 AND (a.dark>=0.08 OR b.dark>=0.08)),
f AS (SELECT q.case_id, ni, gl IS NOT NULL AS dual_lock, gl, ga, tl, ta, ql, qa, prole, (SELECT count(*) FROM g WHERE g.case_id=q.case_id) AS n_good,
 CASE WHEN ni<2 THEN 0.7e0 WHEN ni>=3 THEN sl3 ELSE sl2 END AS sl, CASE WHEN ni<2 THEN 0.45e0 WHEN ni>=3 THEN sa3 ELSE sa2 END AS sa
 FROM q LEFT JOIN s USING (case_id) LEFT JOIN s2 USING (case_id) LEFT JOIN pair USING (case_id))
SELECT case_id, n_good, ni AS n_in, dual_lock, CASE WHEN dual_lock THEN 'gs_map' ELSE prole END AS role,
 {R(f"CASE WHEN dual_lock THEN {W('gl+0.5e0*' + D('tl', 'gl'))} ELSE ql END", 'lon')}, {R('CASE WHEN dual_lock THEN 0.5e0*(ga+ta) ELSE qa END', 'lat')},
 {R(f"CASE WHEN dual_lock THEN least(sl,greatest(0.08e0,abs({D('gl', 'tl')})/sqrt(2))) ELSE sl END", 'sigma_lon')},
 {R("CASE WHEN dual_lock THEN least(sa,greatest(0.06e0,abs(ga-ta)/sqrt(2))) ELSE sa END", 'sigma_lat')} FROM f"""


@query("a13_champion_centre", _CHAMP)
def _(t):
    df = H.champion_centre(role_rows(t, ROLE_OF), CASE, "role", "score", (c("case_id") * 7) % 360)
    keys = ["case_id", "n_good", "n_in", "dual_lock", "role"]
    return out(df, keys, **{k: c(k) for k in ("lon", "lat", "sigma_lon", "sigma_lat")})


@query(
    "a15_evidence",
    f"""WITH d AS (SELECT *, abs({D('lon', '(case_id%360)')}) AS dl, abs(lat+20) AS da, case_id%4<>0 AS mz, (case_id%10)/10.0e0 AS q FROM d_good),
m AS (SELECT case_id, median(dl) AS ml, median(da) AS ma FROM d GROUP BY 1),
g AS (SELECT case_id, count(*) AS n, 1.4826e0*median(abs(dl-ml)) AS xl, 1.4826e0*median(abs(da-ma)) AS xa, max(dl) AS hl, max(da) AS ha, median(score) AS sc,
 any_value(q) AS q, any_value(mz) AS mz FROM d JOIN m USING (case_id) GROUP BY 1),
h AS (SELECT *, sqrt(exp(-0.5*pow(xl/8,2))*exp(-0.5*pow(xa/3.5,2))) AS ag FROM g),
k AS (SELECT *, least(greatest(0.38e0*ag+0.27e0*least(1,n/3.0e0)+0.2e0*least(greatest(sc/3,0),1)+0.15e0*q,0),1) AS cf FROM h)
SELECT case_id, n, {R('xl', 'disp_lon')}, {R('xa', 'disp_lat')}, {R('ag', 'agreement')}, {R('cf', 'confidence')},
 cf<0.45 OR n<2 OR NOT mz OR ha>8 AS indeterminate,
 concat_ws(',', CASE WHEN n<2 THEN 'few_estimators' END, CASE WHEN hl>18 THEN 'lon_disagreement' END, CASE WHEN ha>8 THEN 'lat_disagreement' END, CASE WHEN NOT mz THEN 'disk_gate' END) AS reasons FROM k""",
)
def _(t):
    df = H.evidence(
        t.good_hits, CASE, c("case_id") % 360, -20.0, "score", (c("case_id") % 10) / 10.0, c("case_id") % 4 != 0
    )
    keys = ["case_id", "n", "indeterminate", "reasons"]
    return out(df, keys, **{k: c(k) for k in ("disp_lon", "disp_lat", "agreement", "confidence")})


_SIZES = f"""(SELECT case_id, max(CASE WHEN role='moment' THEN length*2.2e0-4 END) AS ml, max(CASE WHEN role='moment' THEN width*1.7e0 END) AS mw,
 max(CASE WHEN role='moment' THEN lat END) AS mlat, max(CASE WHEN role='template' THEN length*1.5e0 END) AS tl, max(CASE WHEN role='template' THEN width*1.4e0 END) AS tw FROM {role_rows_sql(HALF)} GROUP BY 1)"""


@query(
    "a16_size_choice",
    f"""SELECT case_id, {R('CASE src WHEN 2 THEN ml WHEN 1 THEN tl ELSE 12 END', 'length')}, {R('CASE src WHEN 2 THEN mw WHEN 1 THEN tw ELSE 8 END', 'width')},
 CASE src WHEN 2 THEN 'moment_map_extent' WHEN 1 THEN 'template_prior_size' ELSE 'literature_default_size' END AS size_source FROM
(SELECT *, CASE WHEN ml BETWEEN 4 AND 28 AND mw BETWEEN 2 AND 16 AND ml/mw<=8 AND mlat BETWEEN {LAT0 - 14} AND {LAT0 + 10} THEN 2
 WHEN tl BETWEEN 5 AND 22 AND tw BETWEEN 3 AND 14 THEN 1 ELSE 0 END AS src FROM {_SIZES})""",
)
def _(t):
    pick = lambda m, x: F.max(F.when(c("role") == m, x))
    wide = role_rows(t, HALF).groupBy("case_id").agg(
        pick("moment", c("length") * 2.2 - 4).alias("ml"), pick("moment", c("width") * 1.7).alias("mw"),
        pick("moment", c("lat")).alias("mlat"), pick("template", c("length") * 1.5).alias("tl"),
        pick("template", c("width") * 1.4).alias("tw"),
    )
    return out(H.size_choice(wide, CASE), ["case_id", "size_source"], length=c("length"), width=c("width"))


_LIMB = """(SELECT *, 100+(ord%9)*0.5e0 AS xc, 90+(ord%11)*0.3e0 AS yc, 60+(ord%7)*0.4e0 AS a_eq FROM d_good)"""


@query(
    "a17_stable_limb",
    f"""WITH l AS (SELECT * FROM {_LIMB}), v AS (SELECT * FROM l WHERE lat BETWEEN -36 AND -10),
nn AS (SELECT a.case_id, a.ord, a.lon, count(*) AS k FROM v a JOIN v b ON a.case_id=b.case_id AND abs({D('a.lon', 'b.lon')})<=8 GROUP BY 1,2,3),
seed AS (SELECT case_id, lon AS s FROM nn QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY k DESC, ord)=1),
am AS (SELECT case_id, median(a_eq) AS am FROM v GROUP BY 1),
w AS (SELECT v.*, greatest(exp(-0.5*pow({D('lon', 's')}/4,2))*exp(-0.5*pow((a_eq-am)/(0.03e0*am+1e-6),2)),1e-3) AS w FROM v JOIN seed USING (case_id) JOIN am USING (case_id)),
s AS (SELECT case_id, sum(w*xc)/sum(w) AS xc, sum(w*yc)/sum(w) AS yc, sum(w*a_eq)/sum(w) AS a_eq FROM w GROUP BY 1),
a AS (SELECT case_id, count(*) AS n_probes, count(*) FILTER (WHERE lat BETWEEN -36 AND -10) AS n_stable, max(xc)-min(xc) AS xs, max(yc)-min(yc) AS ys, max(a_eq)-min(a_eq) AS aas,
 median(xc) AS mx, median(yc) AS my, median(a_eq) AS ma FROM l GROUP BY 1)
SELECT case_id, n_probes, n_stable, {R('xs', 'xc_spread')}, {R('ys', 'yc_spread')}, {R('aas', 'a_eq_spread')}, {R('coalesce(xc,mx)', 'xc')}, {R('coalesce(yc,my)', 'yc')}, {R('coalesce(a_eq,ma)', 'a_eq')}
FROM a LEFT JOIN s USING (case_id)""",
)
def _(t):
    df = t.good_hits.withColumns({
        "xc": 100 + (c("ord") % 9) * 0.5, "yc": 90 + (c("ord") % 11) * 0.3, "a_eq": 60 + (c("ord") % 7) * 0.4,
    })
    df = H.stable_limb(df, CASE, "ord")
    names = ("xc_spread", "yc_spread", "a_eq_spread", "xc", "yc", "a_eq")
    return out(df, ["case_id", "n_probes", "n_stable"], **{k: c(k) for k in names})


IMG_ROLE = {m: ("template", "moment", "map_dark", "redness")[int(m[-1])] for m in METHODS}


def image_hits(t):
    df = role_rows(t, IMG_ROLE)
    return df.withColumns({"contrast": c("score") * 0.1, "length": c("length") * 1.6})


_T6, _T14 = f"BETWEEN {LAT0 - 6.0} AND {LAT0 + 6.0}", f"BETWEEN {LAT0 - 14.0} AND {LAT0 + 10.0}"
_IMG = f"""WITH h AS (SELECT case_id, role, lon, lat, score, score*0.1e0 AS contrast, length*1.6e0 AS length, width, n_hits FROM {role_rows_sql(IMG_ROLE)}),
s AS (SELECT *, CASE role WHEN 'template' THEN 2.6e0 WHEN 'moment' THEN 2.6e0 WHEN 'map_dark' THEN 2.5e0 ELSE 2.4e0 END AS w,
 CASE role WHEN 'template' THEN 0 WHEN 'moment' THEN 1 WHEN 'map_dark' THEN 2 ELSE 3 END AS rk FROM h WHERE role IS NOT NULL AND lat {_T14}),
cl AS (SELECT a.case_id, a.rk, count(*) AS k, {cmean('b.lon')} AS ml FROM s a JOIN s b ON a.case_id=b.case_id AND a.rk<3 AND b.rk<3 AND a.lat {_T6} AND b.lat {_T6}
 AND abs({D('a.lon', 'b.lon')})<=12 GROUP BY 1,2),
tight AS (SELECT case_id, ml FROM cl WHERE k>=2 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY k DESC, rk)=1),
p AS (SELECT case_id, count(*) AS n, max(lon) FILTER (WHERE rk=0) AS tl, max(lat) FILTER (WHERE rk=0) AS ta, max(lon) FILTER (WHERE rk=1) AS ml, max(lat) FILTER (WHERE rk=1) AS ma,
 max(lon) FILTER (WHERE rk=2) AS dl, max(lat) FILTER (WHERE rk=2) AS da, max(lon) FILTER (WHERE rk=3) AS rl, max(lat) FILTER (WHERE rk=3) AS ra, max(score) FILTER (WHERE rk=3) AS rs,
 max(contrast) FILTER (WHERE rk=0) AS tc,
 coalesce(max((contrast+0.01e0*score)*exp(-0.5*pow((lat-({LAT0}))/5,2))) FILTER (WHERE rk=0),0) AS tq,
 coalesce(max(CASE WHEN length BETWEEN 4 AND 22 AND width BETWEEN 2 AND 14 THEN 2.0e0 ELSE 0.15e0 END*exp(-0.5*pow((lat-({LAT0}))/5,2))) FILTER (WHERE rk=1),0) AS mq FROM s GROUP BY 1),
q AS (SELECT p.*, t.ml AS cl, t.ml IS NOT NULL AS dt, coalesce(abs({D('tl', 'p.ml')})>12,false) AS split,
 ra {_T6} AND coalesce(tl,p.ml,dl) IS NOT NULL AND coalesce(abs({D('rl', 'tl')})>12,true) AND coalesce(abs({D('rl', 'p.ml')})>12,true) AND coalesce(abs({D('rl', 'dl')})>12,true) AS alone
 FROM p LEFT JOIN tight t USING (case_id)),
e AS (SELECT *, CASE WHEN dt THEN cl WHEN rl IS NOT NULL AND (split OR alone) THEN rl WHEN tl IS NOT NULL AND tq>=0.05 THEN tl WHEN ml IS NOT NULL AND mq>=1 THEN ml
 ELSE coalesce(tl,ml,dl,rl) END AS seed FROM q),
k0 AS (SELECT s.case_id, s.rk, s.lon, s.lat, s.w, abs({D('s.lon', 'e.seed')})<=12 AS keep0 FROM s JOIN e USING (case_id)),
k1 AS (SELECT k0.*, e.*EXCLUDE(case_id), keep0 OR (n=2 AND NOT dt AND count(*) FILTER (WHERE keep0) OVER (PARTITION BY case_id)=1) AS keep1 FROM k0 JOIN e USING (case_id)),
k2 AS (SELECT *, coalesce(abs({D('tl', 'ml')})>10,false) AND tq>=0.05 AND mq<1 AND n>2 AS dropm,
 coalesce(abs({D('tl', 'ml')})>10,false) AND NOT (tq>=0.05 AND mq<1 AND n>2) AND mq>=1 AND tq<0.03 AND NOT dt AS dropt,
 coalesce(abs({D('tl', 'dl')})>10,false) AND tq>=0.05 AS dropd FROM k1),
k3 AS (SELECT *, CASE rk WHEN 0 THEN (keep1 OR dropm) AND NOT dropt WHEN 1 THEN (keep1 OR dropt) AND NOT dropm WHEN 2 THEN keep1 AND NOT dropd ELSE keep1 END AS keep2 FROM k2),
k4 AS (SELECT *, keep2 OR NOT bool_or(keep2) OVER (PARTITION BY case_id) AS kept, w*CASE WHEN rk=0 AND tq>=0.05 THEN 2.5e0 ELSE 1 END AS w2 FROM k3),
u AS (SELECT case_id, count(*) AS nk, {cmean('lon', 'w2')} AS lon0, sum(w2*lat)/sum(w2) AS lat0, bool_or(rk=0) AS ut, bool_or(rk=1) AS um, bool_or(rk=3) AS ur,
 count(*) FILTER (WHERE rk>0) AS no, coalesce(max(abs({D('tl', 'lon')})) FILTER (WHERE rk>0),0) AS worst,
 {W('degrees(atan2(sum(sin(radians(lon))) FILTER (WHERE rk>0),sum(cos(radians(lon))) FILTER (WHERE rk>0)))')} AS om,
 {W('degrees(atan2(sum(w*sin(radians(lon))) FILTER (WHERE rk>0),sum(w*cos(radians(lon))) FILTER (WHERE rk>0)))')} AS owl,
 sum(w*lat) FILTER (WHERE rk>0)/sum(w) FILTER (WHERE rk>0) AS owa FROM k4 WHERE kept GROUP BY 1),
v AS (SELECT *, CASE WHEN rl IS NOT NULL AND split AND NOT dt AND ur THEN 'redness_dark_split' WHEN ut AND tc>=0.04 AND (no=0 OR worst<=8) THEN 'template_pos'
 WHEN ut AND NOT (no=0 OR worst<=8) THEN 'peer_cluster' WHEN ut AND no>0 AND abs({D('tl', 'om')})<=6 THEN 'template_agrees' ELSE 'consensus' END AS path FROM e JOIN u USING (case_id)),
x AS (SELECT *, CASE path WHEN 'redness_dark_split' THEN rl WHEN 'template_pos' THEN {W('degrees(atan2(0.5e0*sin(radians(tl))+CASE WHEN um THEN 0.5e0*sin(radians(ml)) ELSE 0 END+CASE WHEN ur THEN 3.5e0*sin(radians(rl)) ELSE 0 END, 0.5e0*cos(radians(tl))+CASE WHEN um THEN 0.5e0*cos(radians(ml)) ELSE 0 END+CASE WHEN ur THEN 3.5e0*cos(radians(rl)) ELSE 0 END))')}
 WHEN 'peer_cluster' THEN owl WHEN 'template_agrees' THEN tl ELSE lon0 END AS lon2,
 CASE path WHEN 'redness_dark_split' THEN ra WHEN 'template_pos' THEN CASE WHEN um AND abs(ma-ta)<=3 THEN (0.25e0*ta+0.75e0*ma+CASE WHEN ur THEN 0.5e0*ra ELSE 0 END)/(1+CASE WHEN ur THEN 0.5e0 ELSE 0 END) ELSE 0.8e0*ta+0.2e0*lat0 END
 WHEN 'peer_cluster' THEN owa WHEN 'template_agrees' THEN 0.75e0*ta+0.25e0*lat0 ELSE lat0 END AS lat2,
 coalesce(ur AND rs>0 AND ra {_T6},false) AND NOT (dt AND coalesce(least(abs({D('rl', 'tl')}),abs({D('rl', 'ml')}),abs({D('rl', 'dl')}))>12,false)) AS red FROM v),
z AS (SELECT x.*, CASE WHEN red THEN rl ELSE lon2 END AS lon, CASE WHEN red THEN ra ELSE lat2 END AS lat FROM x),
er AS (SELECT z.case_id, sqrt(sum(w2*pow({D('k4.lon', 'z.lon')},2))/sum(w2)) AS el, sqrt(sum(w2*pow(k4.lat-z.lat,2))/sum(w2)) AS ea FROM z JOIN k4 USING (case_id) WHERE kept GROUP BY 1),
fin AS (SELECT z.*, CASE WHEN nk>=2 THEN el ELSE 0.5e0 END AS rms_lon, CASE WHEN nk>=2 THEN ea ELSE 0.3e0 END AS rms_lat FROM z JOIN er USING (case_id))
"""


@query(
    "a14_image_consensus",
    _IMG + f"""SELECT case_id, n_hits, coalesce(n,0)::INTEGER AS n_methods, coalesce(nk,0)::INTEGER AS n_kept, dt AS dark_tight, {R('seed', 'seed_lon')}, path, {R('lon2', 'lon')}, {R('lat2', 'lat')}
 FROM (SELECT case_id, sum(n_hits)::BIGINT AS n_hits FROM h GROUP BY 1) LEFT JOIN fin USING (case_id)""",
)
def _(t):
    """Every case with hits has a row; one without a sane role has no position."""
    rows = image_hits(t)
    df = rows.groupBy("case_id").agg(F.sum("n_hits").alias("n_hits")).join(H.image_consensus(rows, CASE, "role"), "case_id", "left")
    none = lambda x: F.coalesce(c(x), F.lit(0)).cast("int").alias(x)
    keys = ["case_id", "n_hits", none("n_methods"), none("n_kept"), "dark_tight", F.round("seed_lon", 6).alias("seed_lon"), "path"]
    return out(df, keys, lon=c("consensus_lon"), lat=c("consensus_lat"))


_PX = "degrees(0.35e0/(40.0e0+1e-12))"


@query(
    "a46_colour_primary_and_error",
    _IMG + f"""SELECT case_id, red AS colour_primary, {R('lon', 'lon')}, {R('lat', 'lat')}, {R(f'greatest(rms_lon,{_PX})', 'err_lon')}, {R(f'greatest(rms_lat,{_PX})', 'err_lat')},
 {R(sky_sql(f'greatest(rms_lon,{_PX})', f'greatest(rms_lat,{_PX})', 'lat', '5.2e0').replace('rms_lat', 'RL').replace('RL', 'rms_lat'), 'sky_arcsec')} FROM fin""",
)
def _(t):
    df = H.method_error(H.image_consensus(image_hits(t), CASE, "role"), 40.0, 5.2)
    return out(df, ["case_id", "colour_primary"], **{k: c(k) for k in ("lon", "lat", "err_lon", "err_lat", "sky_arcsec")})


@query(
    "t05_top_per_family",
    """WITH r AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id, family ORDER BY weight DESC, ord) AS k FROM d_good),
s AS (SELECT *, count(*) FILTER (WHERE k<=2) OVER (PARTITION BY case_id) AS lf FROM r)
SELECT case_id, method_id, ord FROM s WHERE n<=8 OR lf<6 OR k<=2""",
)
def _(t):
    return H.top_per_family(t.good_hits, CASE, "weight", "ord").select("case_id", "method_id", "ord")


@query(
    "t06_preferred_method",
    f"SELECT case_id, method_id AS primary_id, {R('lon', 'lon')}, {R('lat', 'lat')} FROM {pref_sql('d_good')} WHERE pk=1",
)
def _(t):
    pick = H.preferred(CASE, "method_id", PREF, "weight", "ord", F.struct("method_id", "lon", "lat"))
    df = t.good_hits.groupBy("case_id").agg(pick.alias("p"))
    return df.select(
        "case_id", c("p.method_id").alias("primary_id"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat")
    )


@query(
    "t09_best_candidate",
    "SELECT case_id, method_id, score FROM d_good QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, ord)=1",
)
def _(t):
    best = F.max_by(F.struct("method_id", "score"), F.struct(c("score"), -c("ord")))
    return t.good_hits.groupBy("case_id").agg(best.alias("b")).select("case_id", "b.method_id", "b.score")


@query(
    "t10_recommended_probe",
    f"""SELECT case_id, method_id, {R('d', 'dlon')} FROM (SELECT *, abs({D('lon', '(case_id%360)')}) AS d FROM d_good)
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY d, ord)=1""",
)
def _(t):
    d = F.abs(A.wrap_diff("lon", c("case_id") % 360))
    best = F.min_by(F.struct("method_id", d.alias("dlon")), F.struct(d, c("ord")))
    return t.good_hits.groupBy("case_id").agg(best.alias("b")).select(
        "case_id", "b.method_id", F.round("b.dlon", 6).alias("dlon")
    )


@query(
    "u01_suite_union",
    _ENS + f"""SELECT case_id, method_id, family, {R('lon', 'lon')}, {R('lat', 'lat')} FROM d_good UNION ALL
SELECT case_id, 'ENS_WMEAN', 'ensemble', round({cmean('lon', 'weight')},6), round(sum(weight*lat)/sum(weight),6) FROM r GROUP BY 1
UNION ALL SELECT case_id, 'ENS_MEDIAN', 'ensemble', round(ml,6), round(ma,6) FROM md
UNION ALL SELECT case_id, 'ENS_TRIM', 'ensemble', round({cmean('lon')},6), round(avg(lat),6) FROM r WHERE rk<=greatest(2,floor(n*0.8e0)) GROUP BY 1
UNION ALL SELECT case_id, 'ENS_MEDOID', 'ensemble', round(lon,6), round(lat,6) FROM r WHERE mk=1""",
)
def _(t):
    ens = H.ensembles(t.good_hits, CASE, "lon", "lat", "weight", "ord").withColumn("family", F.lit("ensemble"))
    both = t.good_hits.unionByName(ens, allowMissingColumns=True)
    return out(both, ["case_id", "method_id", "family"], lon=c("lon"), lat=c("lat"))


@query(
    "p01_latitude_bands",
    f"""SELECT case_id, ord, CASE WHEN NOT ok THEN 'already_rejected' WHEN NOT lat BETWEEN {LAT0 - 16} AND {LAT0 + 10} THEN 'lat_out_of_band' END AS reject_reason,
 lat BETWEEN {LAT0 - 8} AND {LAT0 + 4} AS core FROM d_hits""",
)
def _(t):
    reason = F.when(~c("ok"), F.lit("already_rejected")).when(~PR.in_wide_band("lat"), F.lit("lat_out_of_band"))
    return t.hits.select("case_id", "ord", reason.alias("reject_reason"), PR.in_core_band("lat").alias("core"))


@query(
    "p02_method_sanity",
    f"""SELECT case_id, ord FROM d_good WHERE lat {_T14} AND abs({D('lon', '(case_id%360)')})<=18
 AND (method_id<>'click_0' OR (length*2 BETWEEN 1.5 AND 30 AND width*1.5e0 BETWEEN 1 AND 20 AND length*2/(width*1.5e0)<=2))""",
)
def _(t):
    length, width = c("length") * 2.0, c("width") * 1.5
    size = length.between(1.5, 30) & width.between(1, 20) & (length / width <= 2)
    ok = c("lat").between(LAT0 - 14, LAT0 + 10) & (F.abs(A.wrap_diff("lon", c("case_id") % 360)) <= 18)
    return t.good_hits.where(ok & ((c("method_id") != "click_0") | size)).select("case_id", "ord")
