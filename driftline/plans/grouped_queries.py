"""Recursive estimators and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import priors as PR
from driftline.operators import consensus as CO
from driftline.operators import images as IM
from driftline.operators import series as S
from driftline.operators import skew
from driftline.operators import smoothing as SM
from driftline.operators import soup as SO

from .consensus import CASE, cmean
from .pixel_queries import FRAME, K2, _TW, ctr, images, mask_cte
from .registry import D, R, W, query
from .scalars import c, demo_priors, out, prior_sql
from .series_queries import unwrap_sql

SPAN = 7 * 86_400_000_000


def soup_hits(t):
    k = c("case_id")
    w = PR.with_prior_weight(t.good_hits, *demo_priors(t))
    return w.withColumns({
        "cm": ((k * 7) % 360).cast("double"), "pipe_lon": F.when(k % 3 != 0, A.wrap_deg(k % 360 + k % 21 - 10)),
        "pipe_lat": F.when(k % 5 != 0, F.lit(-20.5)),
    })


@query("a11_robust_consensus")
def _(t):
    r = CO.robust_consensus(soup_hits(t), CASE, ["click_0", "view_0", "purchase_0"])
    names = ("lon", "lat", "sigma_lon", "sigma_lat", "score", "n_eff")
    return out(r, ["case_id", "n_in", "n_out", "n_clusters", "inliers", "outliers", "cut"], **{n: c(n) for n in names})


_SO = f"""h AS (SELECT *, {prior_sql()} AS pw, floor(lon/30)::INTEGER AS cluster, (case_id*7)%360 AS cm, CASE WHEN case_id%3<>0 THEN {W('case_id%360+case_id%21-10')} END AS pl FROM d_good),
m AS (SELECT case_id, cluster, {cmean('lon')} AS cm0 FROM h GROUP BY ALL), g AS (SELECT case_id, cluster, count(*) AS n, {W('any_value(cm0)+median(' + D('lon', 'cm0') + ')')} AS lon, median(lat) AS lat, sum(pw) AS w,
 count(*) FILTER (WHERE method_id IN ('click_0','view_0','purchase_0')) AS s, any_value(cm) AS cm, any_value(pl) AS pl FROM h JOIN m USING (case_id, cluster) GROUP BY ALL), d AS (SELECT *, abs({D('lon', 'pl')}) AS d, abs({D('lon', 'cm')}) AS dc FROM g)"""


@query(
    "a12_cluster_scores",
    f"""WITH {_SO} SELECT case_id, cluster, n, {R('lon', 'lon')}, {R('lat', 'lat')}, {R('2*n+w-2.5*abs(lat+22)+4*s-CASE WHEN abs(dc-90)<2.5 AND NOT coalesce(d<18,false) THEN 60 ELSE 0 END+CASE WHEN d<12 THEN 35-1.5*d WHEN d<25 THEN 12-0.6*(d-12) WHEN d IS NOT NULL THEN -(40+0.5*least(d,90)) ELSE 0 END-CASE WHEN dc<8 AND d>25 THEN 100 WHEN dc<8 THEN 4 ELSE 0 END', 'score')} FROM d""",
)
def _(t):
    h = soup_hits(t).withColumn("cluster", F.floor(c("lon") / 30).cast("int"))
    r = SO.cluster_scores(h, CASE, "cluster", ["click_0", "view_0", "purchase_0"])
    return out(r, ["case_id", "cluster", "n"], lon=c("lon"), lat=c("lat"), score=c("score"))


def smoother_sql(name, src, z, r, kind, q_pos=1e-6, q_vel=1e-7):
    """Tables <name>_f and <name>_b: the plain recursion forward, and back from its end."""
    if kind == "sigma":
        h, q = "greatest(({0})/86400e6,1e-9)", (f"{q_pos}*pow(greatest({{r}},0.05),2)*h*h*h/3", f"{q_pos}*pow(greatest({{r}},0.05),2)*h*h/2", f"{q_pos}*pow(greatest({{r}},0.05),2)*h")
        noise, first, jitter = "pow(greatest(r,1e-6),2)", "(r*r+0.1)", "0.0"
    else:
        h, q = "CASE WHEN ({0})>0 THEN ({0})/86400e6 ELSE 1e-6 END", (f"{q_pos}*h", "0.0", f"{q_vel}*h")
        noise, first, jitter = "r", "r", "1e-12"
    q00, q01, q11 = (x.format(r="r") for x in q)
    k00, k01, k11 = (x.format(r="nr") for x in q)
    return f"""{name}_p AS (SELECT series_id, t_us, ord, {z}::DOUBLE AS z, ({r})::DOUBLE AS r, row_number() OVER w AS i, {h.format('t_us-lag(t_us) OVER w')} AS h, {h.format('lead(t_us) OVER w-t_us')} AS nh,
 lead({r}) OVER w AS nr, count(*) OVER (PARTITION BY series_id) AS n FROM ({src}) WINDOW w AS (PARTITION BY series_id ORDER BY t_us, ord)),
{name}_f AS (SELECT series_id, i, z::DOUBLE AS x, 0.0::DOUBLE AS v, ((1-{first}/({first}+{noise}))*{first})::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM {name}_p WHERE i=1
 UNION ALL SELECT series_id, i, x+a/s*(z-x), v+b/s*(z-x), (1-a/s)*a, (1-a/s)*b, d-b/s*b FROM (SELECT *, a+{noise} AS s FROM
 (SELECT p.series_id, p.i, p.z, p.r, x+h*v AS x, v, a+2*h*b+h*h*d+{q00} AS a, b+h*d+{q01} AS b, d+{q11} AS d FROM {name}_f f JOIN {name}_p p ON p.series_id=f.series_id AND p.i=f.i+1))),
{name}_g AS (SELECT *, b00*h00+b01*h01 AS w00, b00*h01+b01*h11 AS w01, b10*h00+b11*h01 AS w10, b10*h01+b11*h11 AS w11 FROM (SELECT *, ((a+h*b)*e11-b*e01)/det AS b00, (b*e00-(a+h*b)*e01)/det AS b01, ((b+h*d)*e11-d*e01)/det AS b10, (d*e00-(b+h*d)*e01)/det AS b11
 FROM (SELECT *, h00+{jitter} AS e00, h01 AS e01, h11+{jitter} AS e11, (h00+{jitter})*(h11+{jitter})-h01*h01 AS det FROM (SELECT *, a+2*h*b+h*h*d+{k00} AS h00, b+h*d+{k01} AS h01, d+{k11} AS h11
 FROM (SELECT f.*, p.n, p.nh AS h, p.nr FROM {name}_f f JOIN {name}_p p USING (series_id, i)))))),
{name}_b AS (SELECT series_id, i, x, v, a, b, d FROM {name}_g WHERE i=n
 UNION ALL SELECT g.series_id, g.i, g.x+b00*(s.x-g.x-h*g.v)+b01*(s.v-g.v), g.v+b10*(s.x-g.x-h*g.v)+b11*(s.v-g.v),
 g.a+b00*b00*(s.a-h00)+2*b00*b01*(s.b-h01)+b01*b01*(s.d-h11), g.b+b00*b10*(s.a-h00)+(b00*b11+b01*b10)*(s.b-h01)+b01*b11*(s.d-h11), g.d+b10*b10*(s.a-h00)+2*b10*b11*(s.b-h01)+b11*b11*(s.d-h11)
 FROM {name}_b s JOIN {name}_g g ON g.series_id=s.series_id AND g.i=s.i-1)"""


_UNWRAPPED = unwrap_sql("d_steady")
_VAR = f"SELECT *, greatest(sigma*sigma,1e-6) AS var FROM ({_UNWRAPPED})"


@query(
    "m05_smoother_sigmas",
    f"WITH RECURSIVE {smoother_sql('k', _UNWRAPPED, 'lon_u', 'sigma', 'sigma')} SELECT series_id, ord, {R(W('x'), 'smoothed', 4)} FROM k_b JOIN k_p USING (series_id, i)",
)
def _(t):
    u = skew.cut(S.unwrap(t.steady, ["series_id"], "lon").select("series_id", "t_us", "ord", "lon_u", "sigma"))
    s = SM.smooth(u, "series_id", "t_us", "ord", "lon_u", "sigma", SM.Model("sigma"), SPAN)
    return out(s, ["series_id", "ord"], 4, smoothed=A.wrap_deg("smoothed"))


@query(
    "m06_smoother_variances",
    f"""WITH RECURSIVE {smoother_sql('k', _VAR, 'lon_u', 'var', 'variance', 1e-4, 1e-5)}, {smoother_sql('l', _VAR, 'lat', 'var', 'variance', 0.5e-4, 0.5e-5)}
SELECT series_id, ord, {R(W('k_b.x'), 'lon', 4)}, {R('sqrt(greatest(k_b.a,0))', 'sigma_lon', 4)}, {R('l_b.x', 'lat', 4)}, {R('sqrt(greatest(l_b.a,0))', 'sigma_lat', 4)} FROM k_b JOIN l_b USING (series_id, i) JOIN k_p USING (series_id, i)""",
)
def _(t):
    u = S.unwrap(t.steady, ["series_id"], "lon").withColumn("var", F.greatest(c("sigma") * c("sigma"), F.lit(1e-6)))
    q = 1e-4
    keep = skew.cut(u.select("series_id", "t_us", "ord", "lon_u", "lat", "var"))
    lon = SM.smooth(keep, "series_id", "t_us", "ord", "lon_u", "var", SM.Model("variance", q, q * 0.1), SPAN)
    lat = SM.smooth(keep, "series_id", "t_us", "ord", "lat", "var", SM.Model("variance", q * 0.5, q * 0.05), SPAN)
    lat = lat.select("series_id", "ord", c("smoothed").alias("lat"), F.sqrt(F.greatest("variance", F.lit(0.0))).alias("sigma_lat"))
    r = lon.join(lat, ["series_id", "ord"])
    return out(r, ["series_id", "ord"], 4, lon=A.wrap_deg("smoothed"), sigma_lon=F.sqrt(F.greatest("variance", F.lit(0.0))), lat=c("lat"), sigma_lat=c("sigma_lat"))


@query(
    "d01_method_registry",
    f"""WITH {mask_cte([8, 12])}, g AS (SELECT {K2}, 'PERC'||printf('%02d',perc::INTEGER) AS method_id, {ctr(_TW)} FROM mk GROUP BY ALL) SELECT {K2}, method_id, {R('cx', 'cx')}, {R('cy', 'cy')}, true AS ok, NULL::VARCHAR AS note FROM g
UNION ALL SELECT {K2}, 'NONE', NULL, NULL, false, 'no position' FROM d_frames""",
)
def _(t):
    methods = {f"PERC{p:02d}": (lambda f, p=p: IM.dark_barycentre(f, 8, [p], FRAME)) for p in (8, 12)}
    methods["NONE"] = lambda f: f.select(*FRAME, F.lit(None).cast("double").alias("cx"), F.lit(float("nan")).alias("cy"))
    r = SO.run_methods(methods, images(t), FRAME)
    num = lambda x: F.round(A.finite(c(x)), 6).alias(x)
    return r.select(*FRAME, "method_id", num("cx"), num("cy"), "ok", "note")


QUALITY = {
    "sum_squares": lambda f: f.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("q")),
    "peak": lambda f: f.select(*FRAME, F.array_max("data").alias("q")),
}


@query(
    "d02_quality_functions",
    f"SELECT {K2}, 'sum_squares' AS metric, round(list_sum([x*x FOR x IN data]),6) AS q FROM d_frames UNION ALL SELECT {K2}, 'peak', round(list_max(data),6) FROM d_frames",
)
def _(t):
    r = None
    for name, f in QUALITY.items():
        part = f(t.frames).withColumn("metric", F.lit(name))
        r = part if r is None else r.unionByName(part)
    return out(r, [*FRAME, "metric"], q=c("q"))


@query(
    "d05_time_grid",
    "SELECT c_custkey, (1704067200000000+i*21600000000)::BIGINT AS t_us FROM customer, (SELECT unnest(range(8)) AS i)",
)
def _(t):
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lit(1704067200000000) + i * 21_600_000_000))
    return t.customer.select("c_custkey", grid.alias("t_us"))
