"""Pixel and image queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from driftline.functions import navigation as N
from driftline.functions import optics as O
from driftline.functions.angles import FLATTENING
from driftline.operators import images as IM
from driftline.operators import pixels as PX
from driftline.operators import series as S
from driftline.operators import skew

from .campaigns import rounded
from .registry import R, W, query
from .scalars import RGB_SQL, c, out, mosaic_planes, p2l_sql, rgb_pixels
from .tables import CTES

FRAME = ["capture_id", "frame_idx"]
CTES["d_img"] = "SELECT capture_id, frame_idx, [v+0.5e0 FOR v IN data] AS data FROM d_frames"
CTES["d_ipx"] = """SELECT capture_id, frame_idx, (pos//8)::INTEGER AS y, (pos%8)::INTEGER AS x, v FROM (
 SELECT capture_id, frame_idx, unnest(range(64)) AS pos, unnest(data) AS v FROM d_img) WHERE v>0"""
CTES["d_score"] = "SELECT capture_id, frame_idx, list_sum(data) AS score FROM d_frames"


def images(t):
    return t.frames.select(*FRAME, F.transform("data", lambda v: v + 0.5).alias("data"))


def scores(t):
    return t.frames.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("score"), c("frame_idx").alias("_tie"))


def scored_pixels(t):
    """Pixels with their frame's weight; both columns come from the same row, so no join is needed."""
    f = IM.settle(t.frames.select(*FRAME, "data", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("score")))
    return f.select(*FRAME, "score", F.posexplode("data").alias("pos", "v")).select(
        *FRAME, "score", F.floor(c("pos") / 8).cast("int").alias("y"), (c("pos") % 8).alias("x"), "v")


P = "capture_id, y, x"


@query("x01_stack_mean_median", f"SELECT {P}, {R('avg(v)', 'mean')}, {R('median(v)', 'median')} FROM d_pixels GROUP BY ALL")
def _(t):
    m = PX.stack_mean(t.pixels).withColumnRenamed("value", "mean").join(
        PX.stack_median(t.pixels).withColumnRenamed("value", "median"), PX.PIX)
    return rounded(m, PX.PIX)


_KS = f"s0 AS (SELECT {P}, median(v) AS a, stddev_pop(v)+1e-12 AS sd FROM d_pixels GROUP BY ALL)"
for _i in range(3):
    _KS += f""", s{_i + 1} AS (SELECT {P}, sum(CASE WHEN abs(v-a)<=2.5*sd THEN v ELSE 0 END)/(count(*) FILTER (WHERE abs(v-a)<=2.5*sd)+1e-12) AS a, any_value(sd) AS sd FROM d_pixels JOIN s{_i} USING ({P}) GROUP BY ALL)"""


@query("x02_kappa_sigma", f"WITH {_KS} SELECT {P}, {R('a', 'value')} FROM s3")
def _(t):
    return rounded(PX.stack_kappa_sigma(t.pixels), PX.PIX)


@query(
    "x03_quality_weighted",
    f"SELECT {P}, {R('sum(greatest(score,0)*v)/sum(greatest(score,0))', 'value')} FROM d_pixels JOIN d_score USING (capture_id, frame_idx) GROUP BY ALL",
)
def _(t):
    return rounded(PX.stack_weighted(scored_pixels(t), "score"), PX.PIX)


@query(
    "x04_trimmed_mean",
    f"""WITH k AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY {P}) AS n FROM d_pixels WINDOW w AS (PARTITION BY {P} ORDER BY v, frame_idx))
SELECT {P}, {R('CASE WHEN any_value(floor(0.1*n))<=0 THEN avg(v) ELSE avg(v) FILTER (WHERE r>floor(0.1*n) AND r<=n-floor(0.1*n)) END', 'value')} FROM k GROUP BY ALL""",
)
def _(t):
    return rounded(PX.stack_trimmed(t.pixels), PX.PIX)


_RB = f"""p AS (SELECT *, 1+abs(score) AS w FROM d_pixels JOIN d_score USING (capture_id, frame_idx)), m AS (SELECT {P}, median(v) AS a FROM p GROUP BY ALL),
r0 AS (SELECT {P}, any_value(a) AS a, greatest(1.4826e0*median(abs(v-a)),1e-6) AS sd FROM p JOIN m USING ({P}) GROUP BY ALL)"""
for _i in range(2):
    _RB += f""", r{_i + 1} AS (SELECT {P}, sum(w*v) FILTER (WHERE abs(v-a)<=3*sd)/sum(w) FILTER (WHERE abs(v-a)<=3*sd) AS a, any_value(sd) AS sd FROM p JOIN r{_i} USING ({P}) GROUP BY ALL)"""


@query("x05_robust_combine", f"WITH {_RB} SELECT {P}, {R('a', 'value')} FROM r2")
def _(t):
    px = scored_pixels(t).withColumn("w", 1.0 + F.abs("score"))
    return rounded(PX.stack_robust(px, "w"), PX.PIX)


@query(
    "x06_lucky_stack",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, frame_idx) AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM d_score), s AS (SELECT capture_id, frame_idx, score FROM k WHERE r<=greatest(1,round_even(0.5e0*n,0)))
SELECT {P}, {R('sum(greatest(score,0)*v)/sum(greatest(score,0))', 'value')}, {R('stddev_pop(v)', 'noise')}, count(*) AS n_used, {R('min(score)', 'threshold')} FROM d_pixels JOIN s USING (capture_id, frame_idx) GROUP BY ALL""",
)
def _(t):
    stack, head = PX.lucky_stack(t.pixels, scores(t), 0.5, "quality_weighted")
    return rounded(stack.join(head, "capture_id"), [*PX.PIX, "n_used"])


_FW = "greatest(abs(score),1e-3)*(0.25+0.75*CASE WHEN score*5<=0 THEN 0 ELSE least(ln(1+score*5)/ln(21.0e0),1) END)"


@query(
    "x07_accumulators",
    f"""WITH p AS (SELECT *, {_FW} AS q FROM d_pixels JOIN d_score USING (capture_id, frame_idx)), g AS (SELECT {P}, sum(q*v)/sum(q) AS value, greatest(avg(v*v)-avg(v)*avg(v),0) AS var FROM p GROUP BY ALL)
SELECT {P}, {R('value', 'value')}, {R('sqrt(avg(var) OVER (PARTITION BY capture_id))', 'consistency')} FROM g""",
)
def _(t):
    px = scored_pixels(t).withColumn("q", PX.frame_weight(F.abs("score"), c("score") * 5.0))
    value, cons = PX.weighted_accumulators(px, "q")
    return rounded(value.join(cons, "capture_id"), PX.PIX)


@query(
    "x08_turbulence_weighted",
    f"""WITH d AS (SELECT *, abs(score) AS dr, lag(abs(score)) OVER (PARTITION BY capture_id ORDER BY frame_idx) AS pd FROM d_score), f AS (SELECT capture_id, median(abs(dr-pd)) AS d, stddev_pop(dr) AS rms FROM d GROUP BY 1),
r AS (SELECT capture_id, greatest(0.5,d*pow(0.43e0/(rms*rms),0.6e0)) AS r0 FROM f), w AS (SELECT capture_id, frame_idx, CASE WHEN dr>0 THEN 1/(1+dr) ELSE 1 END*exp(-0.8*6.88*pow(dr/greatest(r0,1e-6),5.0e0/3)) AS w FROM d JOIN r USING (capture_id))
SELECT {P}, {R('sum(w*v)/sum(w)', 'value')} FROM d_pixels JOIN w USING (capture_id, frame_idx) GROUP BY ALL""",
)
def _(t):
    w = PX.turbulence_weights(scores(t).withColumn("drift", F.abs("score")).drop("_tie"), "drift", 0.8)
    px = t.pixels.join(w.select(*FRAME, "weight"), FRAME)
    return rounded(PX.stack_weighted(px, "weight"), PX.PIX)


K2 = "capture_id, frame_idx"


@query(
    "x09_laplacian_variance",
    f"""WITH t AS (SELECT {K2}, quantile_cont(v,0.7e0) AS thr FROM (SELECT {K2}, unnest(data) AS v FROM d_img) GROUP BY ALL),
l AS (SELECT i.{K2.replace(', ', ', i.')}, data, thr, unnest([10,11,12,13,14,15,18,19,20,21,22,23,26,27,28,29,30,31,34,35,36,37,38,39,42,43,44,45,46,47,50,51,52,53,54,55]) AS k FROM d_img i JOIN t USING ({K2})),
m AS (SELECT {K2}, data[k+8]+data[k-8]+data[k+1]+data[k-1]-4*data[k] AS lap FROM l WHERE data[k]>=thr)
SELECT {K2}, count(lap)::INTEGER AS n, {R('CASE WHEN count(lap)>=6 THEN var_pop(lap) ELSE 0 END', 'sharp')} FROM d_img LEFT JOIN m USING ({K2}) GROUP BY ALL""",
)
def _(t):
    return out(IM.laplacian_variance(images(t), 8, 8, FRAME, least=6), [*FRAME, "n"], sharp=c("sharp"))


@query(
    "x10_frame_metrics",
    f"""WITH p AS (SELECT {K2}, unnest(range(64)) AS i, unnest(data) AS v FROM d_img), t AS (SELECT {K2}, quantile_cont(v,0.7e0) AS thr, stddev_pop(v)/(avg(v)+1e-9) AS contrast FROM p GROUP BY ALL),
b AS (SELECT {K2}, var_pop(v) AS variance, max(v) AS peak FROM p JOIN t USING ({K2}) WHERE v>=thr GROUP BY ALL),
g AS (SELECT a.capture_id, a.frame_idx, avg(abs(b.v-a.v)) FILTER (WHERE b.i=a.i+1 AND a.i%8<7)+avg(abs(b.v-a.v)) FILTER (WHERE b.i=a.i+8) AS gradient FROM p a JOIN p b ON a.capture_id=b.capture_id AND a.frame_idx=b.frame_idx AND b.i IN (a.i+1,a.i+8) GROUP BY ALL)
SELECT {K2}, {R('variance', 'variance')}, {R('peak', 'peak')}, {R('gradient', 'gradient')}, {R('contrast', 'contrast')} FROM t JOIN b USING ({K2}) JOIN g USING ({K2})""",
)
def _(t):
    return rounded(IM.frame_metrics(images(t), 8, FRAME), FRAME)


_DM = f"""dm AS (SELECT {K2}, median(v) FILTER (WHERE v>=p60) AS m FROM (SELECT {K2}, v, quantile_cont(v,0.6e0) OVER (PARTITION BY {K2}) AS p60 FROM (SELECT {K2}, unnest(data) AS v FROM d_img)) GROUP BY ALL)"""


@query(
    "x11_brightness_match",
    f"""WITH {_DM}, r AS (SELECT capture_id, first(m ORDER BY score DESC, frame_idx) AS rm FROM dm JOIN d_score USING ({K2}) GROUP BY 1)
SELECT {K2}, {R('rm/m', 'gain')}, {R('rm/m*list_sum(data)/64', 'mean')} FROM dm JOIN r USING (capture_id) JOIN d_img USING ({K2})""",
)
def _(t):
    f = images(t).withColumn("score", F.aggregate("data", F.lit(-32.0), lambda a, x: a + x))
    f = IM.with_disk_median(f)
    ref = f.groupBy("capture_id").agg(F.max_by("disk_median", F.struct(F.round("score", 9), -c("frame_idx"))).alias("_ref"))
    f = skew.attach(f, ref, ["capture_id"])
    g = c("_ref") / c("disk_median")
    return out(f, FRAME, gain=g, mean=g * IM.total("data") / 64.0)


def rgb_frames(t):
    return t.frames.select(*FRAME, *[F.transform(p, lambda v: v + 0.5).alias(k) for k, p in mosaic_planes("data").items()])


_RGB5 = f"q AS (SELECT {K2}, pos, r+0.5e0 AS r, g+0.5e0 AS g, b+0.5e0 AS b FROM {RGB_SQL})"


@query(
    "x12_gain_match",
    f"""WITH {_RGB5}, k AS (SELECT *, r>0.4 AND g>0.4 AND b>0.4 AS ok FROM q), p AS (SELECT {K2}, quantile_cont(r,0.6e0) FILTER (WHERE ok) AS pr, quantile_cont(g,0.6e0) FILTER (WHERE ok) AS pg, quantile_cont(b,0.6e0) FILTER (WHERE ok) AS pb FROM k GROUP BY ALL),
m AS (SELECT {K2}, median(r) FILTER (WHERE ok AND r>=pr) AS mr, median(g) FILTER (WHERE ok AND g>=pg) AS mg, median(b) FILTER (WHERE ok AND b>=pb) AS mb, avg(CASE WHEN r>0.4 THEN 1.0 ELSE 0 END) AS cr, avg(CASE WHEN g>0.4 THEN 1.0 ELSE 0 END) AS cg, avg(CASE WHEN b>0.4 THEN 1.0 ELSE 0 END) AS cb, count(*) FILTER (WHERE NOT ok) AS nu FROM k JOIN p USING ({K2}) GROUP BY ALL)
SELECT {K2}, {R('mg/mr', 'gain_r')}, {R('mg/mb', 'gain_b')}, {R('cr', 'cover_r')}, {R('cg', 'cover_g')}, {R('cb', 'cover_b')}, nu::INTEGER AS n_uncovered FROM m""",
)
def _(t):
    return rounded(IM.gain_match(rgb_frames(t), FRAME, 0.4), [*FRAME, "n_uncovered"])


@query(
    "x13_fringe",
    f"""WITH {_RGB5}, i AS (SELECT {K2}, pos, r, g, b, pos//4 AS y, pos%4 AS x FROM q), n AS (SELECT *, lag(g,4) OVER w AS u, lead(g,4) OVER w AS dn, lag(g) OVER w AS l, lead(g) OVER w AS rt FROM i WINDOW w AS (PARTITION BY {K2} ORDER BY pos)),
e AS (SELECT *, round(sqrt(pow(CASE WHEN y=0 THEN dn-g WHEN y=3 THEN g-u ELSE (dn-u)/2 END,2)+pow(CASE WHEN x=0 THEN rt-g WHEN x=3 THEN g-l ELSE (rt-l)/2 END,2)),10) AS m FROM n),
t AS (SELECT {K2}, quantile_cont(m,0.8e0) AS thr, sqrt(avg(g*g))+1e-12 AS rms FROM e GROUP BY ALL)
SELECT {K2}, count(*)::INTEGER AS n_edges, {R('median(abs(r-g)+abs(b-g))/any_value(rms)', 'fringe')} FROM e JOIN t USING ({K2}) WHERE m>=thr GROUP BY ALL""",
)
def _(t):
    return out(IM.fringe(rgb_frames(t), 4, 4, FRAME), [*FRAME, "n_edges"], fringe=c("fringe"))


def mask_sql(percs):
    vals = ",".join(f"({p}.0e0)" for p in percs)
    return f"""th AS (SELECT {K2}, perc, quantile_cont(v, perc) AS thr FROM (SELECT {K2}, v, unnest([{','.join(str(p) + '.0e0' for p in percs)}]) AS perc FROM d_ipx) GROUP BY ALL)"""


def mask_cte(percs):
    parts = " UNION ALL ".join(f"SELECT {K2}, {p}.0e0 AS perc, quantile_cont(v,{p / 100}e0) AS thr FROM d_ipx GROUP BY ALL" for p in percs)
    return f"th AS ({parts}), mk AS (SELECT {K2}, perc, thr, y, x, v FROM d_ipx JOIN th USING ({K2}) WHERE v<=thr)"


def ctr(w):
    return f"sum(({w})*x)/sum({w}) AS cx, sum(({w})*y)/sum({w}) AS cy"


_TW = "(thr-v+1e-6)"


@query(
    "x14_dark_barycentre",
    f"WITH {mask_cte([8, 12, 18])}, g AS (SELECT {K2}, perc, count(*) AS n, {ctr(_TW)} FROM mk GROUP BY ALL) SELECT {K2}, perc, n::INTEGER AS n, {R('cx', 'cx')}, {R('cy', 'cy')} FROM g",
)
def _(t):
    return out(IM.dark_barycentre(images(t), 8, [8, 12, 18], FRAME), [*FRAME, "perc", "n"], cx=c("cx"), cy=c("cy"))


@query(
    "x15_otsu_barycentre",
    f"""WITH m AS (SELECT {K2}, max(v) AS mx, max(v)-min(v) AS sp, count(*) AS n FROM d_ipx GROUP BY ALL),
h AS (SELECT {K2}, least(floor((mx-v)/sp*64),63) AS k, count(*)/any_value(n) AS p FROM d_ipx JOIN m USING ({K2}) GROUP BY ALL),
f AS (SELECT m.capture_id, m.frame_idx, b.k, coalesce(p,0) AS p FROM m, (SELECT unnest(range(64)) AS k) b LEFT JOIN h ON h.capture_id=m.capture_id AND h.frame_idx=m.frame_idx AND h.k=b.k),
q AS (SELECT {K2}, k, sum(p) OVER w AS o, sum(p*k) OVER w AS mu, sum(p*k) OVER (PARTITION BY {K2}) AS mt FROM f WINDOW w AS (PARTITION BY {K2} ORDER BY k)),
s AS (SELECT {K2}, k FROM q QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY round(pow(mt*o-mu,2)/(o*(1-o)+1e-12),10) DESC, k)=1),
z AS (SELECT {K2}, k, mx-k*sp/64 AS thr FROM s JOIN m USING ({K2})), g AS (SELECT {K2}, any_value(k) AS k, any_value(thr) AS thr, count(*) AS n, {ctr(_TW)} FROM d_ipx JOIN z USING ({K2}) WHERE v<=thr GROUP BY ALL)
SELECT {K2}, k::INTEGER AS k, {R('thr', 'thr')}, n::INTEGER AS n, {R('cx', 'cx')}, {R('cy', 'cy')} FROM g""",
)
def _(t):
    return out(IM.otsu_barycentre(images(t), 8, FRAME), [*FRAME, "k", "n"], thr=c("thr"), cx=c("cx"), cy=c("cy"))


@query(
    "x16_moments",
    f"""WITH {mask_cte([15])}, m AS (SELECT {K2}, {ctr(_TW)} FROM mk GROUP BY ALL), g AS (SELECT {K2}, count(*) AS n, any_value(cx) AS cx, any_value(cy) AS cy, sum({_TW}*pow(x-cx,2))/sum({_TW}) AS xx, sum({_TW}*pow(y-cy,2))/sum({_TW}) AS yy, sum({_TW}*(x-cx)*(y-cy))/sum({_TW}) AS xy FROM mk JOIN m USING ({K2}) GROUP BY ALL)
SELECT {K2}, n::INTEGER AS n, {R('cx', 'cx')}, {R('cy', 'cy')}, {R('4*sqrt(greatest(xx,1e-6))', 'length')}, {R('4*sqrt(greatest(yy,1e-6))', 'width')}, {R('greatest((xx+yy)/2+sqrt(pow((xx-yy)/2,2)+xy*xy),1e-9)', 'axis_major')}, {R('greatest((xx+yy)/2-sqrt(pow((xx-yy)/2,2)+xy*xy),1e-9)', 'axis_minor')} FROM g""",
)
def _(t):
    return rounded(IM.moments(images(t), 8, FRAME), [*FRAME, "n"])


@query(
    "x16b_flux_powers",
    f"""WITH {mask_cte([20])}, e AS (SELECT *, unnest([1.0e0,2.0e0,4.0e0]) AS power FROM mk), g AS (SELECT {K2}, power, {ctr('pow(thr-v+1e-6,power)')} FROM e GROUP BY ALL) SELECT {K2}, power, {R('cx', 'cx')}, {R('cy', 'cy')} FROM g""",
)
def _(t):
    return out(IM.flux_powers(images(t), 8, FRAME), [*FRAME, "power"], cx=c("cx"), cy=c("cy"))


_LON = lambda cx: W(f"least(greatest(-90.0e0+({cx})/7*180,-90),90)")
_LAT = "90.0e0-cy*180.0e0/7"


@query(
    "x17_isophote_ladder",
    f"""WITH {mask_cte([8, 12, 16, 22, 28])}, g AS (SELECT {K2}, perc, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM mk GROUP BY ALL HAVING count(*)>=2), l AS (SELECT *, {_LON('cx')} AS lon, {_LAT} AS lat FROM g)
SELECT {K2}, count(*) AS n_levels, {R(W('degrees(atan2(avg(sin(radians(lon))),avg(cos(radians(lon)))))'), 'lon')}, {R('avg(lat)', 'lat')} FROM l GROUP BY ALL HAVING count(*)>=2""",
)
def _(t):
    from driftline.operators.circular import circular_mean

    l = IM.isophote_ladder(images(t), 8, 8, FRAME)
    g = l.groupBy(*FRAME).agg(F.count("*").alias("n_levels"), circular_mean("lon").alias("lon"), F.avg("lat").alias("lat"))
    return rounded(g.where("n_levels >= 2"), [*FRAME, "n_levels"])


@query(
    "x17b_percentile_ladder",
    f"""WITH {mask_cte([5, 10, 15, 20, 25, 30, 35])}, h AS (SELECT *, median(v) OVER (PARTITION BY {K2}, perc) AS md, count(*) OVER (PARTITION BY {K2}, perc) AS n FROM mk), g AS (SELECT {K2}, perc, {ctr('greatest(md-v,1e-6)')} FROM h WHERE n>=2 GROUP BY ALL), l AS (SELECT *, {_LON('cx')} AS lon, {_LAT} AS lat FROM g)
SELECT {K2}, perc, {R('lon', 'lon')}, {R('lat', 'lat')} FROM l""",
)
def _(t):
    return out(IM.percentile_ladder(images(t), 8, 8, FRAME), [*FRAME, "perc"], lon=c("lon"), lat=c("lat"))


_PROF = f"""pr AS (SELECT {K2}, b.x AS x, avg(v) AS m FROM d_ipx JOIN (SELECT unnest(range(8))::INTEGER AS x) b USING (x) GROUP BY ALL), sk AS (SELECT {K2}, unnest(range(8))::INTEGER AS x FROM d_frames),
fr AS (SELECT sk.*, coalesce(m, median(m) OVER (PARTITION BY {K2})) AS m FROM sk LEFT JOIN pr USING (capture_id, frame_idx, x))"""
_SM = f"""{_PROF}, sm AS (SELECT {K2}, x, round((coalesce(lag(m) OVER w,0)+m+coalesce(lead(m) OVER w,0))/3,9) AS s FROM fr WINDOW w AS (PARTITION BY {K2} ORDER BY x))"""


@query(
    "x19_longitude_scan",
    f"""WITH {_SM}, i AS (SELECT {K2}, x AS i0, s AS s0, a, b FROM (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM sm WINDOW w AS (PARTITION BY {K2} ORDER BY x)) QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY s, x)=1),
h AS (SELECT {K2}, quantile_cont(s,0.9e0) AS top FROM sm GROUP BY ALL), j AS (SELECT i.*, 0.5*(top+s0) AS half FROM i JOIN h USING ({K2})),
e AS (SELECT {K2}, any_value(i0) AS i0, any_value(s0) AS s0, any_value(a) AS a, any_value(b) AS b, coalesce(max(x) FILTER (WHERE s>=half AND x<=i0),0) AS l, coalesce(min(x) FILTER (WHERE s>=half AND x>=i0),7) AS r FROM sm JOIN j USING ({K2}) GROUP BY ALL)
SELECT {K2}, i0::INTEGER AS i0, {R('i0+CASE WHEN i0>0 AND i0<7 AND abs(a-2*s0+b)>1e-12 THEN 0.5*(a-b)/(a-2*s0+b) ELSE 0 END', 'ix')}, {R('(l+r)/2.0', 'centre')}, (r-l)::INTEGER AS fwhm FROM e""",
)
def _(t):
    return out(IM.longitude_scan(images(t), 8, FRAME), [*FRAME, "i0", "fwhm"], ix=c("ix"), centre=c("centre"))


_GA = f"""{_PROF}, mx AS (SELECT *, max(m) OVER (PARTITION BY {K2})-m AS inv FROM fr), wt AS (SELECT {K2}, x, greatest(inv-quantile_cont(inv,0.4e0) OVER (PARTITION BY {K2}),0)+1e-12 AS w FROM mx),
u0 AS (SELECT {K2}, sum(w*x)/sum(w) AS mu FROM wt GROUP BY ALL), g0 AS (SELECT {K2}, any_value(mu) AS mu, sum(w*pow(x-mu,2))/sum(w) AS var FROM wt JOIN u0 USING ({K2}) GROUP BY ALL)"""
for _i in range(3):
    _GA += f""", u{_i + 1} AS (SELECT {K2}, any_value(mu) AS m0, any_value(var) AS v0, sum(w*exp(-0.5*pow(x-mu,2)/(var+1e-6))*x)/sum(w*exp(-0.5*pow(x-mu,2)/(var+1e-6))) AS mu FROM wt JOIN g{_i} USING ({K2}) GROUP BY ALL),
g{_i + 1} AS (SELECT {K2}, any_value(mu) AS mu, sum(w*exp(-0.5*pow(x-m0,2)/(v0+1e-6))*pow(x-mu,2))/sum(w*exp(-0.5*pow(x-m0,2)/(v0+1e-6))) AS var FROM wt JOIN u{_i + 1} USING ({K2}) GROUP BY ALL)"""


@query("x19b_gaussian_profile", f"WITH {_GA} SELECT {K2}, {R('mu', 'mu', 5)}, {R('var', 'var', 5)} FROM g3")
def _(t):
    return out(IM.gaussian_profile(images(t), 8, FRAME), FRAME, 5, mu=c("mu"), var=c("var"))


@query(
    "x20_darkest",
    f"""WITH lo AS (SELECT {K2}, y AS min_y, x AS min_x FROM d_ipx QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY v, y, x)=1),
tr AS (SELECT {K2}, y AS track_y, x AS track_x FROM d_ipx QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY round(abs(90.0e0-y*180.0e0/7+22),9), v, x)=1),
iv AS (SELECT *, greatest(median(v) OVER (PARTITION BY {K2})-v,0) AS i FROM d_ipx), p AS (SELECT *, quantile_cont(i,0.7e0) OVER (PARTITION BY {K2}) AS t FROM iv), s AS (SELECT {K2}, avg(x) AS sx, avg(y) AS sy FROM p WHERE i>t GROUP BY ALL)
SELECT {K2}, min_x::DOUBLE AS min_x, min_y::DOUBLE AS min_y, track_x::DOUBLE AS track_x, track_y::DOUBLE AS track_y, {R('sx', 'sym_x')}, {R('sy', 'sym_y')} FROM lo JOIN tr USING ({K2}) LEFT JOIN s USING ({K2})""",
)
def _(t):
    d = IM.darkest(images(t), 8, 8, FRAME)
    return out(d, [*FRAME, "min_x", "min_y", "track_x", "track_y"], sym_x=c("sym_x"), sym_y=c("sym_y"))


def _dsql(a, b):
    return f"(({a})-({b})+180.0e0 - 360.0e0*floor((({a})-({b})+180.0e0)/360.0e0) - 180.0e0)"


@query(
    "x21_extent",
    f"""WITH {mask_cte([14])}, g AS (SELECT {K2}, {ctr(_TW)} FROM mk GROUP BY ALL), l AS (SELECT {K2}, {_LON('cx')} AS lon FROM g),
r AS (SELECT {K2}, any_value(lon) AS lon, quantile_cont(round({_dsql('-90.0e0+x/7.0e0*180', 'lon')},9),0.95e0) AS hi, quantile_cont(round({_dsql('-90.0e0+x/7.0e0*180', 'lon')},9),0.05e0) AS lo, min(y) AS y0, max(y) AS y1 FROM mk JOIN l USING ({K2}) GROUP BY ALL),
e AS (SELECT {K2}, round({W('lon+hi')},9) AS west, round({W('lon+lo')},9) AS east, y0, y1 FROM r)
SELECT {K2}, {R('west', 'west')}, {R('east', 'east')}, {R(W('east+' + _dsql('west', 'east') + '/2'), 'mid')}, {R('90.0e0-y0*180.0e0/7', 'north')}, {R('90.0e0-y1*180.0e0/7', 'south')} FROM e""",
)
def _(t):
    return rounded(IM.extent(images(t), 8, 8, FRAME), FRAME)


def _moved(name, src, weight, steps, tolerance):
    """A centre that moves to its weighted mean, as a recursion over frames with their pixels in lists."""
    at = lambda v: f"list_sum([w[j]*{v}[j] FOR j IN range(1,len(w)+1)])/(list_sum(w)+1e-12)"
    return f"""{name}(i, {K2}, xs, ys, cx, cy, done) AS (SELECT 0, {K2}, xs, ys, list_avg(xs), list_avg(ys), false FROM {src}
UNION ALL SELECT i+1, {K2}, xs, ys, nx, ny, sqrt((nx-cx)**2+(ny-cy)**2)<{tolerance} FROM (SELECT *, {at('xs')} AS nx, {at('ys')} AS ny FROM (
 SELECT *, [{weight} FOR j IN range(1,len(xs)+1)] AS w FROM {name} WHERE i<{steps} AND NOT done))),
{name}_end AS (SELECT {K2}, cx, cy FROM {name} QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY i DESC)=1)"""


_R2 = "((xs[j]-cx)**2+(ys[j]-cy)**2)"
_PXL = "list(x::DOUBLE ORDER BY y,x) AS xs, list(y::DOUBLE ORDER BY y,x) AS ys"
X22_SQL = f"""WITH RECURSIVE {mask_cte([15, 16])}, dk AS (SELECT {K2}, count(*) AS n, {_PXL}, list(v ORDER BY y,x) AS vs, quantile_cont(x::DOUBLE,0.3e0) AS lo, quantile_cont(x::DOUBLE,0.7e0) AS hi FROM mk WHERE perc=15 GROUP BY ALL),
wd AS (SELECT {K2}, count(*) AS n, {_PXL} FROM mk WHERE perc=16 GROUP BY ALL), dk3 AS (FROM dk WHERE n>=6), wd3 AS (FROM wd WHERE n>=6),
{_moved('gm', 'dk3', f'1/greatest(sqrt({_R2}),1e-6)', 40, '1e-4')},
{_moved('ms', 'wd3', f'exp(-0.5*{_R2}/16)', 50, '1e-3')},
km(i, {K2}, xs, ys, vs, a, b, pa, pb, done) AS (SELECT 0, {K2}, xs, ys, vs, lo, hi, lo, hi, false FROM dk WHERE n>=8
UNION ALL SELECT i+1, {K2}, xs, ys, vs, CASE WHEN ok THEN list_avg(l) ELSE a END, CASE WHEN ok THEN list_avg(r) ELSE b END, a, b, NOT ok FROM (SELECT *, len(l)>=2 AND len(r)>=2 AS ok FROM (
 SELECT *, [x FOR x IN xs IF abs(x-a)<=abs(x-b)] AS l, [x FOR x IN xs IF abs(x-a)>abs(x-b)] AS r FROM km WHERE i<15 AND NOT done))),
ke AS (SELECT * FROM km QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY i DESC)=1),
kp AS (SELECT {K2}, a, b, unnest(xs) AS x, unnest(ys) AS y, unnest(vs) AS v, pa, pb FROM ke),
kg AS (SELECT {K2}, abs(x-pa)>abs(x-pb) AS right_, avg(v) AS v, avg(x) AS dx, avg(y) AS dy, any_value(a) AS k0, any_value(b) AS k1 FROM kp GROUP BY ALL),
ks AS (SELECT * FROM kg QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY v, right_)=1)
SELECT {K2}, coalesce(dk.n,0)::INTEGER AS n, coalesce(wd.n,0)::INTEGER AS n_shift, {R('gm_end.cx', 'gx')}, {R('gm_end.cy', 'gy')}, {R('ms_end.cx', 'mx')}, {R('ms_end.cy', 'my')}, {R('k0', 'k0')}, {R('k1', 'k1')}, {R('dx', 'dx')}, {R('dy', 'dy')},
 coalesce(dk.n,0)>=6 AS median_ok, coalesce(wd.n,0)>=6 AS mode_ok, coalesce(dk.n,0)>=8 AS split_ok
FROM d_frames LEFT JOIN dk USING ({K2}) LEFT JOIN wd USING ({K2}) LEFT JOIN gm_end USING ({K2}) LEFT JOIN ms_end USING ({K2}) LEFT JOIN ks USING ({K2})"""


@query("x22_iterated_centres", X22_SQL)
def _(t):
    r = IM.iterated_centres(images(t), 8, FRAME, least=(6, 6, 8), part=2)
    return out(r, [*FRAME, "n", "n_shift", "median_ok", "mode_ok", "split_ok"], **{n: c(n) for n in ("gx", "gy", "mx", "my", "k0", "k1", "dx", "dy")})


@query(
    "x23_histogram_mode",
    f"""WITH {mask_cte([15])}, cl AS (SELECT {K2}, y//2 AS cy, x//2 AS cx FROM mk), gr AS (SELECT k//4 AS gy, k%4 AS gx, k FROM (SELECT unnest(range(16)) AS k)),
v AS (SELECT {K2}, k, gx, gy, sum(CASE WHEN cy=gy AND cx=gx THEN 1.0e0 WHEN abs(cy-gy)<=1 AND abs(cx-gx)<=1 THEN 0.5e0 ELSE 0 END) AS votes FROM cl, gr GROUP BY ALL)
SELECT {K2}, votes::DOUBLE AS votes, ((gx+0.5)*2-0.5)::DOUBLE AS cx, ((gy+0.5)*2-0.5)::DOUBLE AS cy FROM v QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY votes DESC, k)=1""",
)
def _(t):
    return IM.histogram_mode(images(t), 8, FRAME)


_LL = p2l_sql("q16", "x", "y", "1.45e0", "1.55e0", "2.1e0", "40.0e0", "0.0e0", "0.0e0")
_CL = f"""q16 AS (SELECT {K2}, (pos//4)::INTEGER AS y, (pos%4)::INTEGER AS x, greatest(r-g,0)*greatest(r-b,0) AS score FROM {RGB_SQL}), ll AS (SELECT {K2}, y, x, score, lat FROM {_LL})"""


def colour_pixels(t):
    lon, lat, _on = N.pixel_to_lonlat("x", "y", 1.45, 1.55, 2.1, 40.0)
    p = rgb_pixels(t).withColumns({"y": F.floor(c("pos") / 4), "x": c("pos") % 4, "score": O.orange_product("r", "g", "b")})
    p = p.withColumn("lat", lat)
    # 16 pixels per frame here; a real frame arrives with its pixel array already built
    return p.groupBy(*FRAME).agg(F.collect_list(F.struct("y", "x", "lat", "score")).alias("px"))


@query(
    "x24_colour_lock",
    f"""WITH {_CL}, s AS (SELECT * FROM ll WHERE lat BETWEEN -60 AND 30), pk AS (SELECT {K2}, score AS peak, y AS py, x AS px FROM s QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY score DESC, y, x)=1),
b AS (SELECT {K2}, count(*) AS n, median(score) AS md FROM s JOIN pk USING ({K2}) WHERE abs(y-py)<=2 AND score>0 GROUP BY ALL),
w AS (SELECT {K2}, CASE WHEN sum(score)>0 THEN sum(score*y)/sum(score) ELSE any_value(py) END AS cy, CASE WHEN sum(score)>0 THEN sum(score*x)/sum(score) ELSE any_value(px) END AS cx FROM s JOIN pk USING ({K2}) WHERE abs(y-py)<=1 AND abs(x-px)<=1 GROUP BY ALL)
SELECT {K2}, {R('peak', 'peak', 9)}, {R('cy', 'cy', 5)}, {R('cx', 'cx', 5)}, peak>0 AND NOT (coalesce(n,0)>=4 AND peak<1.35*md) AS ok FROM pk JOIN w USING ({K2}) LEFT JOIN b USING ({K2})""",
)
def _(t):
    d = IM.colour_lock(colour_pixels(t), FRAME, (-60.0, 30.0), 1.0).withColumn("peak", F.round("peak", 9))
    return out(d, [*FRAME, "peak", "ok"], 5, cy=c("cy"), cx=c("cx"))


@query(
    "x25_flip_suggestion",
    f"""WITH {_CL}, d AS (SELECT * FROM ll WHERE pow(y-1.55,2)+pow(x-1.45,2)<pow(0.9*2.1,2)) SELECT {K2}, {R('score', 'peak', 9)}, {R('lat', 'lat', 5)}, score>1e-8 AND lat>5 AS flip FROM d QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY score DESC, y, x)=1""",
)
def _(t):
    px = colour_pixels(t)
    disk = F.filter("px", lambda p: (p["y"] - 1.55) * (p["y"] - 1.55) + (p["x"] - 1.45) * (p["x"] - 1.45) < (0.9 * 2.1) ** 2)
    best = F.array_min(F.transform(disk, lambda p: F.struct((-p["score"]).alias("n"), p["y"].alias("y"), p["x"].alias("x"), p["lat"].alias("lat"))))
    d = px.select(*FRAME, best.alias("b"))
    peak = -c("b.n")
    return d.select(*FRAME, F.round(peak, 9).alias("peak"), F.round("b.lat", 5).alias("lat"), ((peak > 1e-8) & (c("b.lat") > 5)).alias("flip"))


_SD = 2 * 0.7
_OV = lambda l, o: f"least(greatest(least({l}+{_SD}e0,{o}+1)-greatest({l},{o}),0),1)"


@query(
    "x26_drizzle",
    f"""WITH d AS (SELECT *, (y+(frame_idx%7-3)*0.21e0+0.5)*2-{_SD / 2}e0 AS ly, (x+(frame_idx%5-2)*0.33e0+0.5)*2-{_SD / 2}e0 AS lx, 1.0e0+frame_idx%3 AS q FROM d_pixels), e AS (SELECT *, floor(ly)+i AS oy, floor(lx)+j AS ox FROM d, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)),
a AS (SELECT *, {_OV('ly', 'oy')}*{_OV('lx', 'ox')} AS a FROM e WHERE oy BETWEEN 0 AND 15 AND ox BETWEEN 0 AND 15), g AS (SELECT capture_id, oy::INTEGER AS oy, ox::INTEGER AS ox, sum(q*a*v) AS num, sum(q*a) AS den FROM a WHERE a>1e-12 GROUP BY ALL)
SELECT capture_id, oy, ox, {R('num', 'num')}, {R('den', 'den')}, {R('num/den', 'value')} FROM g""",
)
def _(t):
    k = c("frame_idx")
    px = t.pixels.withColumns({"dy": (k % 7 - 3) * 0.21, "dx": (k % 5 - 2) * 0.33, "q": 1.0 + k % 3})
    return rounded(PX.drizzle(px, 2, 0.7, 8, 8), ["capture_id", "oy", "ox"])


_SH = [0.0, 0.5, -0.25, 1.3, -2.2, 0.01, 3.4, -0.6]


@query(
    "x27_row_warp",
    f"""WITH p AS (SELECT *, (CAST({_SH} AS DOUBLE[]))[y+1] AS s FROM d_pixels), q AS (SELECT p.*, least(greatest(x-s,0),7) AS a FROM p)
SELECT q.{K2.replace(', ', ', q.')}, q.y, q.x, {R('CASE WHEN abs(q.s)<0.02 THEN q.v ELSE l.v+(h.v-l.v)*(a-floor(a)) END', 'v')} FROM q JOIN d_pixels l ON l.capture_id=q.capture_id AND l.frame_idx=q.frame_idx AND l.y=q.y AND l.x=floor(a) JOIN d_pixels h ON h.capture_id=q.capture_id AND h.frame_idx=q.frame_idx AND h.y=q.y AND h.x=least(floor(a)+1,7)""",
)
def _(t):
    w = IM.row_warp(t.frames, 8, FRAME, _SH)
    w = w.select(*FRAME, F.posexplode("data").alias("pos", "v"))
    return out(w.withColumns({"y": F.floor(c("pos") / 8).cast("int"), "x": c("pos") % 8}), [*FRAME, "y", "x"], v=c("v"))


_HOT = f"""hm AS (SELECT *, median(v) OVER w AS m FROM d_pixels WINDOW w AS (PARTITION BY {K2})), hd AS (SELECT *, abs(v-m)>1.5*1.4826e0*(median(abs(v-m)) OVER (PARTITION BY {K2})+1e-12) AS hot FROM hm)"""


@query("x28_hot_pixels", f"WITH {_HOT} SELECT {K2}, y, x, hot FROM hd")
def _(t):
    h = IM.hot_pixels(t.frames, FRAME, 1.5)
    return h.select(*FRAME, F.posexplode("hot").alias("pos", "hot")).select(*FRAME, F.floor(c("pos") / 8).cast("int").alias("y"), (c("pos") % 8).alias("x"), "hot")


@query(
    "j15_replace_hot",
    f"""WITH {_HOT} SELECT a.capture_id, a.frame_idx, a.y, a.x, {R('CASE WHEN any_value(a.hot) THEN coalesce(sum(b.v)/nullif(count(*) FILTER (WHERE NOT b.hot),0),0) ELSE any_value(a.v) END', 'v')} FROM hd a JOIN hd b ON a.capture_id=b.capture_id AND a.frame_idx=b.frame_idx AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 AND (a.y<>b.y OR a.x<>b.x) GROUP BY 1,2,3,4""",
)
def _(t):
    r = IM.replace_hot(IM.hot_pixels(t.frames, FRAME, 1.5), 8, 8, FRAME).select(*FRAME, F.posexplode("data").alias("pos", "v"))
    return out(r.withColumns({"y": F.floor(c("pos") / 8).cast("int"), "x": c("pos") % 8}), [*FRAME, "y", "x"], v=c("v"))


_BB = f"""b AS (SELECT {K2}, x::DOUBLE AS x, y::DOUBLE AS y, v FROM d_pixels WHERE y=0 OR x=0),
n AS (SELECT {K2}, count(*)::DOUBLE AS s, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(v) AS v, sum(x*v) AS xv, sum(y*v) AS yv FROM b GROUP BY ALL),
q AS (SELECT *, s*(xx*yy-xy*xy)-sx*(sx*yy-xy*sy)+sy*(sx*xy-xx*sy) AS d FROM n)"""


@query(
    "x29_border_plane",
    f"""WITH {_BB} SELECT {K2}, {R('(v*(xx*yy-xy*xy)-sx*(xv*yy-xy*yv)+sy*(xv*xy-xx*yv))/d', 'a')}, {R('(s*(xv*yy-xy*yv)-v*(sx*yy-xy*sy)+sy*(sx*yv-xv*sy))/d', 'b')}, {R('(s*(xx*yv-xv*xy)-sx*(sx*yv-xv*sy)+v*(sx*xy-xx*sy))/d', 'c')} FROM q""",
)
def _(t):
    return rounded(IM.border_plane(t.frames, 8, 8, FRAME), FRAME)


# The border of 8 x 8 pixels is the first row and the first column, so x y is 0 there. Per arm the residuals of 1 and of the values
# against (x, x^2) give the constant, and that gives the arm's two coefficients.
_ARM = f"""w AS (SELECT {K2}, pos, v FROM (SELECT {K2}, unnest(range(64)) AS pos, unnest(data) AS v FROM d_frames)),
arm AS (SELECT {K2}, 'x' AS arm, pos::DOUBLE AS u, v FROM w WHERE pos BETWEEN 1 AND 7 UNION ALL SELECT {K2}, 'y', (pos//8)::DOUBLE, v FROM w WHERE pos%8=0 AND pos>0),
mo AS (SELECT {K2}, arm, sum(u) s1, sum(u*u) s2, sum(u*u*u) s3, sum(u*u*u*u) s4, sum(u*v) q1, sum(u*u*v) q2, sum(v) q0, count(*) n FROM arm GROUP BY ALL),
co AS (SELECT *, (s4*s1-s3*s2)/(s2*s4-s3*s3) AS e1, (s2*s2-s3*s1)/(s2*s4-s3*s3) AS e2, (s4*q1-s3*q2)/(s2*s4-s3*s3) AS g1, (s2*q2-s3*q1)/(s2*s4-s3*s3) AS g2 FROM mo),
ca AS (SELECT {K2}, sum(q0-e1*q1-e2*q2) AS top, sum(n-e1*s1-e2*s2) AS bottom FROM co GROUP BY ALL),
cz AS (SELECT {K2}, (top+v)/(bottom+1) AS a FROM ca JOIN (SELECT {K2}, v FROM w WHERE pos=0) USING ({K2})),
fit AS (SELECT {K2}, any_value(a) AS a, max(g1-a*e1) FILTER (WHERE arm='x') AS b, max(g1-a*e1) FILTER (WHERE arm='y') AS c, max(g2-a*e2) FILTER (WHERE arm='x') AS d,
  0.0e0 AS e, max(g2-a*e2) FILTER (WHERE arm='y') AS f FROM co JOIN cz USING ({K2}) GROUP BY ALL)"""


@query("x29b_border_quadratic", f"WITH {_ARM} SELECT {K2}, {', '.join(R(k, k) for k in 'abcdef')} FROM fit")
def _(t):
    return rounded(IM.border_quadratic(t.frames, 8, 8, FRAME), FRAME)


@query(
    "x30_stretch",
    f"""WITH q AS (SELECT *, quantile_cont(v,0.001e0) OVER w AS a, quantile_cont(v,0.999e0) OVER w AS b FROM d_pixels WINDOW w AS (PARTITION BY {K2})) SELECT {K2}, y, x, {R('least(greatest((v-a)/CASE WHEN b<=a THEN 1 ELSE b-a END,0),1)', 'v')} FROM q""",
)
def _(t):
    s = IM.stretch(t.frames, FRAME).select(*FRAME, F.posexplode("data").alias("pos", "v"))
    return out(s.withColumns({"y": F.floor(c("pos") / 8).cast("int"), "x": c("pos") % 8}), [*FRAME, "y", "x"], v=c("v"))


@query(
    "x31_isophote_size",
    f"""WITH i AS (SELECT *, greatest(median(v) OVER (PARTITION BY {K2})-v,0) AS w FROM d_ipx), m AS (SELECT *, max(w) OVER (PARTITION BY {K2}) AS top FROM i), k AS (SELECT * FROM m WHERE w>=0.45e0*top),
g AS (SELECT {K2}, sum(w*x)/sum(w) AS cx, sum(w*y)/sum(w) AS cy FROM k GROUP BY ALL), h AS (SELECT {K2}, count(*) AS n, any_value(top) AS top, sum(w*pow(x-cx,2))/(sum(w)+1e-12) AS xx, sum(w*pow(y-cy,2))/(sum(w)+1e-12) AS yy, sum(w*(x-cx)*(y-cy))/(sum(w)+1e-12) AS xy FROM k JOIN g USING ({K2}) GROUP BY ALL),
e AS (SELECT {K2}, n, top, least(greatest(4*sqrt(greatest((xx+yy)/2+sqrt(pow((xx-yy)/2,2)+xy*xy),1e-9)),5),22) AS l, least(greatest(4*sqrt(greatest((xx+yy)/2-sqrt(pow((xx-yy)/2,2)+xy*xy),1e-9)),3),14) AS w FROM h)
SELECT {K2}, n::INTEGER AS n, {R('CASE WHEN n<4 OR top<=0 OR l/w>3.5 OR w/l>2 THEN 12 ELSE l END', 'length')}, {R('CASE WHEN n<4 OR top<=0 OR l/w>3.5 OR w/l>2 THEN 8 ELSE w END', 'width')} FROM e""",
)
def _(t):
    return rounded(IM.isophote_size(images(t), 8, FRAME), [*FRAME, "n"])


_RAD = "sqrt(pow(x-3.5,2)+pow(y-3.5,2))/(3.0e0+1e-12)"
_DISK = f"""r AS (SELECT {K2}, y, x, v+0.5e0-CASE WHEN {_RAD}>0.95 THEN 0.3e0 ELSE 0 END AS v, {_RAD} AS rr, pow((x-3.5)/3.0e0,2)+pow((y-3.5)/(3.0e0*{1 - FLATTENING}e0),2)<=1 AS i FROM d_pixels),
q AS (SELECT *, max(v) OVER (PARTITION BY {K2}) AS top FROM r), f AS (SELECT {K2}, avg(CASE WHEN v>=0.25*top THEN 1.0 ELSE 0 END) FILTER (WHERE i) AS fill, avg(v) FILTER (WHERE i)-avg(v) FILTER (WHERE NOT i) AS contrast FROM q GROUP BY ALL),
b AS (SELECT {K2}, floor((rr-0.5e0)/0.1e0)::INTEGER AS bin, avg(v) AS m FROM r WHERE rr>=0.5 AND rr<1.5 GROUP BY ALL), p AS (SELECT *, 0.5e0+(bin+0.5)*0.1e0 AS rm FROM b),
n AS (SELECT *, (m-median(m) FILTER (WHERE rm>1.15) OVER w)/greatest(median(m) FILTER (WHERE rm<0.85) OVER w-median(m) FILTER (WHERE rm>1.15) OVER w,1e-6) AS pn FROM p WINDOW w AS (PARTITION BY {K2})),
l AS (SELECT *, lead(pn) OVER w AS p2, lead(rm) OVER w AS r2, lead(bin) OVER w AS b2 FROM n WINDOW w AS (PARTITION BY {K2} ORDER BY bin)),
s AS (SELECT {K2}, arg_min(rm+(0.2e0-pn)/(p2-pn+1e-12)*(r2-rm),bin) FILTER (WHERE b2=bin+1 AND ((pn>=0.2 AND p2<0.2) OR (pn>0.2 AND p2<=0.2))) AS r20, arg_min(rm+(0.8e0-pn)/(p2-pn+1e-12)*(r2-rm),bin) FILTER (WHERE b2=bin+1 AND ((pn>=0.8 AND p2<0.8) OR (pn>0.8 AND p2<=0.8))) AS r80 FROM l GROUP BY ALL),
dk AS (SELECT {K2}, fill, contrast, (r20-r80)/1.6832e0*2.3548e0 AS soft FROM f LEFT JOIN s USING ({K2}))"""


def disk_px(t):
    rr = F.sqrt(F.pow(c("x") - 3.5, 2) + F.pow(c("y") - 3.5, 2)) / (3.0 + 1e-12)
    return t.pixels.withColumn("v", c("v") + 0.5 - F.when(rr > 0.95, F.lit(0.3)).otherwise(F.lit(0.0)))


@query("x18_disk_profile", f"WITH {_DISK} SELECT {K2}, {R('fill', 'fill')}, {R('contrast', 'contrast')}, {R('soft', 'softness', 5)} FROM dk")
def _(t):
    d = IM.disk_profile(disk_px(t), FRAME, 3.5, 3.5, 3.0, FLATTENING, 10, 0.5, 1.5).withColumn("softness", F.round("softness", 5))
    return out(d, [*FRAME, "softness"], fill=c("fill"), contrast=c("contrast"))


@query(
    "p07_disk_gate",
    f"""WITH {_DISK} SELECT {K2}, concat_ws(',', CASE WHEN fill<0.9 THEN 'fill' END, CASE WHEN contrast<0.25 THEN 'contrast' END, CASE WHEN 20+frame_idx%20<25 THEN 'radius' END, CASE WHEN soft*8>3.5 THEN 'soft_warn' END, CASE WHEN soft*8>5 THEN 'soft_fail' END) AS reasons,
 NOT (fill<0.9 OR contrast<0.25 OR 20+frame_idx%20<25) AS disk_present, NOT (fill<0.9 OR contrast<0.25 OR 20+frame_idx%20<25) AND NOT coalesce(soft*8>5,false) AS measurable FROM dk""",
)
def _(t):
    d = IM.disk_profile(disk_px(t), FRAME, 3.5, 3.5, 3.0, FLATTENING, 10, 0.5, 1.5).withColumn("softness_arcsec", c("softness") * 8.0)
    return IM.disk_gate(d, 20.0 + c("frame_idx") % 20).select(*FRAME, "reasons", "disk_present", "measurable")


@query(
    "p06_cube_quality",
    f"""WITH p AS (SELECT capture_id, frame_idx, v+0.5e0 AS v FROM d_pixels), m AS (SELECT {K2}, avg(v) AS m FROM p GROUP BY ALL), g AS (SELECT capture_id, count(*) AS n_frames, avg(m) AS mean_flux, 1-min(m)/(max(m)+1e-12) AS flux_drop FROM m GROUP BY 1),
t AS (SELECT capture_id, v AS top FROM (SELECT capture_id, v, row_number() OVER (PARTITION BY capture_id ORDER BY v)-1 AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM p) WHERE r=floor((n-1)*0.9999e0)),
s AS (SELECT capture_id, avg(CASE WHEN v>=0.98e0 THEN 1.0 ELSE 0 END) AS clip_frac, avg(CASE WHEN v>=0.25*top THEN 1.0 ELSE 0 END) AS disk_fill FROM p JOIN t USING (capture_id) GROUP BY 1),
q AS (SELECT *, concat_ws(',', CASE WHEN n_frames<50 AND n_frames>1 THEN 'few_frames' END, CASE WHEN n_frames>5 AND flux_drop>0.2 THEN 'flux_drop' END, CASE WHEN clip_frac>0.0002 THEN 'clipped' END, CASE WHEN disk_fill<0.01 THEN 'no_disk' END) AS reasons FROM g JOIN s USING (capture_id))
SELECT capture_id, n_frames, {R('mean_flux', 'mean_flux')}, {R('flux_drop', 'flux_drop')}, {R('clip_frac', 'clip_frac')}, {R('disk_fill', 'disk_fill')}, reasons, reasons='' AS ok FROM q""",
)
def _(t):
    px = t.pixels.withColumn("v", c("v") + 0.5)
    return rounded(PX.cube_quality(px, 50, 0.2, 0.0002, 0.01), ["capture_id", "n_frames", "reasons", "ok"])


@query(
    "j13_calibration",
    f"""WITH d AS (SELECT y, x, v AS d FROM d_pixels WHERE frame_idx=0), f AS (SELECT y, x, (v+0.5e0)/(median(v+0.5e0) OVER ()+1e-12) AS f FROM d_pixels WHERE frame_idx=1) SELECT {K2}, y, x, {R('(v-d)/f', 'v')} FROM d_pixels JOIN d USING (y, x) JOIN f USING (y, x)""",
)
def _(t):
    dark = t.pixels.where("frame_idx = 0").select("y", "x", c("v").alias("d"))
    flat = t.pixels.where("frame_idx = 1").select("y", "x", (c("v") + 0.5).alias("f"))
    return out(PX.calibrate(t.pixels, dark, flat), [*FRAME, "y", "x"], v=c("v"))


_NAV = {"xc": 3.5, "yc": 3.4, "a_eq_px": 3.3, "flattening": FLATTENING, "sub_lat": 3.0, "north_pa": 10.0}
_KK = 1 - FLATTENING


@query(
    "j14_cylindrical_map",
    f"""WITH g AS (SELECT r::INTEGER AS row, q::INTEGER AS col, radians(90.0e0-r*180.0e0/8) AS la, radians(-90.0e0+q*180.0e0/16) AS lo FROM (SELECT unnest(range(9)) AS r), (SELECT unnest(range(17)) AS q)),
b AS (SELECT *, cos(la)*sin(lo)/sqrt(cos(la)^2+(sin(la)/{_KK}e0)^2) AS bx, sin(la)/sqrt(cos(la)^2+(sin(la)/{_KK}e0)^2) AS by_, cos(la)*cos(lo)/sqrt(cos(la)^2+(sin(la)/{_KK}e0)^2) AS bz FROM g),
u AS (SELECT *, by_*cos(radians(3.0e0))-bz*sin(radians(3.0e0)) AS ty, by_*sin(radians(3.0e0))+bz*cos(radians(3.0e0)) AS tz FROM b),
s AS (SELECT row, col, tz, 3.5e0+(bx*cos(radians(10.0e0))-ty*sin(radians(10.0e0)))*3.3e0 AS px, 3.4e0-(bx*sin(radians(10.0e0))+ty*cos(radians(10.0e0)))*3.3e0 AS py FROM u),
k AS (SELECT row, col, floor(px)::INTEGER AS x0, floor(py)::INTEGER AS y0, px-floor(px) AS fx, py-floor(py) AS fy FROM s WHERE tz>0.02 AND floor(px) BETWEEN 0 AND 6 AND floor(py) BETWEEN 0 AND 6)
SELECT {K2}, row, col, {R('data[y0*8+x0+1]*(1-fx)*(1-fy)+data[y0*8+x0+2]*fx*(1-fy)+data[(y0+1)*8+x0+1]*(1-fx)*fy+data[(y0+1)*8+x0+2]*fx*fy', 'v')} FROM d_frames, k""",
)
def _(t):
    return out(IM.cylindrical_map(t.frames, 8, 8, FRAME, _NAV, 17, 9), [*FRAME, "row", "col"], v=c("v"))


@query(
    "j16_channel_alignment",
    f"SELECT {K2}, pos::INTEGER AS pos, {R('r', 'R')}, {R('g', 'G')}, {R('b', 'B')}, r>-0.1 AND g>-0.1 AND b>-0.1 AS covered FROM {RGB_SQL}",
)
def _(t):
    """Three channel captures as separate rows, aligned on the pixel."""
    p = rgb_pixels(t)
    rows = p.select(*FRAME, "pos", F.explode(F.array(*[
        F.struct(F.lit(n).alias("channel"), c(v).alias("v")) for n, v in (("R", "r"), ("G", "g"), ("B", "b"))])).alias("e")).select(*FRAME, "pos", "e.*")
    w = rows.groupBy(*FRAME, "pos").pivot("channel", ["R", "G", "B"]).agg(F.first("v"))
    ok = (c("R") > -0.1) & (c("G") > -0.1) & (c("B") > -0.1)
    return out(w.withColumn("covered", ok), [*FRAME, "pos", "covered"], R=c("R"), G=c("G"), B=c("B"))


_ZL = p2l_sql("d_pixels", "x", "y", "3.5e0", "3.5e0", "4.0e0", "0.0e0", "0.0e0", "0.0e0")


def disk_geometry(t):
    lon, lat, on = N.pixel_to_lonlat("x", "y", 3.5, 3.5, 4.0)
    return IM.settle(t.pixels.withColumns({"v": c("v") + 0.5, "lon": lon, "lat": lat, "on": on}))


@query(
    "a39_zonal_profile",
    f"""WITH z AS (SELECT capture_id, least(floor((lat+90)/15.0e0),11)::INTEGER AS bin, v+0.5e0 AS v FROM {_ZL} WHERE on_disk), g AS (SELECT capture_id, bin, avg(v) AS m, count(*) AS n FROM z GROUP BY ALL), d AS (SELECT capture_id, median(m) FILTER (WHERE n>50) AS md FROM g GROUP BY 1)
SELECT capture_id, bin, n, {R('CASE WHEN md>1e-6 THEN m/md ELSE m END', 'profile')} FROM g JOIN d USING (capture_id)""",
)
def _(t):
    from pyspark.sql import Window

    b = F.least(F.floor((c("lat") + 90.0) / 15.0), F.lit(11)).cast("int")
    g = disk_geometry(t).where("on").groupBy("capture_id", b.alias("bin")).agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    md = F.median(F.when(c("n") > 50, c("m"))).over(Window.partitionBy("capture_id"))  # twelve bins per capture
    g = g.withColumn("_md", md)
    return out(g, ["capture_id", "bin", "n"], profile=F.when(c("_md") > 1e-6, c("m") / c("_md")).otherwise(c("m")))


_MU = f"least(greatest(cos(radians(lat))*cos(radians({W('lon+180.0e0')}-180.0e0))/sqrt(cos(radians(lat))^2+(sin(radians(lat))/{_KK}e0)^2)/(sqrt(pow(cos(radians(lat))/sqrt(cos(radians(lat))^2+(sin(radians(lat))/{_KK}e0)^2),2)+pow(sin(radians(lat))/sqrt(cos(radians(lat))^2+(sin(radians(lat))/{_KK}e0)^2)/{_KK * _KK}e0,2))+1e-12),0),1)"
_LD = f"""g AS (SELECT capture_id, ln(greatest({_MU},0.05)) AS lm, ln(v+0.5e0) AS li FROM {_ZL} WHERE on_disk AND v+0.5>0), h AS (SELECT *, floor((lm+3.0e0)/0.25e0)::INTEGER AS bin FROM g),
b AS (SELECT capture_id, bin, median(lm) AS x, median(li) AS y, count(*)::DOUBLE AS w, true AS kept FROM h GROUP BY ALL HAVING count(*)>=20)"""
_LF = "sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w) AS sw, sum(w*x*x)/sum(w)-pow(sum(w*x)/sum(w),2) AS vx, sum(w*x*y)/sum(w)-sum(w*x)/sum(w)*sum(w*y)/sum(w) AS cxy"


@query(
    "a38_limb_darkening",
    f"""WITH {_LD}, f AS (SELECT capture_id, {_LF}, count(*) AS n FROM b GROUP BY 1), r AS (SELECT capture_id, y-my-cxy/vx*(x-mx) AS r, w, x, y FROM b JOIN f USING (capture_id)), m AS (SELECT capture_id, median(r) AS med FROM r GROUP BY 1),
d AS (SELECT capture_id, median(abs(r-med))+1e-9 AS mad, any_value(med) AS med FROM r JOIN m USING (capture_id) GROUP BY 1), k AS (SELECT r.*, NOT abs(r-med)>4*1.4826e0*mad AS kept FROM r JOIN d USING (capture_id)), f2 AS (SELECT capture_id, {_LF}, count(*) AS n FROM k WHERE kept GROUP BY 1)
SELECT capture_id, n AS n_bins, {R('cxy/vx', 'k', 5)}, {R('exp(my-cxy/vx*mx)', 'i0', 5)} FROM f2""",
)
def _(t):
    """Power law of intensity against the emission cosine: binned medians, weighted line, one clip at four MADs."""
    mu = N.emission_cosine("lon", "lat")
    p = disk_geometry(t).where(c("on") & (c("v") > 0)).select(
        "capture_id", F.ln(F.greatest(mu, F.lit(0.05))).alias("lm"), F.ln("v").alias("li"))
    p = skew.cut(p.withColumn("bin", F.floor((c("lm") + 3.0) / 0.25).cast("int")))
    k = ["capture_id", "bin"]
    b = skew.group_quantiles(p, k, "lm", {"x": 0.5}).join(skew.group_quantiles(p, k, "li", {"y": 0.5}).drop("n"), k)
    b = skew.cut(b.where("n >= 20").withColumn("w", c("n").cast("double")).drop("n"))
    cap = ["capture_id"]
    f = S.fit_lines(b, cap, c("x"), c("y"), c("w")).select("capture_id", "a", "b")
    r = b.join(f, cap).withColumn("r", c("y") - c("a") - c("b") * c("x")).drop("a", "b")
    r = skew.group_mad(r, cap, "r", "_med", "_mad", 1.0)
    kept = r.where(~(F.abs(c("r") - c("_med")) > 4.0 * 1.4826 * (c("_mad") + 1e-9)))
    g = S.fit_lines(kept, cap, c("x"), c("y"), c("w"))
    return out(g.withColumnRenamed("n", "n_bins"), ["capture_id", "n_bins"], 5, k=c("b"), i0=F.exp("a"))


@query(
    "a41_lucky_report",
    f"SELECT capture_id, count(*) AS n, {R('min(s)', 'sharp_min')}, {R('quantile_cont(s,0.1e0)', 'p10')}, {R('median(s)', 'median')}, {R('quantile_cont(s,0.9e0)', 'p90')}, {R('max(s)', 'sharp_max')}, {R('max(s)/greatest(min(s),1e-12)', 'dynamic_range', 4)} FROM (SELECT capture_id, list_sum([x*x FOR x IN data]) AS s FROM d_frames) GROUP BY 1",
)
def _(t):
    s = t.frames.select("capture_id", F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    q = skew.group_quantiles(s, ["capture_id"], "s", {"sharp_min": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "sharp_max": 1.0})
    q = q.withColumn("dynamic_range", F.round(c("sharp_max") / F.greatest("sharp_min", F.lit(1e-12)), 4))
    return rounded(q, ["capture_id", "n", "dynamic_range"])
