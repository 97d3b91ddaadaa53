"""Series, event and interpolation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import planets as PL
from driftline.operators import series as S
from driftline.operators import skew

from .campaigns import rounded
from .registry import D, R, W, query
from .scalars import c, out, sky_sql, wind_sql, with_planet

SID = ["series_id"]
_LAG = f"l AS (SELECT *, lag(lon) OVER w AS pl, lag(lat) OVER w AS pa FROM d_series WINDOW w AS (PARTITION BY series_id ORDER BY t_us, ord))"


def unwrap_sql(src):
    return f"""SELECT *, sum(coalesce({D('lon', 'pl')}, lon)) OVER (PARTITION BY series_id ORDER BY t_us, ord ROWS UNBOUNDED PRECEDING) AS lon_u
 FROM (SELECT *, lag(lon) OVER (PARTITION BY series_id ORDER BY t_us, ord) AS pl FROM {src})"""


@query("w01_unwrap", f"SELECT series_id, ord, {R('lon_u', 'lon_u')} FROM ({unwrap_sql('d_series')})")
def _(t):
    return out(S.unwrap(t.series, SID, "lon"), ["series_id", "ord"], lon_u=c("lon_u"))


@query("w02_unwrap_warning", f"WITH {_LAG} SELECT series_id, coalesce(max(abs({D('lon', 'pl')}))>90,false) AS unwrap_warning FROM l GROUP BY 1")
def _(t):
    return S.step_summary(t.series, SID, "lon", "lat").select("series_id", "unwrap_warning")


@query("w03_max_jump", f"WITH {_LAG} SELECT series_id, {R(f'max(sqrt(pow({D("lon", "pl")},2)+pow(lat-pa,2)))', 'max_jump')} FROM l GROUP BY 1")
def _(t):
    return out(S.step_summary(t.series, SID, "lon", "lat"), SID, max_jump=c("max_jump"))


def fit_sql(t, y, w, by="series_id"):
    """Normal-equation columns of a weighted line: a, b, chi2 pieces."""
    return (f"sum({w}) AS sw, sum(({w})*({t}))/sum({w}) AS mt, sum(({w})*({y}))/sum({w}) AS my, count(*) AS n")


@query(
    "a36_weighted_line",
    f"""WITH p AS (SELECT series_id, (t_us-1704067200000000)/86400e6 AS t, lat AS y, 1/(sigma*sigma) AS w FROM d_series),
m AS (SELECT series_id, {fit_sql('t', 'y', 'w')} FROM p GROUP BY 1),
f AS (SELECT series_id, any_value(n) AS n, any_value(sw) AS sw, any_value(mt) AS mt, any_value(my) AS my, sum(w*(t-mt)*(y-my))/nullif(sum(w*(t-mt)*(t-mt)),0) AS b, sum(w*(t-mt)*(t-mt)) AS stt FROM p JOIN m USING (series_id) GROUP BY 1),
r AS (SELECT series_id, sum(w*pow(y-my-b*(t-mt),2))/greatest(any_value(n)-2,1) AS chi FROM p JOIN f USING (series_id) GROUP BY 1)
SELECT series_id, n, {R('my-b*mt', 'a')}, {R('b', 'b')}, {R('sqrt(chi*(1/sw+mt*mt/stt))', 'sigma_a')}, {R('sqrt(chi/stt)', 'sigma_b')} FROM f JOIN r USING (series_id)""",
)
def _(t):
    days = (c("t_us") - F.lit(1704067200000000)) / 86400e6
    f = S.fit_lines(t.series, SID, days, c("lat"), 1.0 / (c("sigma") * c("sigma")))
    return out(f, ["series_id", "n"], **{k: c(k) for k in ("a", "b", "sigma_a", "sigma_b")})


def _drift_sql():
    s = f"""p0 AS (SELECT series_id, t_us, ord, lon, lat, (t_us-min(t_us) OVER w)/86400e6 AS t, lon_u-first_value(lon) OVER (PARTITION BY series_id ORDER BY t_us, ord) AS y,
 first_value(lon) OVER (PARTITION BY series_id ORDER BY t_us, ord) AS lon0, min(t_us) OVER w AS t_ref_us, greatest(sigma,1e-3) AS sigma, abs({D('lon', 'pl')}) AS step,
 count(*) OVER w AS n_total, avg(lat) OVER w AS lat_ref, true AS kept FROM ({unwrap_sql('d_steady')}) WINDOW w AS (PARTITION BY series_id)),
q0 AS (SELECT * FROM p0 WHERE n_total>=3)"""
    for i in range(3):
        s += f""",
m{i} AS (SELECT series_id, sum(w*t)/sum(w) AS mt, sum(w*y)/sum(w) AS my FROM (SELECT *, 1/(sigma*sigma) AS w FROM q{i} WHERE kept) GROUP BY 1),
f{i} AS (SELECT series_id, any_value(mt) AS mt, any_value(my) AS my, sum((t-mt)*(y-my)/(sigma*sigma))/sum((t-mt)*(t-mt)/(sigma*sigma)) AS b FROM q{i} JOIN m{i} USING (series_id) WHERE kept GROUP BY 1),
r{i} AS (SELECT q{i}.*, (y-my-b*(t-mt))/sigma AS sc FROM q{i} JOIN f{i} USING (series_id)),
d{i} AS (SELECT series_id, median(sc) AS med FROM r{i} WHERE kept GROUP BY 1),
e{i} AS (SELECT series_id, greatest(1.4826e0*median(abs(sc-med)),1e-6) AS sr, any_value(med) AS med FROM r{i} JOIN d{i} USING (series_id) WHERE kept GROUP BY 1),
q{i + 1} AS (SELECT r{i}.* EXCLUDE (sc, kept), kept AND NOT abs(sc-med)>3*sr AS kept FROM r{i} JOIN e{i} USING (series_id))"""
    s += """,
k AS (SELECT *, 1/(sigma*sigma) AS w, count(*) OVER (PARTITION BY series_id) AS n FROM q3 WHERE kept),
m AS (SELECT series_id, any_value(n) AS n, sum(w) AS sw, sum(w*t)/sum(w) AS mt, sum(w*y)/sum(w) AS my FROM k WHERE n>=3 GROUP BY 1),
f AS (SELECT series_id, any_value(m.n) AS n, any_value(mt) AS mt, any_value(my) AS my, sum(w*(t-mt)*(t-mt)) AS stt, sum(w*(t-mt)*(y-my))/sum(w*(t-mt)*(t-mt)) AS b FROM k JOIN m USING (series_id) GROUP BY 1),
g AS (SELECT series_id, sum(w*pow(y-my-b*(t-mt),2)) AS chl, sqrt(avg(pow(y-my-b*(t-mt),2))) AS rms FROM k JOIN f USING (series_id) GROUP BY 1),
o1 AS (SELECT series_id, sum(w*(t-mt)*(t-mt))/sum(w) AS m2, sum(w*pow(t-mt,3))/sum(w*(t-mt)*(t-mt)) AS m3 FROM k JOIN f USING (series_id) GROUP BY 1),
o2 AS (SELECT series_id, sum(w*z*y)/sum(w*z*z) AS cc, any_value(m2) AS m2, any_value(m3) AS m3 FROM (SELECT k.series_id, w, y, m2, m3, pow(t-mt,2)-m2-m3*(t-mt) AS z FROM k JOIN f USING (series_id) JOIN o1 USING (series_id)) GROUP BY 1),
g2 AS (SELECT series_id, sum(w*pow(y-my-b*(t-mt)-cc*(pow(t-mt,2)-m2-m3*(t-mt)),2)) AS chq, any_value(cc) AS cc, any_value(m2) AS m2, any_value(m3) AS m3 FROM k JOIN f USING (series_id) JOIN o2 USING (series_id) GROUP BY 1),
i AS (SELECT series_id, any_value(t_ref_us) AS t_ref_us, any_value(n_total) AS n_total, any_value(lat_ref) AS lat_ref, any_value(lon0) AS l0, coalesce(max(step)>90,false) AS unwrap_warning, max(t_us) AS t_last FROM q3 GROUP BY 1),
z AS (SELECT series_id, t_ref_us, t_last, l0, f.n AS n_used, n_total, lat_ref, unwrap_warning, b AS rate, l0+my-b*mt AS araw, sqrt(chl/greatest(f.n-2,1)/stt) AS sr, rms, chl/greatest(f.n-2,1) AS rchi,
 CASE WHEN f.n>=6 THEN (chl-chq)/greatest(chq/greatest(f.n-3,1),1e-12) END AS fs, CASE WHEN f.n>=6 THEN cc END AS qc, CASE WHEN f.n>=6 THEN b-cc*m3-2*cc*mt END AS qb,
 CASE WHEN f.n>=6 THEN l0+my-b*mt+cc*(mt*mt-m2+m3*mt) END AS qa FROM f JOIN g USING (series_id) JOIN g2 USING (series_id) JOIN i USING (series_id)),
zz AS (SELECT *, CASE WHEN fs>4 THEN 'quadratic' ELSE 'linear' END AS model, """ + W("araw") + """ AS lon0 FROM z)"""
    return s


_DRIFT = _drift_sql()


@query(
    "m01_fit_drift",
    f"""WITH {_DRIFT} SELECT series_id, t_ref_us, n_total, n_used, unwrap_warning, model, {R('lon0', 'lon0', 5)}, {R('rate', 'rate', 5)}, {R('sr', 'sigma_rate', 5)}, {R('rms', 'rms', 5)},
 {R('rchi', 'reduced_chi2', 5)}, {R('lat_ref', 'lat_ref', 5)}, {R('fs', 'f_stat', 4)} FROM zz""",
)
def _(t):
    fits, _points = S.fit_drift(t.steady, SID)
    keys = ["series_id", "t_ref_us", "n_total", "n_used", "unwrap_warning", "model"]
    names = ("lon0", "rate", "sigma_rate", "rms", "reduced_chi2", "lat_ref")
    return out(fits.withColumn("f_stat", F.round("f_stat", 4)), [*keys, "f_stat"], 5, **{k: c(k) for k in names})


@query(
    "a37_quadratic_control",
    f"WITH {_DRIFT} SELECT series_id, {R('qa', 'quad_a', 4)}, {R('qb', 'quad_b', 5)}, {R('qc', 'quad_c', 6)}, fs>4 AS preferred FROM zz",
)
def _(t):
    f, _points = S.fit_drift(t.steady, SID)
    return f.select(
        "series_id", F.round("quad_a", 4).alias("quad_a"), F.round("quad_b", 5).alias("quad_b"),
        F.round("quad_c", 6).alias("quad_c"), (c("f_stat") > 4).alias("preferred"),
    )


_PD = "(30+(t_last-t_ref_us)/86400e6)"


@query(
    "m02_predict",
    f"""WITH {_DRIFT} SELECT series_id, model, {R(_PD, 'days', 5)}, {R(W(f"CASE WHEN model='quadratic' THEN qa+qb*{_PD}+qc*{_PD}*{_PD} ELSE lon0+rate*{_PD} END"), 'pred_lon', 4)},
 {R(f'sqrt(pow(sr*greatest({_PD},0),2)+rms*rms)', 'pred_sigma', 5)} FROM zz""",
)
def _(t):
    fits, points = S.fit_drift(t.steady, SID)
    last = points.groupBy("series_id").agg(F.max("t_us").alias("t_last"))
    f = S.predict(fits.join(last, "series_id"), 30.0 + (c("t_last") - c("t_ref_us")) / 86400e6)
    return f.select(
        "series_id", "model", F.round("days", 5).alias("days"), F.round("pred_lon", 4).alias("pred_lon"),
        F.round("pred_sigma", 5).alias("pred_sigma"),
    )


_K2 = 66854.0 / 71492.0
_VEL = f"71492000.0e0*cos(radians(lat_ref))/sqrt(cos(radians(lat_ref))^2+(sin(radians(lat_ref))/{_K2}e0)^2)*pi()/180/86400"


@query(
    "m03_zonal_velocity",
    f"WITH {_DRIFT} SELECT series_id, {R(f'rate*{_VEL}', 'u_mps', 4)}, {R(f'sr*{_VEL}', 'u_std_mps', 4)} FROM zz",
)
def _(t):
    fits, _points = S.fit_drift(t.steady, SID)
    k = PL.parallel_radius_m("lat_ref") * (3.141592653589793 / 180.0 / 86400.0)
    f = with_planet(t, fits)
    return out(f, SID, 4, u_mps=c("rate") * k, u_std_mps=c("sigma_rate") * k)


_DIFF = f"""b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_us, ord) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM d_steady),
rf AS (SELECT series_id, lon AS rl, lat AS ra, t_us AS rt, ord AS ref_ord FROM b WHERE k=least(3,n)),
p AS (SELECT b.series_id, b.t_us, b.ord, b.lat, (b.t_us-rt)/86400e6 AS t, {D('b.lon', 'rl')} AS y, b.lat-ra AS ya, 1/pow(greatest(sigma,0.05e0),2) AS w, n, ref_ord FROM b JOIN rf USING (series_id)),
m AS (SELECT series_id, sum(w) AS sw, sum(w*t)/sum(w) AS mt, sum(w*y)/sum(w) AS my, avg(t) AS mt1, avg(ya) AS ma FROM p GROUP BY 1),
f AS (SELECT series_id, any_value(sw) AS sw, any_value(mt) AS mt, any_value(my) AS my, any_value(mt1) AS mt1, any_value(ma) AS ma, sum(w*pow(t-mt,2)) AS stt,
 sum(w*(t-mt)*(y-my))/sum(w*pow(t-mt,2)) AS bl, sum((t-mt1)*(ya-ma))/sum(pow(t-mt1,2)) AS ba FROM p JOIN m USING (series_id) GROUP BY 1),
x AS (SELECT p.*, bl, ba, stt, my+bl*(t-mt) AS model_dlon, ma+ba*(t-mt1) AS model_dlat, y-(my+bl*(t-mt)) AS residual FROM p JOIN f USING (series_id))"""


@query(
    "m04_differential_series",
    f"""WITH {_DIFF} SELECT series_id, count(*) AS n, any_value(ref_ord) AS ref_ord, {R('any_value(bl)', 'drift_lon', 5)}, {R('any_value(ba)', 'drift_lat', 5)},
 {R('sqrt(sum(w*residual*residual)/greatest(count(*)-2,1)/any_value(stt))', 'drift_sigma', 5)}, {R('sqrt(sum(w*residual*residual)/sum(w))', 'rms_lon', 5)},
 {R(f'sqrt(avg(pow({sky_sql("residual", "(ya-model_dlat)", "lat", "5.0e0").replace("model_dlat", "MDL").replace("MDL", "model_dlat")},2)))', 'rms_sky', 5)} FROM x GROUP BY 1""",
)
def _(t):
    _points, head = S.differential_series(t.steady, SID, 2, 5.0)
    return out(head, ["series_id", "n", "ref_ord"], 5, **{
        k: c(k) for k in ("drift_lon", "drift_lat", "drift_sigma", "rms_lon", "rms_sky")
    })


@query(
    "w04_reference_differences",
    f"""WITH {_DIFF} SELECT series_id, ord, {R('t', 'days')}, {R('y', 'dlon')}, {R('ya', 'dlat')}, {R('residual', 'residual', 5)} FROM x""",
)
def _(t):
    pts, _head = S.differential_series(t.steady, SID, 2, 5.0)
    pts = pts.withColumn("residual", F.round("residual", 5))
    return out(pts, ["series_id", "ord", "residual"], days=c("days"), dlon=c("dlon"), dlat=c("dlat"))


def cm_table(t):
    e = c("ord")
    return t.series.where("source = 'signup'").select(
        "series_id", "t_us", "ord", A.wrap_deg(c("lon") * 1.4).alias("cm"), (e % 7 - 3).cast("double").alias("sub_lat"),
        (e % 50).cast("double").alias("np_pa"), F.when(e % 9 != 0, 4.0 + e % 3).alias("distance_au"),
    )


_CM = f"""k AS (SELECT series_id, t_us, ord, {W('lon*1.4e0')} AS cm, (ord%7-3)::DOUBLE AS sub_lat, (ord%50)::DOUBLE AS np_pa, CASE WHEN ord%9<>0 THEN 4.0e0+ord%3 END AS au FROM d_series WHERE source='signup'),
o AS (SELECT series_id, t_us, ord FROM d_series WHERE source<>'signup'),
pv AS (SELECT o.series_id, o.t_us, o.ord, k.t_us AS t1, k.cm AS c1, k.sub_lat AS s1, k.np_pa AS p1, k.au AS a1 FROM o ASOF LEFT JOIN k ON o.series_id=k.series_id AND o.t_us>=k.t_us),
nx AS (SELECT pv.*, k.t_us AS t2, k.cm AS c2, k.sub_lat AS s2, k.np_pa AS p2, k.au AS a2 FROM pv ASOF LEFT JOIN k ON pv.series_id=k.series_id AND pv.t_us<=k.t_us),
u AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN (t_us-t1)/greatest((t2-t1)::DOUBLE,1e-3) END AS u FROM nx WHERE t1 IS NOT NULL OR t2 IS NOT NULL)"""


@query(
    "j01_interpolate_table",
    f"""WITH {_CM} SELECT series_id, ord, {R(f"CASE WHEN u IS NULL THEN coalesce(c1,c2) ELSE {W('c1+u*' + D('c2', 'c1'))} END", 'cm')}, {R('CASE WHEN u IS NULL THEN coalesce(s1,s2) ELSE s1+u*(s2-s1) END', 'sub_lat')},
 {R(f"CASE WHEN u IS NULL THEN coalesce(p1,p2) ELSE p1+u*{D('p2', 'p1')} END", 'np_pa')}, {R('CASE WHEN u IS NULL THEN coalesce(a1,a2) ELSE a1+u*(a2-a1) END', 'distance_au')} FROM u""",
)
def _(t):
    df = S.interpolate_table(t.series.where("source <> 'signup'"), cm_table(t), SID)
    return out(df, ["series_id", "ord"], **{k: c(k) for k in ("cm", "sub_lat", "np_pa", "distance_au")})


@query(
    "w14_detrend",
    """WITH p AS (SELECT series_id, ord, (t_us-1704067200000000)/86400e6 AS t, lat FROM d_series), f AS (SELECT series_id, regr_slope(lat,t) AS b, avg(t) AS mt, avg(lat) AS m FROM p GROUP BY 1),
r AS (SELECT p.series_id, ord, lat-m-coalesce(b,0)*(t-mt) AS res, m FROM p JOIN f USING (series_id))
SELECT series_id, ord, round(res,6) AS residual, round(m,6) AS level, round(sqrt(avg(res*res) OVER (PARTITION BY series_id)),6) AS rms FROM r""",
)
def _(t):
    df = S.detrend(t.series, SID, (c("t_us") - F.lit(1704067200000000)) / 86400e6, "lat")
    return out(df, ["series_id", "ord"], residual=c("residual"), level=c("level"), rms=c("rms"))


@query(
    "m07_periodogram",
    f"""WITH p AS (SELECT series_id, (t_us-1704067200000000)/86400e6 AS t, lat-avg(lat) OVER (PARTITION BY series_id) AS y FROM d_series),
x AS (SELECT series_id, period, y, cos(2*pi()/period*t) AS c, sin(2*pi()/period*t) AS s FROM p, (VALUES (2.5e0),(7.0e0),(14.0e0),(90.0e0)) v(period)),
f AS (SELECT series_id, period, sum(c*y)/(sum(c*c)+1e-12) AS ac, sum(s*y)/(sum(s*s)+1e-12) AS sc FROM x GROUP BY 1,2)
SELECT series_id, period, {R('1-sum(pow(y-ac*c-sc*s,2))/(sum(y*y)+1e-12)', 'power')} FROM x JOIN f USING (series_id, period) GROUP BY 1,2""",
)
def _(t):
    days = (c("t_us") - F.lit(1704067200000000)) / 86400e6
    return out(S.periodogram(t.series, SID, days, "lat", [2.5, 7.0, 14.0, 90.0]), ["series_id", "period"], power=c("power"))


def rel_col():
    return A.wrap_diff("lon", 100.0)


def spaced_sql(gap):
    """Kept events of x, one step of the recursion each."""
    k = "min({'t': x.t_us, 'o': x.ord})"
    return f"""kept AS (SELECT series_id, {k} AS k FROM x GROUP BY 1
 UNION ALL SELECT x.series_id, {k} FROM kept JOIN x ON x.series_id=kept.series_id AND x.t_us-kept.k.t>{gap} GROUP BY 1),
cross_ev AS (SELECT series_id, k.o AS ord, k.t AS t_us FROM kept)"""


_REL = f"r AS (SELECT *, {D('lon', '100.0e0')} AS rel FROM d_series)"
_W8 = f"""{_REL}, p AS (SELECT *, lag(t_us) OVER w AS pt, lag(rel) OVER w AS pr FROM r WINDOW w AS (PARTITION BY series_id ORDER BY t_us, ord)),
x AS MATERIALIZED (SELECT series_id, ord, round(pt+(t_us-pt)*(-sin(radians(pr)))/(sin(radians(rel))-sin(radians(pr))))::BIGINT AS t_us FROM p
 WHERE sin(radians(pr))>0 AND sin(radians(rel))<=0 AND cos(radians(pr))+cos(radians(rel))>0),
{spaced_sql(3600000000)}"""
_W9 = """s AS (SELECT *, abs(rel)<=60 AS i, lag(abs(rel)<=60) OVER w AS pi, lead(t_us) OVER w AS nt FROM r WINDOW w AS (PARTITION BY series_id ORDER BY t_us, ord)),
g AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(pi,false) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t_us, ord ROWS UNBOUNDED PRECEDING) AS k FROM s),
vis AS (SELECT series_id, min(t_us) AS start_us, max(coalesce(nt,t_us)) AS end_us, first(t_us ORDER BY abs(rel), t_us) AS peak_us, count(*) AS n_samples FROM g WHERE i GROUP BY series_id, k)"""


@query("w08_crossings", f"WITH RECURSIVE {_W8} SELECT series_id, ord, t_us//10 AS t_10us FROM cross_ev")
def _(t):
    df = S.crossings(t.series.withColumn("rel", rel_col()), SID, "rel")
    return df.select("series_id", "ord", F.call_function("div", c("t_us"), F.lit(10)).alias("t_10us"))


@query("w09_visible_windows", f"WITH {_REL}, {_W9} SELECT series_id, start_us, end_us, peak_us, n_samples FROM vis")
def _(t):
    return S.visible_windows(t.series.withColumn("rel", rel_col()), SID, "rel", 60.0)


@query(
    "w10_close_approaches",
    f"""WITH RECURSIVE a AS (SELECT series_id, t_us, ord, abs(lat+19.8e0)*0.3e0 AS sep, ord%4<>0 AS front FROM d_series),
b AS (SELECT *, lag(sep) OVER w AS p, lead(sep) OVER w AS n FROM a WINDOW w AS (PARTITION BY series_id ORDER BY t_us, ord)),
x AS MATERIALIZED (SELECT * FROM b WHERE round(sep,9)<=round(p,9) AND round(sep,9)<=round(n,9) AND sep<1.02 AND front),
{spaced_sql(1800000000)}
SELECT series_id, ord, t_us, round(sep,6) AS sep FROM cross_ev JOIN x USING (series_id, ord, t_us)""",
)
def _(t):
    d = t.series.withColumn("sep", F.round(F.abs(c("lat") + 19.8) * 0.3, 9))
    df = S.close_approaches(d, SID, "sep", c("ord") % 4 != 0, 1.02, 1_800_000_000)
    return out(df, ["series_id", "ord", "t_us"], sep=c("sep"))


@query(
    "w11_closest_per_day",
    f"""WITH {_REL} SELECT series_id, t_us//86400000000 AS day, first(t_us ORDER BY abs(rel), t_us) AS t_us, {R('min(abs(rel))', 'rel')} FROM r GROUP BY 1,2""",
)
def _(t):
    return out(S.closest_per_day(t.series.withColumn("rel", rel_col()), SID, "rel"), ["series_id", "day", "t_us"], rel=c("rel"))


@query(
    "m09_night_sheet",
    f"""WITH RECURSIVE {_W8}, {_W9} SELECT series_id, 'transit' AS kind, t_us//10 AS start_10us, NULL::BIGINT AS end_10us FROM cross_ev
UNION ALL SELECT series_id, 'visible', start_us//10, end_us//10 FROM vis""",
)
def _(t):
    d = t.series.withColumn("rel", rel_col())
    ten = lambda x: F.call_function("div", c(x), F.lit(10))
    a = S.crossings(d, SID, "rel").select(
        "series_id", F.lit("transit").alias("kind"), ten("t_us").alias("start_10us"), F.lit(None).cast("bigint").alias("end_10us"))
    b = S.visible_windows(d, SID, "rel", 60.0).select(
        "series_id", F.lit("visible").alias("kind"), ten("start_us").alias("start_10us"), ten("end_us").alias("end_10us"))
    return a.unionByName(b).orderBy("series_id", "start_10us", "kind")


@query(
    "w15_keep_last",
    "SELECT machine, ord, action FROM d_usage QUALIFY row_number() OVER (PARTITION BY machine ORDER BY t_us DESC, ord)<=3",
)
def _(t):
    df = skew.keep_largest(t.usage, ["machine"], "t_us", "ord", F.least(F.lit(3), c("n")))
    return df.where("kept").select("machine", "ord", "action")


@query(
    "w17_frame_offsets",
    """WITH f AS (SELECT capture_id, frame_idx, CASE WHEN capture_id%3=0 OR frame_idx%5<>0 THEN frame_idx*250000+7 END AS stamp, CASE WHEN capture_id%3=1 THEN 0.25e0 END AS cad FROM d_frames),
g AS (SELECT capture_id, min(stamp) AS t0, count(stamp) AS ns, count(*) AS n, max(cad) AS cd FROM f GROUP BY 1)
SELECT capture_id, frame_idx, round(CASE WHEN ns=n THEN (stamp-t0)/1e6 WHEN cd>0 THEN frame_idx*cd END,6) AS dt_s, CASE WHEN ns=n THEN 'stamp' WHEN cd>0 THEN 'cadence' ELSE 'refused' END AS source FROM f JOIN g USING (capture_id)""",
)
def _(t):
    cap, k = c("capture_id"), c("frame_idx")
    f = t.frames.select(
        "capture_id", "frame_idx", F.when((cap % 3 == 0) | (k % 5 != 0), k * 250000 + 7).alias("stamp"),
        F.when(cap % 3 == 1, F.lit(0.25)).alias("cad"),
    )
    df = S.frame_offsets(f, ["capture_id"], "stamp", "frame_idx", "cad")
    return out(df, ["capture_id", "frame_idx", "source"], dt_s=c("dt_s"))


_LATS = [0, 10, 20, 30, 45, 60]
_PL_ROWS = ",".join(f"({i},'{p[0]}',{p[1]}e0,{p[2]}e0,{p[3]}e0)" for i, p in enumerate(PL.PLANETS))
_PL_WIND = "CASE i " + " ".join(f"WHEN {i} THEN {wind_sql('lat', p[0])}" for i, p in enumerate(PL.PLANETS)) + " END"
_PAR = "(cos(radians(lat))/sqrt(cos(radians(lat))^2+pow(sin(radians(lat))/(rp/rq),2)))"


@query(
    "m08_filter_gap_plan",
    f"""WITH s AS (SELECT s_suppkey, planet, lat, (80.0e0+s_suppkey%220) AS sc, rq, rp, per, {_PL_WIND} AS u
 FROM supplier JOIN (VALUES {_PL_ROWS}) p(i,planet,rq,rp,per) ON s_suppkey%5=i, (VALUES (0e0),(10e0),(20e0),(30e0),(45e0),(60e0)) l(lat)),
v AS (SELECT *, 360/per+degrees(u*1e-3/rq)/greatest(cos(radians(lat)),0.05e0) AS rate, pi()/180*{_PAR}*sc AS ppd, {_PAR}*rq*1000 AS pm FROM s),
w AS (SELECT *, 1/(rate*ppd) AS direct, 3/(degrees(30.0e0/pm)*ppd) AS polish FROM v)
SELECT s_suppkey, planet, lat, {R('direct', 'direct_s')}, {R('polish', 'polish_s')}, {R('least(polish,4*direct)', 'recommended_s')}, {R('rate*60*ppd', 'px_per_min')} FROM w""",
)
def _(t):
    """Filter-gap plan and smear table per supplier site: planet picked by key, scale from the balance."""
    site = t.supplier.select(
        "s_suppkey", F.element_at(F.array(*[F.lit(p[0]) for p in PL.PLANETS]), (c("s_suppkey") % 5 + 1).cast("int")).alias("planet"),
        (80.0 + c("s_suppkey") % 220).alias("scale"), F.explode(F.array(*[F.lit(float(x)) for x in _LATS])).alias("lat"),
    )
    d = site.join(F.broadcast(PL.planets(t.spark)), "planet").withColumn("u", PL.wind_at("lat"))
    direct = PL.max_span_raw_s("lat", "scale", 1.0, "u")
    polish = PL.max_span_derotated_s("lat", "scale", 3.0)
    return out(
        d, ["s_suppkey", "planet", "lat"], direct_s=direct, polish_s=polish,
        recommended_s=F.least(polish, 4.0 * direct), px_per_min=F.abs(PL.drift_px("lat", 60.0, "scale", "u")),
    )
