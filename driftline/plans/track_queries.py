"""Track, wind and frame-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.angles import FLATTENING
from driftline.operators import skew
from driftline.operators import tracks as TR

from .campaigns import rounded
from .registry import R, query
from .scalars import PAR_SQL, RATE_SQL, c, out, wind_sql

CAP = ["capture_id"]
FRAME = ["capture_id", "frame_idx"]
TK = ["track_ord", "ap_id", "ap_lat", "dt_s"]
BIN = "least(floor(abs(ap_lat)/(90.0e0/11)),10)::INTEGER"
A_EQ = 120.0


@query(
    "p03_track_gate",
    f"""SELECT track_ord, ap_id, ap_lat, dt_s, coalesce(pow((ap_id%100-50)/(60.0e0+1e-12),2)+pow((50-track_ord%100)/(60.0e0*{1 - FLATTENING}e0+1e-12),2)<=0.93
 AND round(abs(dx-0.5e0),9)<=greatest(2.0,0.3e0*0.5e0+1) AND round(abs(dy),9)<=greatest(2.0,0.3e0*0.5e0+1),false) AS pass FROM d_tracks""",
)
def _(t):
    ok = TR.gate_track(
        c("ap_id") % 100, c("track_ord") % 100, 50.0, 50.0, 60.0, F.round(c("dx") - 0.5, 9) + 0.5, F.round("dy", 9), 0.5)
    return t.tracks.select(*TK, ok.alias("pass"))


@query("p04_usable_tracks", "SELECT track_ord, ap_id, ap_lat, dt_s FROM d_tracks WHERE snr>0.05 AND abs(dt_s-240)>1e-9")
def _(t):
    return TR.usable(t.tracks.withColumn("dt_s", c("dt_s") - 240.0)).select(
        "track_ord", "ap_id", "ap_lat", (c("dt_s") + 240.0).alias("dt_s"))


@query("j09_latitude_bins", f"SELECT capture_id, {BIN} AS bin, count(*) AS n FROM d_tracks GROUP BY 1,2")
def _(t):
    return t.tracks.groupBy("capture_id", TR.lat_bin("ap_lat").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "j10_bin_skeleton",
    f"""SELECT k.capture_id, k.bin, coalesce(n,0) AS n FROM (SELECT DISTINCT capture_id, b::INTEGER AS bin FROM d_tracks, (SELECT unnest(range(11)) AS b)) k
LEFT JOIN (SELECT capture_id, {BIN} AS bin, count(*) AS n FROM d_tracks WHERE ap_lat>20 GROUP BY 1,2) USING (capture_id, bin)""",
)
def _(t):
    n = t.tracks.where("ap_lat > 20").groupBy("capture_id", TR.lat_bin("ap_lat").alias("bin")).agg(F.count("*").alias("n"))
    whole = TR.bin_skeleton(t.tracks.select("capture_id").distinct())
    return whole.join(n, ["capture_id", "bin"], "left").select("capture_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


_DU = f"""t0 AS (SELECT capture_id, frame_idx, {BIN} AS bin, radians(-dx/(dt_s*pi()/180*{PAR_SQL}*{A_EQ}e0)-{RATE_SQL})*{PAR_SQL}*71492000.0e0 AS du FROM d_tracks WHERE snr>0.05)"""


def _wind_sql():
    s = f"""{_DU}, s0 AS (SELECT capture_id, bin, median(du) AS med, false AS done FROM t0 GROUP BY 1,2), k0 AS (SELECT *, true AS kept FROM t0)"""
    for i in (0, 1):
        s += f""",
v{i} AS (SELECT k{i}.*, med, done, median(abs(du-med)) FILTER (WHERE kept) OVER (PARTITION BY capture_id, bin) AS mad FROM k{i} JOIN s{i} USING (capture_id, bin)),
u{i} AS (SELECT *, kept AND (done OR abs(du-med)<=3.5*greatest(1.4826e0*mad,1e-6)) AS kept2 FROM v{i}),
k{i + 1} AS (SELECT capture_id, frame_idx, bin, du, kept2 AS kept FROM u{i}),
s{i + 1} AS (SELECT capture_id, bin, CASE WHEN done OR n0=n1 OR n1<3 THEN om ELSE nm END AS med, done OR n0=n1 OR n1<3 AS done FROM
 (SELECT capture_id, bin, bool_or(done) AS done, count(*) FILTER (WHERE kept) AS n0, count(*) FILTER (WHERE kept2) AS n1, any_value(med) AS om, median(du) FILTER (WHERE kept2) AS nm FROM u{i} GROUP BY 1,2))"""
    rate = RATE_SQL.replace("ap_lat", "al")
    par = PAR_SQL.replace("ap_lat", "al")
    s += f""",
fin AS (SELECT capture_id, bin, any_value(med) AS med, median(abs(du-med)) AS mad FROM k2 JOIN s2 USING (capture_id, bin) WHERE kept GROUP BY 1,2),
cnt AS (SELECT capture_id, bin, count(*) AS n_tracks, count(DISTINCT frame_idx) AS n_frames FROM t0 GROUP BY 1,2),
sk AS (SELECT DISTINCT capture_id, b::INTEGER AS bin, (b+0.5e0)*(90.0e0/11) AS al FROM d_tracks, (SELECT unnest(range(11)) AS b)),
wb AS (SELECT capture_id, bin, al AS abs_lat, {rate}+med/(radians({par}*71492000.0e0)) AS rate, 1.4826e0*mad/(radians({par}*71492000.0e0)) AS rate_std, {rate} AS model_rate, med AS resid, 1.4826e0*mad AS resid_std,
 coalesce(n_tracks,0) AS n_tracks, coalesce(n_frames,0) AS n_frames, {par}*71492000.0e0 AS par_m FROM sk LEFT JOIN fin USING (capture_id, bin) LEFT JOIN cnt USING (capture_id, bin))"""
    return s


_WB = _wind_sql()


def wind(t):
    return TR.wind_bins(t.tracks, CAP, "Jupiter", A_EQ)


@query(
    "a31_wind_bins",
    f"""WITH {_WB} SELECT capture_id, bin, n_tracks, n_frames, {R('abs_lat', 'abs_lat')}, {R('rate', 'rate')}, {R('rate_std', 'rate_std')}, {R('model_rate', 'model_rate', 9)}, {R('resid', 'resid', 4)}, {R('resid_std', 'resid_std', 4)} FROM wb""",
)
def _(t):
    w = wind(t).withColumns({"model_rate": F.round("model_rate", 9), "resid": F.round("resid", 4), "resid_std": F.round("resid_std", 4)})
    keys = ["capture_id", "bin", "n_tracks", "n_frames", "model_rate", "resid", "resid_std"]
    return out(w, keys, abs_lat=c("abs_lat"), rate=c("rate"), rate_std=c("rate_std"))


@query("p05_evidence_bins", f"WITH {_WB} SELECT capture_id, bin, {R('greatest(resid_std,1e-9)', 'resid_std', 4)} FROM wb WHERE resid IS NOT NULL AND resid_std IS NOT NULL")
def _(t):
    return out(TR.evidence_bins(wind(t)), ["capture_id", "bin"], 4, resid_std=c("resid_std"))


@query(
    "a32_wind_offsets",
    f"""WITH {_WB}, e AS (SELECT *, degrees(86400.0e0)/par_m AS fac, greatest(resid_std,1e-9) AS s FROM wb WHERE resid IS NOT NULL),
m AS (SELECT capture_id, count(*) AS n_bins, sum(resid/(s*s))/sum(1/(s*s)) AS u0, 1/sqrt(sum(1/(s*s))) AS us, sum(resid*fac/(s*s*fac*fac))/sum(1/(s*s*fac*fac)) AS d0, 1/sqrt(sum(1/(s*s*fac*fac))) AS ds FROM e GROUP BY 1 HAVING count(*)>=2),
x AS (SELECT capture_id, any_value(n_bins) AS n_bins, any_value(u0) AS u0, any_value(us) AS us, any_value(d0) AS d0, any_value(ds) AS ds, sum(pow((resid-u0)/s,2))/greatest(count(*)-1,1) AS ur, sum(pow((resid*fac-d0)/(s*fac),2))/greatest(count(*)-1,1) AS dr FROM e JOIN m USING (capture_id) GROUP BY 1)
SELECT capture_id, n_bins, {R('u0', 'u0_mps', 3)}, {R('us', 'u0_std', 3)}, {R('ur', 'u0_rchi2')}, {R('d0', 'd_omega', 4)}, {R('ds', 'd_omega_std', 4)}, {R('dr', 'd_omega_rchi2')},
 {R('-35729.711e0*d0/(360.0e0/35729.711e0*86400)', 'period_correction_s', 3)}, {R('radians(d0)/86400*71492000.0e0', 'equator_u', 3)}, CASE WHEN dr<ur THEN 'angular' ELSE 'uniform_mps' END AS preferred FROM x""",
)
def _(t):
    o = TR.offsets(wind(t), CAP, "Jupiter")
    r = lambda x, n: F.round(x, n).alias(x)
    return o.select(
        "capture_id", "n_bins", "preferred", r("u0_mps", 3), r("u0_std", 3), r("u0_rchi2", 6), r("d_omega", 4),
        r("d_omega_std", 4), r("d_omega_rchi2", 6), r("period_correction_s", 3), r("equator_u", 3))


@query(
    "a33_profile_summary",
    f"""WITH {_WB} SELECT capture_id, count(*) AS n_bins_total, count(resid) AS n_evidence, {R('sqrt(avg(resid*resid))', 'rms', 3)}, {R('max(abs(resid))', 'max_abs', 3)},
 {R('CASE WHEN count(resid)>=3 THEN corr(model_rate, rate) FILTER (WHERE resid IS NOT NULL) END', 'rate_corr')} FROM wb GROUP BY 1""",
)
def _(t):
    s = TR.profile_summary(wind(t), CAP)
    return s.select(
        "capture_id", "n_bins_total", "n_evidence", F.round("rms", 3).alias("rms"), F.round("max_abs", 3).alias("max_abs"),
        F.round("rate_corr", 6).alias("rate_corr"))


@query(
    "w06_jets",
    f"""WITH {_WB.replace("wb AS (", "wb0 AS (")}, wb AS (SELECT * REPLACE (resid_std*sin(2.0e0*bin) AS resid) FROM wb0), n AS (SELECT *, lag(resid) OVER w AS p, lead(resid) OVER w AS nx FROM wb WINDOW w AS (PARTITION BY capture_id ORDER BY bin)),
j AS (SELECT *, CASE WHEN abs(p-2*resid+nx)>1e-12 THEN least(greatest(0.5*(p-nx)/(p-2*resid+nx),-1),1) ELSE 0 END AS sh FROM n WHERE ((resid>p AND resid>nx) OR (resid<p AND resid<nx)) AND abs(resid)>=0.5*greatest(resid_std,1e-9)),
k AS (SELECT *, resid-0.25*(p-nx)*sh AS pk FROM j),
l AS (SELECT k.capture_id, k.bin, coalesce(max(b.bin) FILTER (WHERE b.bin<k.bin),-1) AS le, coalesce(min(b.bin) FILTER (WHERE b.bin>k.bin),11) AS ri FROM k LEFT JOIN wb b ON b.capture_id=k.capture_id AND coalesce(NOT (b.resid*k.pk>0 AND abs(b.resid)>abs(k.pk/2)),true) GROUP BY 1,2)
SELECT capture_id, bin, {R('abs_lat+sh*90.0e0/11', 'abs_lat', 5)}, {R('pk', 'u_mps', 3)}, {R('greatest(resid_std,1e-9)', 'std_mps', 3)}, {R('abs(pk)/greatest(resid_std,1e-9)', 'significance')},
 CASE WHEN pk>0 THEN 'prograde' ELSE 'retrograde' END AS direction, {R('(ri-le-1)*90.0e0/11', 'fwhm')} FROM k JOIN l USING (capture_id, bin)""",
)
def _(t):
    w = wind(t).withColumn("resid", c("resid_std") * F.sin(2.0 * c("bin")))  # a wavy profile with the measured scatter
    j = TR.jets(w, CAP, 90.0 / 11, 0.5)
    return j.select(
        "capture_id", "bin", "direction", F.round("abs_lat", 5).alias("abs_lat"), F.round("u_mps", 3).alias("u_mps"),
        F.round("std_mps", 3).alias("std_mps"), F.round("significance", 6).alias("significance"), F.round("fwhm", 6).alias("fwhm"))


_DTF = "(frame_idx*15.0e0+15)"
_LIM = f"{RATE_SQL.replace('ap_lat', 'al').replace(wind_sql('abs(al)'), wind_sql('al'))}*{_DTF}*pi()/180*{PAR_SQL.replace('ap_lat', 'al')}*{A_EQ}e0"
_DXP = f"""g AS (SELECT *, {BIN} AS bin FROM d_tracks WHERE snr>0.05),
m1 AS (SELECT capture_id, frame_idx, bin, median(dx) AS med FROM g GROUP BY 1,2,3),
m2 AS (SELECT capture_id, frame_idx, bin, median(abs(dx-med))+1e-9 AS mad FROM g JOIN m1 USING (capture_id, frame_idx, bin) GROUP BY 1,2,3),
m3 AS (SELECT capture_id, frame_idx, bin, coalesce(sum(snr*dx) FILTER (WHERE abs(dx-med)<3*1.4826e0*mad)/sum(snr) FILTER (WHERE abs(dx-med)<3*1.4826e0*mad), any_value(med)) AS v FROM g JOIN m1 USING (capture_id, frame_idx, bin) JOIN m2 USING (capture_id, frame_idx, bin) GROUP BY 1,2,3),
sk AS (SELECT DISTINCT capture_id, frame_idx, b::INTEGER AS bin, (b+0.5e0)*(90.0e0/11) AS al FROM d_tracks, (SELECT unnest(range(11)) AS b)),
c0 AS (SELECT capture_id, frame_idx, bin, v IS NOT NULL AS filled, coalesce(-v, {_LIM}) AS dx, 2*abs({_LIM})+1.5 AS lim FROM sk LEFT JOIN m3 USING (capture_id, frame_idx, bin)),
c1 AS (SELECT *, lag(CASE WHEN filled THEN dx END) OVER w AS l, lead(CASE WHEN filled THEN dx END) OVER w AS r, count(*) FILTER (WHERE filled) OVER (PARTITION BY capture_id, frame_idx) AS nf FROM c0 WINDOW w AS (PARTITION BY capture_id, frame_idx ORDER BY bin)),
c2 AS (SELECT *, CASE WHEN filled AND nf>=3 THEN list_avg([x FOR x IN [l,dx,r] IF x IS NOT NULL]) ELSE dx END AS s FROM c1),
c3 AS (SELECT *, coalesce(median(abs(s)) FILTER (WHERE filled) OVER (PARTITION BY capture_id, frame_idx),0) AS mm, lead(CASE WHEN filled THEN s END) OVER (PARTITION BY capture_id, frame_idx ORDER BY bin) AS sr FROM c2),
c4 AS (SELECT capture_id, frame_idx, bin, filled, s, lim, mm, sr, least(greatest(s,-l0),l0) AS f FROM (SELECT *, CASE WHEN filled THEN greatest(lim,least(2*list_median([x FOR x IN [abs(s),abs(sr)] IF x IS NOT NULL])+1.5,3*mm+1.5)) ELSE lim END AS l0 FROM c3 WHERE bin=0)
 UNION ALL SELECT capture_id, frame_idx, bin, filled, s, lim, mm, sr, least(greatest(s,-l0),l0) FROM (SELECT c3.*, CASE WHEN c3.filled THEN greatest(c3.lim,least(2*list_median([x FOR x IN [abs(c3.s),abs(c3.sr),CASE WHEN c4.filled THEN abs(c4.f) END] IF x IS NOT NULL])+1.5,3*c3.mm+1.5)) ELSE c3.lim END AS l0
 FROM c3 JOIN c4 ON c3.capture_id=c4.capture_id AND c3.frame_idx=c4.frame_idx AND c3.bin=c4.bin+1))"""


def profile(t):
    return TR.dx_profile(t.tracks, FRAME, c("frame_idx") * 15.0 + 15.0, "Jupiter", A_EQ)


@query(
    "a34_dx_profile",
    f"WITH RECURSIVE {_DXP} SELECT capture_id, frame_idx, bin, filled, {R('f', 'dx_apply', 5)} FROM c4",
)
def _(t):
    prof, _shift = profile(t)
    return out(prof, [*FRAME, "bin", "filled"], 5, dx_apply=c("dx_apply"))


@query(
    "w07_three_tap_mean",
    f"WITH {_DXP.split('c3 AS')[0].rstrip().rstrip(',')} SELECT capture_id, frame_idx, bin, {R('s', 'smooth', 5)} FROM c2 WHERE filled",
)
def _(t):
    """Neighbour mean over adjacent filled bins, as windows over the (fixed-size) bins of a frame."""
    from pyspark.sql import Window

    k = [*FRAME, "bin"]
    good = skew.cut(TR.usable(t.tracks).select(*FRAME, TR.lat_bin("ap_lat").alias("bin"), "dx", "snr"))
    r = skew.cut(skew.attach(good, skew.group_median(good, k, "dx", "_med"), k))
    mad = skew.group_median(r.withColumn("_dev", F.abs(c("dx") - c("_med"))), k, "_dev", "_mad")
    w = F.when(F.abs(c("dx") - c("_med")) < 3.0 * 1.4826 * (c("_mad") + 1e-9), c("snr"))
    b = skew.attach(r, mad, k).groupBy(*k).agg((-F.coalesce(F.sum(w * c("dx")) / F.sum(w), F.max("_med"))).alias("v"))
    n = F.count("*").over(Window.partitionBy(*FRAME))
    near = Window.partitionBy(*FRAME).orderBy("bin").rangeBetween(-1, 1)
    s = b.withColumn("s", F.when(n >= 3, F.avg("v").over(near)).otherwise(c("v")))
    return out(s, k, 5, smooth=c("s"))


@query(
    "a34b_dy_shift",
    """WITH g AS (SELECT * FROM d_tracks WHERE snr>0.05), m1 AS (SELECT capture_id, frame_idx, median(dy) AS med FROM g GROUP BY 1,2),
m2 AS (SELECT capture_id, frame_idx, median(abs(dy-med))+1e-9 AS mad FROM g JOIN m1 USING (capture_id, frame_idx) GROUP BY 1,2)
SELECT capture_id, frame_idx, round(-coalesce(avg(dy) FILTER (WHERE abs(dy-med)<3*1.4826e0*mad), any_value(med)),6) AS dy_apply FROM g JOIN m1 USING (capture_id, frame_idx) JOIN m2 USING (capture_id, frame_idx) GROUP BY 1,2""",
)
def _(t):
    _prof, shift = profile(t)
    return out(shift, FRAME, dy_apply=c("dy_apply"))


_XY = "(SELECT capture_id, frame_idx, (ap_id%100)::DOUBLE-50 AS x, (track_ord%90)::DOUBLE-45 AS y, dx, dy FROM d_tracks)"


def xy(t):
    return t.tracks.select(*FRAME, (c("ap_id") % 100).cast("double").alias("x"), (c("track_ord") % 90).cast("double").alias("y"), "dx", "dy")


@query(
    "a35_rigid_rotation",
    f"SELECT capture_id, frame_idx, count(*) AS n, {R('CASE WHEN count(*)>=2 THEN sum(x*dy-y*dx)/sum(x*x+y*y) ELSE 0 END', 'theta', 9)} FROM {_XY} GROUP BY 1,2",
)
def _(t):
    return out(TR.rigid_rotation(xy(t), FRAME, 50.0, 45.0), [*FRAME, "n"], 9, theta=c("theta"))


@query(
    "a47_rotation_residual",
    f"""WITH b AS (SELECT * FROM {_XY} WHERE abs(y)<18), f AS (SELECT capture_id, frame_idx, CASE WHEN count(*)>=2 THEN sum(x*dy-y*dx)/sum(x*x+y*y) ELSE 0 END AS th FROM b GROUP BY 1,2),
r AS (SELECT capture_id, frame_idx, sqrt(avg(pow(dx+th*y,2)+pow(dy-th*x,2)))*90/sqrt(100.0e0*100+90.0e0*90) AS v FROM b JOIN f USING (capture_id, frame_idx) GROUP BY 1,2)
SELECT a.capture_id, a.frame_idx, {R('CASE WHEN n>=3 THEN v END', 'rms_deg')} FROM (SELECT capture_id, frame_idx, count(*) AS n FROM d_tracks GROUP BY 1,2) a LEFT JOIN r USING (capture_id, frame_idx)""",
)
def _(t):
    return out(TR.rotation_residual(xy(t), FRAME, 50.0, 45.0), FRAME, rms_deg=c("rms_deg"))


_FS = """fs AS (SELECT capture_id, frame_idx, sqrt(avg(dx*dx+dy*dy)) AS rms, avg(snr) AS snr, coalesce(-sum(snr*dy) FILTER (WHERE snr>0.05)/sum(snr) FILTER (WHERE snr>0.05),0) AS dy,
 coalesce(-sum(snr*dx) FILTER (WHERE snr>0.05)/sum(snr) FILTER (WHERE snr>0.05),0) AS dx, count(*) AS n FROM d_tracks GROUP BY 1,2)"""


@query(
    "a48_frame_summary",
    f"WITH {_FS} SELECT capture_id, frame_idx, n, {R('rms', 'rms')}, {R('snr', 'snr', 4)}, {R('dy', 'dy')}, {R('dx', 'dx')} FROM fs",
)
def _(t):
    s = TR.frame_summary(t.tracks, FRAME).withColumn("snr", F.round("snr", 4))
    return rounded(s, [*FRAME, "n", "snr"])


@query(
    "a43_fried_parameter",
    """WITH p AS (SELECT capture_id, dx, dy, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ap_id, track_ord, ap_lat, dx) AS o FROM d_tracks) WINDOW w AS (PARTITION BY capture_id ORDER BY o)),
g AS (SELECT capture_id, count(*) AS n, median(sqrt(pow(dx-px,2)+pow(dy-py,2))) AS d, stddev_pop(sqrt(dx*dx+dy*dy)) AS rms FROM p GROUP BY 1)
SELECT capture_id, n, round(d,5) AS d, round(rms,6) AS rms, round(greatest(0.5,d*pow(0.43e0/(rms*rms),0.6e0)),5) AS r0 FROM g""",
)
def _(t):
    tie = F.struct("track_ord", "ap_lat", "dx")
    r = TR.fried_parameter(t.tracks.withColumn("tie", tie), CAP, "ap_id", "tie", 500)
    return r.select("capture_id", "n", F.round("d", 5).alias("d"), F.round("rms", 6).alias("rms"), F.round("r0", 5).alias("r0"))


@query(
    "a40_stack_forensics",
    f"""WITH {_FS}, u AS (SELECT capture_id, frame_idx, n/sum(n) OVER (PARTITION BY capture_id)*CASE WHEN frame_idx%7=0 THEN 0.1e0 ELSE 1 END AS usage, dy, dx FROM fs),
f AS (SELECT *, frame_idx-avg(frame_idx) OVER w AS o, dy-avg(dy) OVER w AS y, dx-avg(dx) OVER w AS x, least(abs(dy-round_even(dy,0)),1-abs(dy-round_even(dy,0))) AS fy, least(abs(dx-round_even(dx,0)),1-abs(dx-round_even(dx,0))) AS fx,
 sqrt(pow(dy-lag(dy) OVER v,2)+pow(dx-lag(dx) OVER v,2)) AS j FROM u WINDOW w AS (PARTITION BY capture_id), v AS (PARTITION BY capture_id ORDER BY frame_idx)),
s AS (SELECT capture_id, sum(o*y)/sum(o*o) AS sy, sum(o*x)/sum(o*o) AS sx FROM f GROUP BY 1),
g AS (SELECT capture_id, count(*) AS n, min(usage) AS usage_min, max(usage) AS usage_max, median(usage) AS usage_median, max(usage)/sum(usage) AS concentration, avg(usage) AS mu, (stddev_pop(fy)+stddev_pop(fx))/2 AS dither,
 sqrt(avg((pow(y-sy*o,2)+pow(x-sx*o,2))/2)) AS wander, coalesce(max(j),0) AS max_jump, any_value(sqrt(sy*sy+sx*sx)) AS slope FROM f JOIN s USING (capture_id) GROUP BY 1)
SELECT capture_id, n, {R('usage_min', 'usage_min')}, {R('usage_max', 'usage_max')}, {R('usage_median', 'usage_median')}, {R('concentration', 'concentration')}, {R('dither', 'dither')}, {R('wander', 'wander')}, {R('max_jump', 'max_jump')}, {R('slope', 'slope', 7)}, {R('sqrt(greatest(n*mu,1e-9))', 'snr_gain')},
 concat_ws(',', CASE WHEN n>=6 AND concentration>0.3 THEN 'one_frame_dominates' END, CASE WHEN n>=6 AND usage_max-usage_min<0.02 THEN 'usage_flat' END, CASE WHEN wander>3 THEN 'wander' END, CASE WHEN max_jump>25 THEN 'jump' END, CASE WHEN usage_min<0.005 AND n>=8 THEN 'unused_frames' END) AS warnings FROM g""",
)
def _(t):
    f = skew.cut(TR.frame_summary(t.tracks, FRAME))
    total = f.groupBy("capture_id").agg(F.sum("n").alias("_t"))
    f = skew.attach(f, total, CAP).withColumn(
        "usage", c("n") / c("_t") * F.when(c("frame_idx") % 7 == 0, F.lit(0.1)).otherwise(F.lit(1.0)))
    r = TR.forensics(f.select(*FRAME, "usage", "dy", "dx"), CAP, "frame_idx").withColumn("slope", F.round("slope", 7))
    return rounded(r, ["capture_id", "n", "warnings", "slope"])


@query(
    "p09_local_shift_trust",
    """SELECT capture_id, track_ord, ap_id, ap_lat, round(CASE WHEN snr>=1.3 AND abs(dx)<=2 AND abs(dy)<=0.5 THEN dx ELSE 0 END,6) AS dx, round(CASE WHEN snr>=1.3 AND abs(dx)<=2 AND abs(dy)<=0.5 THEN dy ELSE 0 END,6) AS dy FROM d_tracks""",
)
def _(t):
    ok = (c("snr") >= 1.3) & (F.abs("dx") <= 2.0) & (F.abs("dy") <= 0.5)
    z = lambda v: F.when(ok, c(v)).otherwise(F.lit(0.0))
    return out(t.tracks, ["capture_id", "track_ord", "ap_id", "ap_lat"], dx=z("dx"), dy=z("dy"))


@query(
    "p10_polish_accept",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a THEN round(d,6) ELSE 0.0 END::DOUBLE AS shift, a AS applied FROM
(SELECT *, (l_discount-0.05e0)*80 AS d, abs(round((l_discount-0.05e0)*80,9))<=3 AND l_tax<0.98e0*0.05e0 AS a FROM lineitem)""",
)
def _(t):
    d = F.round((c("l_discount") - 0.05) * 80.0, 9)
    ok = (F.abs(d) <= 3.0) & (c("l_tax") < 0.98 * 0.05)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(ok, F.round(d, 6)).otherwise(F.lit(0.0)).alias("shift"), ok.alias("applied"))


@query(
    "t01_lucky_frames",
    """WITH s AS (SELECT capture_id, frame_idx, list_sum([x*x FOR x IN data]) AS sharp FROM d_frames), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sharp DESC, frame_idx) AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM s)
SELECT capture_id, frame_idx, r<=least(n,greatest(3,round_even(0.75e0*n,0))) AS kept FROM k""",
)
def _(t):
    s = t.frames.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("sharp"))
    keep = F.least(c("n"), F.greatest(F.lit(3), F.bround(0.75 * c("n")).cast("bigint")))
    return skew.keep_largest(s, CAP, "sharp", "frame_idx", keep).select(*FRAME, "kept")


@query(
    "t02_top_fraction",
    """WITH k AS (SELECT capture_id, track_ord, ap_id, ap_lat, dx, row_number() OVER (PARTITION BY capture_id ORDER BY snr DESC, u DESC) AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM (SELECT *, ap_id*100000000+track_ord*1000+(ap_lat*3+300)::BIGINT AS u FROM d_tracks))
SELECT capture_id, count(*) AS n_kept, sum(track_ord)::BIGINT AS s FROM k WHERE r<=greatest(1,round_even(0.1e0*n,0)) GROUP BY 1""",
)
def _(t):
    d = t.tracks.withColumn("u", -(c("ap_id") * 100000000 + c("track_ord") * 1000 + F.bround(c("ap_lat") * 3 + 300).cast("bigint")))
    k = skew.keep_largest(d, CAP, "snr", "u", F.bround(0.1 * c("n")).cast("bigint")).where("kept")
    return k.groupBy("capture_id").agg(F.count("*").alias("n_kept"), F.sum("track_ord").alias("s"))


_APQ = """q AS (SELECT capture_id, frame_idx, b AS ap, greatest(list_sum(data[b*16+1:b*16+16]),0)::DOUBLE AS q FROM d_frames, (SELECT unnest(range(4)) AS b))"""


def ap_quality(t):
    """Four alignment boxes per frame, quality from their pixel sums."""
    qs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.greatest(
        F.aggregate(F.slice(c("data"), b * 16 + 1, F.lit(16)), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))
    return t.frames.select(*FRAME, F.posexplode(qs).alias("ap", "q"))


def ap_selection(t):
    keep = F.greatest(F.lit(1), F.bround(0.4 * c("n")).cast("bigint"))
    k = skew.keep_largest(ap_quality(t), ["capture_id", "ap"], "q", "frame_idx", keep).where("kept")
    best = k.groupBy("capture_id", "ap").agg(F.max("q").alias("_mx"), F.min_by("frame_idx", F.struct(-c("q"), c("frame_idx"))).alias("_b"))
    k = skew.attach(k, best, ["capture_id", "ap"])
    return k.where((c("q") > 0) | ((c("_mx") <= 0) & (c("frame_idx") == c("_b"))))


@query(
    "t03_per_point_selection",
    f"""WITH {_APQ}, k AS (SELECT *, row_number() OVER (PARTITION BY capture_id, ap ORDER BY q DESC, frame_idx) AS r, count(*) OVER (PARTITION BY capture_id, ap) AS n FROM q)
SELECT capture_id, frame_idx, round(count(*)/4.0,6)::DOUBLE AS used FROM k WHERE r=1 OR (r<=greatest(1,round_even(0.4e0*n,0)) AND q>0) GROUP BY 1,2""",
)
def _(t):
    u = ap_selection(t).groupBy(*FRAME).agg((F.count("*") / 4.0).alias("used"))
    return out(u, FRAME, used=c("used"))


@query(
    "t04_reference_frame",
    """SELECT capture_id, frame_idx, round(sharp,6) AS sharp FROM (SELECT capture_id, frame_idx, list_sum([x*x FOR x IN data]) AS sharp FROM d_frames)
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY sharp DESC, frame_idx)=1""",
)
def _(t):
    s = t.frames.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("sharp"))
    b = s.groupBy("capture_id").agg(F.max_by(F.struct("frame_idx", "sharp"), F.struct(c("sharp"), -c("frame_idx"))).alias("b"))
    return b.select("capture_id", "b.frame_idx", F.round("b.sharp", 6).alias("sharp"))


@query(
    "w05_relative_sharpness",
    """WITH s AS (SELECT capture_id, frame_idx, list_sum([x*x FOR x IN data]) AS sharp FROM d_frames) SELECT capture_id, frame_idx,
 round(sharp/CASE WHEN max(sharp) OVER w<=0 THEN 1 ELSE max(sharp) OVER w END,6) AS relative FROM s WINDOW w AS (PARTITION BY capture_id)""",
)
def _(t):
    s = t.frames.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("sharp"))
    top = s.groupBy("capture_id").agg(F.max("sharp").alias("_mx"))
    r = skew.attach(s, top, CAP)
    return out(r, FRAME, relative=c("sharp") / F.when(c("_mx") <= 0, F.lit(1.0)).otherwise(c("_mx")))


@query(
    "u03_keep_fractions",
    """WITH s AS (SELECT capture_id, frame_idx, list_sum([x*x FOR x IN data]) AS sharp FROM d_frames), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sharp DESC, frame_idx) AS r, count(*) OVER (PARTITION BY capture_id) AS n FROM s)
SELECT capture_id, fraction, count(*) AS n_used FROM k, (VALUES (0.5e0),(0.25e0),(0.1e0)) v(fraction) WHERE r<=greatest(1,round_even(fraction*n,0)) GROUP BY 1,2""",
)
def _(t):
    s = t.frames.select(*FRAME, F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x).alias("sharp"))
    fr = F.array_distinct(F.array(*[F.lit(x) for x in (0.5, 0.25, 0.5, 0.1)]))
    s = s.select("*", F.posexplode(fr).alias("_o", "fraction"))
    k = skew.keep_largest(s, ["capture_id", "fraction"], "sharp", "frame_idx", F.bround(c("fraction") * c("n")).cast("bigint"))
    return k.where("kept").groupBy("capture_id", "fraction").agg(F.count("*").alias("n_used"))
