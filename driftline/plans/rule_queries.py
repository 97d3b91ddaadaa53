"""Rule, grade and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import optics as O
from driftline.operators import circular as C
from driftline.operators import rules as RU
from driftline.operators import skew

from .campaigns import rounded
from .consensus import CASE, HALF, cmean, role_rows, role_rows_sql
from .registry import D, R, W, query
from .scalars import c, out, sky_sql

L0 = A.FEATURE_LAT
CORE, WIDE = f"coalesce(lat BETWEEN {L0 - 8} AND {L0 + 4},false)", f"coalesce(lat BETWEEN {L0 - 16} AND {L0 + 10},false)"
TRUST = "cm_source IN ('spice_auto','horizons','user_cm')"


def fl(*items):
    return "concat_ws(','," + ",".join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond in items) + ")"


def job_cols(t):
    return t.jobs.withColumnsRenamed({"lon": "pub_lon", "lat": "pub_lat"})


_G1 = f"""a AS (SELECT *, {CORE} AS core, {WIDE} AS wide, {TRUST} AS tr, abs({D('lon', 'pipe_lon')}) AS dpp FROM d_jobs),
b AS (SELECT *, orange_ok AND NOT orange_near_limb AND core AND (contains(definition,'ORANGE') OR abs({D('lon', 'orange_lon')})<3) AS seed FROM a),
f AS (SELECT *, {fl(('CM_UNTRUSTED', 'NOT tr'), ('LAT_OUT_OF_BAND', 'NOT wide'), ('LAT_OUTSIDE_CORE', 'wide AND NOT core'), ('LIMB_SPREAD_FAIL', 'limb>10'), ('LIMB_SPREAD_WARN', 'limb>2.5 AND limb<=10'),
 ('DEFINITION_SCATTER_FAIL', 'def_spread>40 AND NOT seed'), ('DEFINITION_SCATTER_WARN', 'def_spread>12 AND (def_spread<=40 OR seed)'), ('PUBLISH_VS_PIPE_FAIL', 'dpp>30 AND NOT seed'), ('TIMING_UNCERTAINTY_HIGH', 'time_err/60*870.536e0/1440>0.6'))} AS flags FROM b),
g AS (SELECT *, contains(flags,'LAT_OUT_OF_BAND') OR contains(flags,'PUBLISH_VS_PIPE_FAIL') OR contains(flags,'DEFINITION_SCATTER_FAIL') AS hard, contains(flags,'LIMB_SPREAD_FAIL') OR contains(flags,'LAT_OUTSIDE_CORE') AS soft FROM f),
pq AS (SELECT *, tr AND NOT hard AND core AND wide AND (seed OR NOT soft) AS absolute_ok, (NOT hard AND core) OR seed AS publish_ok,
 CASE WHEN hard OR NOT wide THEN 'REJECT' WHEN seed AND core AND tr THEN CASE WHEN soft THEN 'CAUTION' ELSE 'GOOD' END
 WHEN soft OR NOT tr OR contains(flags,'LAT_OUTSIDE_CORE') OR contains(flags,'LIMB_SPREAD_WARN') THEN 'CAUTION' WHEN flags<>'' THEN 'FAIR' ELSE 'GOOD' END AS grade FROM g)"""


@query(
    "g01_publish_quality",
    f"WITH {_G1} SELECT job_id, flags, absolute_ok, publish_ok, grade, {R('dpp', 'publish_vs_pipeline')} FROM pq",
)
def _(t):
    q = RU.publish_quality(job_cols(t)).withColumn("flags", F.array_join("flags", ","))
    return out(q, ["job_id", "flags", "absolute_ok", "publish_ok", "grade"], publish_vs_pipeline=c("publish_vs_pipeline"))


@query("n03_flag_lists", f"""WITH {_G1} SELECT job_id, len([x FOR x IN string_split(flags,',') IF x<>''])::INTEGER AS n_flags, contains(flags,'LIMB_SPREAD_WARN') OR contains(flags,'CM_UNTRUSTED') AS soft,
 coalesce(array_to_string([x FOR x IN string_split(flags,',') IF x<>'CM_UNTRUSTED'],','),'') AS without_cm FROM pq""")
def _(t):
    q = RU.publish_quality(job_cols(t))
    return q.select(
        "job_id", F.size("flags").alias("n_flags"), RU.has("flags", "LIMB_SPREAD_WARN", "CM_UNTRUSTED").alias("soft"),
        F.array_join(F.array_except("flags", F.array(F.lit("CM_UNTRUSTED"))), ",").alias("without_cm"))


_CAND = f"""cd AS (SELECT job_id, 0 AS o, 'UNBEATABLE_AUTO' AS definition, lon+1 AS clon, lat AS lat, cm, pipe_lon FROM d_jobs WHERE job_id%8=0
 UNION ALL SELECT job_id, 1, 'GS-ORANGE', orange_lon, lat-1, cm, pipe_lon FROM d_jobs WHERE orange_ok AND NOT orange_near_limb
 UNION ALL SELECT job_id, 2, 'GS-MAP', lon, lat, cm, pipe_lon FROM d_jobs WHERE n_in>3
 UNION ALL SELECT job_id, 3, 'GS-BARY', pipe_lon, lat+0.5e0, cm, pipe_lon FROM d_jobs),
sc AS (SELECT *, CASE WHEN {CORE} THEN 100 WHEN {WIDE} THEN 40 ELSE -80 END + CASE WHEN abs({D('clon', 'cm')})>75 THEN -50 WHEN abs({D('clon', 'cm')})>55 THEN -20 ELSE 10 END
 + CASE definition WHEN 'GS-ORANGE' THEN 45 WHEN 'UNBEATABLE_AUTO' THEN 50 WHEN 'GS-MAP' THEN 25 ELSE 5 END + CASE WHEN {CORE} AND abs({D('clon', 'pipe_lon')})<=30 THEN 15 ELSE 0 END AS score FROM cd WHERE clon IS NOT NULL)"""


@query(
    "g02_candidate_choice",
    f"WITH {_CAND} SELECT job_id, definition, {R('clon', 'lon')}, {R('lat', 'lat')}, score::DOUBLE AS score FROM sc QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, o)=1",
)
def _(t):
    j = t.jobs
    s = lambda o, d, lon, lat, w: j.where(w).select(
        "job_id", F.lit(o).alias("o"), F.lit(d).alias("definition"), lon.alias("lon"), lat.alias("lat"), "cm", "pipe_lon")
    cands = (
        s(0, "UNBEATABLE_AUTO", c("lon") + 1, c("lat"), c("job_id") % 8 == 0)
        .unionByName(s(1, "GS-ORANGE", c("orange_lon"), c("lat") - 1, c("orange_ok") & ~c("orange_near_limb")))
        .unionByName(s(2, "GS-MAP", c("lon"), c("lat"), c("n_in") > 3))
        .unionByName(s(3, "GS-BARY", c("pipe_lon"), c("lat") + 0.5, F.lit(True)))
    )
    return out(RU.best_candidate(cands, ["job_id"], "o"), ["job_id", "definition", "score"], lon=c("lon"), lat=c("lat"))


_EQ = f"""e AS (SELECT *, {sky_sql(D('lon', 'manual_lon'), '(coalesce(lat-manual_lat,0))', '(coalesce(manual_lat,lat,-22))', 'distance_au').replace('coalesce(manual_lat,lat,-22)', 'coalesce(manual_lat,lat,-22.0e0)')} AS sky FROM d_jobs)"""


@query(
    "g03_manual_agreement",
    f"""WITH {_EQ} SELECT job_id, {R('sky', 'sky')}, CASE WHEN sky IS NULL THEN 'NO_MANUAL_PICK' WHEN sky<=1 AND cm_source IN ('spice_auto','horizons') THEN 'EQUAL' WHEN sky<=1 THEN 'MATCH_FEATURE_CM_WEAK'
 WHEN sky<=2 THEN 'NEAR' WHEN sky<=5 THEN 'FAIR' ELSE 'DIFFERENT' END AS agreement FROM e""",
)
def _(t):
    d = RU.pair_difference("lon", "lat", "manual_lon", "manual_lat", "distance_au")
    df = t.jobs.withColumn("sky", d["sky"])
    return out(df.withColumn("agreement", RU.manual_agreement(c("sky"), "cm_source")), ["job_id", "agreement"], sky=c("sky"))


@query(
    "g10_agreement_class",
    f"WITH {_EQ} SELECT job_id, CASE WHEN sky<=1 THEN 'MATCH' WHEN sky<=2 THEN 'NEAR' WHEN sky<=5 THEN 'FAIR' WHEN sky IS NOT NULL THEN 'DIFFERENT' END AS agreement FROM e",
)
def _(t):
    d = RU.pair_difference("lon", "lat", "manual_lon", "manual_lat", "distance_au")
    return t.jobs.withColumn("sky", d["sky"]).select("job_id", RU.agreement_class(c("sky")).alias("agreement"))


@query(
    "j08_probe_pairs",
    f"""WITH b AS (SELECT * FROM {role_rows_sql(HALF)}), o AS (SELECT * FROM b WHERE role='moment'), i AS (SELECT case_id, lon AS il, lat AS ia, length AS ir FROM b WHERE role='template')
SELECT case_id, {R(D('lon', 'il'), 'dlon')}, {R('lat-ia', 'dlat')}, {R(sky_sql(D('lon', 'il'), '(lat-ia)', 'ia', '5.2e0'), 'sky')}, {R('length-ir', 'radius_delta')} FROM o JOIN i USING (case_id)""",
)
def _(t):
    probes = role_rows(t, HALF)  # the outer and the inner half of the methods
    role = lambda m, **names: probes.where(c("role") == m).select("case_id", *[c(k).alias(v) for k, v in names.items()])
    p = role("moment", lon="ol", lat="oa", length="orad").join(role("template", lon="il", lat="ia", length="irad"), "case_id")
    d = RU.pair_difference("ol", "oa", "il", "ia", 5.2)
    return out(p, CASE, dlon=d["dlon"], dlat=d["dlat"], sky=d["sky"], radius_delta=c("orad") - c("irad"))


_NEAR = f"coalesce(abs({D('lon', 'pipe_lon')})<15,false)"
_DP, _REL = f"abs({D('lon', 'pipe_lon')})", f"abs({D('lon', 'cm')})"
_PRO = "cm_source IN ('spice_auto','horizons')"
_G4R = [
    ("PIPELINE_AGREE", f"{_DP}<8", "12"), ("PIPELINE_NEAR", f"{_DP}>=8 AND {_DP}<15", "6"), ("PIPELINE_DISAGREE", f"{_DP}>30", "-25"),
    ("LOW_INLIERS", "n_in<4", "-25"), ("MODERATE_INLIERS", "n_in>=4 AND n_in<8", "-8"), ("MULTI_CLUSTER", "n_clusters>=3", f"(CASE WHEN {_NEAR} THEN -6 ELSE -12 END)"),
    ("MANY_OUTLIERS", f"n_out>n_in AND n_in<12 AND NOT {_NEAR}", "-12"), ("HIGH_LON_SCATTER", "sig_lon>1.5", "-18"), ("MED_LON_SCATTER", "sig_lon>0.6 AND sig_lon<=1.5", "-6"),
    ("HIGH_LAT_SCATTER", "sig_lat>1.0", "-10"), ("LAT_OFF_BAND", "abs(la+22)>6", "-25"), ("LAT_MARGINAL", "abs(la+22)>3.5 AND abs(la+22)<=6", "-8"),
    ("NEAR_LIMB", f"{_REL}>70", "-12"), ("OFF_CM", f"{_REL}>50 AND {_REL}<=70", "-6"), ("WEAK_CM_SOURCE", f"NOT {_PRO}", "-10"), ("NO_TIME", "NOT has_time", "-12"),
    ("LARGE_TIME_ERROR", "has_time AND time_err>30", "-10"), ("LARGE_PIPELINE_SIGMA", "pipe_sky>3", "-12"),
    ("PIPELINE_NEEDS_WORK", "pipe_grade='NEEDS_WORK'", f"(CASE WHEN {_NEAR} THEN -12 ELSE -20 END)"), ("SMALL_DISK_PX", "a_eq<40", "-15"),
]
_G4S = "+".join(f"CASE WHEN {cond} THEN {p} ELSE 0 END" for _, cond, p in _G4R)
_G4 = f"""jb AS (SELECT *, coalesce(lat,-22.0e0) AS la, round(sig_lon,6) AS sl FROM d_jobs),
s0 AS (SELECT *, {fl(*[(n, cond) for n, cond, _ in _G4R])} AS flags, {_NEAR} AS near, least(greatest(100.0+{_G4S}+CASE WHEN {_PRO} THEN 5 ELSE 0 END+CASE WHEN pipe_sky<=1 THEN 5 ELSE 0 END
 +CASE WHEN pipe_grade='RESEARCH_FAIR' THEN -6 ELSE 0 END+CASE WHEN a_eq>80 THEN 3 ELSE 0 END,0),100) AS s FROM jb),
s1 AS (SELECT *, least(s, CASE WHEN contains(flags,'PIPELINE_NEEDS_WORK') OR contains(flags,'NEAR_LIMB') THEN 68 ELSE 100 END, CASE WHEN contains(flags,'LARGE_PIPELINE_SIGMA') THEN 72 ELSE 100 END,
 CASE WHEN contains(flags,'PIPELINE_DISAGREE') THEN 45 ELSE 100 END, CASE WHEN contains(flags,'MULTI_CLUSTER') AND NOT contains(flags,'PIPELINE_AGREE') THEN 69 ELSE 100 END) AS cs FROM s0),
s2 AS (SELECT *, CASE WHEN near AND NOT contains(flags,'LAT_OFF_BAND') AND n_in>=4 THEN greatest(cs, CASE WHEN contains(flags,'NEAR_LIMB') OR contains(flags,'PIPELINE_NEEDS_WORK') THEN 42 ELSE 50 END) ELSE cs END AS score FROM s1)"""


@query(
    "g04_suite_quality",
    f"""WITH {_G4} SELECT job_id, flags, score::DOUBLE AS score, CASE WHEN score>=85 AND NOT regexp_matches(flags,'PIPELINE_NEEDS_WORK|NEAR_LIMB|LAT_OFF_BAND|HIGH_LON_SCATTER|MULTI_CLUSTER|PIPELINE_DISAGREE|LARGE_PIPELINE_SIGMA') AND n_in>=10 THEN 'EXCELLENT'
 WHEN score>=70 THEN 'GOOD' WHEN score>=55 THEN 'FAIR' WHEN score>=40 THEN 'MARGINAL' ELSE 'POOR' END AS grade FROM s2""",
)
def _(t):
    q = RU.suite_quality(t.jobs.withColumn("lat", F.coalesce("lat", F.lit(-22.0))))
    return q.select("job_id", F.array_join("flags", ",").alias("flags"), "score", "grade")


_LOCK = [
    ("trusted_cm", TRUST), ("cm_crosscheck", "dcm IS NULL OR dcm<=0.35"), ("finite_pos", "lon IS NOT NULL AND lat IS NOT NULL"), ("lat_core", "lat BETWEEN -28 AND -16"),
    ("no_map_edge", "job_id%12<>0"), ("limb_stable", "limb<=1.35"), ("def_tight", "sig_lon<=1.0"), ("dark_core", "dark>=0.12"), ("nav_stable", "job_id%4<>0"), ("dual_agree", "job_id%6<>0"),
    ("score_high", "score>=88"), ("gs_or_strong", "job_id%2=0 OR score>=92"), ("sigma_sky_tight", "pipe_sky<=2.5"),
]
_LJ = "(SELECT *, CASE WHEN job_id%3=0 THEN (job_id%7)*0.1e0 END AS dcm, (job_id%10)*0.05e0 AS dark, 80.0e0+job_id%20 AS score FROM d_jobs)"


def lock_jobs(t):
    k = c("job_id")
    return t.jobs.withColumns({
        "dcm": F.when(k % 3 == 0, (k % 7) * 0.1), "dark": (k % 10) * 0.05, "score": 80.0 + k % 20,
        "job_flags": F.when(k % 12 == 0, F.array(F.lit("FINAL_MAP_EDGE"))).otherwise(F.array().cast("array<string>")),
        "sig_def": c("sig_lon"), "nav_stable": k % 4 != 0, "dual_agree": k % 6 != 0, "gs_lock": k % 2 == 0, "sigma_sky": c("pipe_sky"),
    })


_NP = "+".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for _, x in _LOCK)


@query(
    "g05_lock_gates",
    f"SELECT job_id, concat_ws(',',{','.join(f'CASE WHEN NOT coalesce({x},false) THEN {chr(39)}{n}{chr(39)} END' for n, x in _LOCK)}) AS failed, ({_NP})::INTEGER AS n_pass, 13 AS n_total, ({_NP})=13 AS locked FROM {_LJ}",
)
def _(t):
    df = lock_jobs(t).withColumn("_g", RU.gate_table(RU.lock_checks()))
    return RU.gate_summary(df, c("_g"), list(RU.lock_checks())).select("job_id", "failed", "n_pass", "n_total", "locked")


@query("n04_gate_counts", f"SELECT n_pass, count(*) AS n_jobs FROM (SELECT ({_NP})::INTEGER AS n_pass FROM {_LJ}) GROUP BY 1")
def _(t):
    df = lock_jobs(t).withColumn("_g", RU.gate_table(RU.lock_checks()))
    return RU.gate_summary(df, c("_g"), list(RU.lock_checks())).groupBy("n_pass").agg(F.count("*").alias("n_jobs"))


_G6R = [
    ("CM_WEAK", "cm_source IN ('analytical','unknown')", -40), ("CM_UNTRUSTED", "cm_source='user_cm' AND job_id%2=0", -25), ("LIMB_UNSTABLE", "limb>5", -20),
    ("LIMB_ELEVATED", "limb>2.5 AND limb<=5", -8), ("DEFINITION_SCATTER", "def_spread>12", -15), ("LAT_OUT_OF_BAND", "NOT lat BETWEEN -36 AND -10", -30),
    ("MATCHES_MANUAL", "pipe_sky<=1", 5), ("DIFFERS_FROM_MANUAL", "pipe_sky>5", -10),
]
_G6S = "+".join(f"CASE WHEN {x} THEN {p} ELSE 0 END" for _, x, p in _G6R)


@query(
    "g06_desk_grade",
    f"""SELECT job_id, flags, score::DOUBLE AS score, CASE WHEN score>=85 AND NOT regexp_matches(flags,'CM_WEAK|LAT_OUT_OF_BAND') THEN 'DESK_EXCELLENT' WHEN score>=70 THEN 'DESK_GOOD' WHEN score>=50 THEN 'DESK_FAIR' ELSE 'DESK_HOLD' END AS desk_grade
FROM (SELECT job_id, {fl(*[(n, x) for n, x, _ in _G6R])} AS flags, least(greatest(100.0+{_G6S},0),100) AS score FROM d_jobs)""",
)
def _(t):
    df = t.jobs.withColumns({"cm_trusted": c("job_id") % 2 != 0, "sky_manual": c("pipe_sky")})
    return RU.desk_grade(df).select("job_id", F.array_join("flags", ",").alias("flags"), "score", "desk_grade")


@query(
    "g07_budget_grade",
    """SELECT job_id, CASE WHEN pipe_sky<=greatest(0.35,0.15,2*f) AND coalesce(def_spread*0.05e0,99)<=0.8 THEN 'METHOD_EXCELLENT' WHEN pipe_sky<=1 AND coalesce(def_spread*0.05e0,99)<=1.5 THEN 'METHOD_GOOD'
 WHEN pipe_sky<=2 THEN 'RESEARCH_GOOD' WHEN pipe_sky<=5 THEN 'RESEARCH_FAIR' ELSE 'NEEDS_WORK' END AS grade FROM (SELECT *, 206265.0e0*550e-9/0.35e0 AS f FROM d_jobs)""",
)
def _(t):
    g = RU.budget_grade("pipe_sky", c("def_spread") * 0.05, O.diffraction_floor_arcsec(550.0, 0.35))
    return t.jobs.select("job_id", g.alias("grade"))


_S = lambda *x: "sqrt(" + "+".join(f"pow({v},2)" for v in x) + ")"


@query(
    "g09_position_sigma",
    f"""SELECT job_id, {R(_S('sig_lon', 'time_err*0.01e0', 'limb*0.1e0', 'def_spread*0.02e0', 'greatest(sig_lon*0.1e0,0.05)'), 'sigma_lon')}, {R(_S('limb*0.05e0', 'greatest(sig_lat*0.1e0,0.05)', '0.12e0'), 'sigma_lat')} FROM d_jobs""",
)
def _(t):
    a, b = RU.position_sigma(
        "sig_lon", c("time_err") * 0.01, c("limb") * 0.1, c("limb") * 0.05, c("def_spread") * 0.02, c("sig_lon") * 0.1,
        c("sig_lat") * 0.1)
    return out(t.jobs, ["job_id"], sigma_lon=a, sigma_lat=b)


_PP = "degrees(1/(a_eq+1e-12))"
_BUD = f"""b AS (SELECT *, {_PP}*sqrt(pow(sig_lon,2)+pow(0.5*sig_lat,2))/0.7 AS nl, {_PP}*sqrt(pow(sig_lat,2)+pow(0.5*sig_lat,2)) AS na, time_err*360/35729.711e0 AS tl, pipe_sky*0.2e0 AS sc, n_in*0.01e0 AS rl, n_out*0.01e0 AS ra, sig_lon*0.3e0 AS dl, sig_lat*0.3e0 AS da, coalesce(lat,-22.0e0) AS la FROM d_jobs),
d AS (SELECT *, {_S('dl', 'nl', 'tl', 'sc', '0.05e0')} AS yl, {_S('da', 'na', '0.04e0')} AS ya FROM b),
e AS (SELECT *, {sky_sql('rl', 'ra', 'la', 'distance_au')} AS sr, {sky_sql('yl', 'ya', 'la', 'distance_au')} AS sy, {sky_sql('nl', 'na', 'la', 'distance_au')} AS sn, {sky_sql('tl', '0', 'la', 'distance_au')} AS st, coalesce(limb,0)*0.1e0 AS cl FROM d)"""


@query(
    "a22_error_budget",
    f"""WITH {_BUD} SELECT job_id, {R(_S('rl', 'dl', 'nl', 'tl', 'sc', '0.05e0'), 'total_lon')}, {R(_S('ra', 'da', 'na', '0.04e0'), 'total_lat')}, {R('sr', 'sky_random')}, {R('sy', 'sky_system')}, {R('sn', 'sky_nav')}, {R('st', 'sky_time')},
 {R('CASE WHEN cl>0 THEN sqrt(sr*sr+sy*sy+0.25*cl*cl) ELSE sqrt(sr*sr+sy*sy) END', 'sky_total')} FROM e""",
)
def _(t):
    df = t.jobs.withColumns({
        "lat": F.coalesce("lat", F.lit(-22.0)), "sigma_xc": c("sig_lon"), "sigma_yc": c("sig_lat"), "sigma_a": c("sig_lat"),
        "sigma_cm": c("pipe_sky") * 0.2, "rand_lon": c("n_in") * 0.01, "rand_lat": c("n_out") * 0.01, "def_lon": c("sig_lon") * 0.3,
        "def_lat": c("sig_lat") * 0.3, "bias_lon": F.lit(0.05), "bias_lat": F.lit(0.04), "closure_sky": F.coalesce("limb", F.lit(0.0)) * 0.1,
    })
    names = ("total_lon", "total_lat", "sky_random", "sky_system", "sky_nav", "sky_time", "sky_total")
    return out(RU.error_budget(df), ["job_id"], **{n: c(n) for n in names})


@query(
    "a18_spread_flags",
    f"""WITH d AS (SELECT case_id, {D('lon', '(case_id%360)')}*0.05e0 AS dl, (lat+19.8e0)*0.05e0 AS da FROM d_good), g AS (SELECT case_id, count(*) AS n, stddev_samp(dl) AS sl, stddev_samp(da) AS sa, max(abs(dl)) AS ml FROM d GROUP BY 1)
SELECT case_id, n, {R('sl', 'sigma_lon')}, {R('sa', 'sigma_lat')}, {R('ml', 'max_dlon')}, CASE WHEN n>=3 THEN sl<=0.55 AND ml<=1.4 AND sa<=0.45 END AS stable FROM g""",
)
def _(t):
    g = RU.spread_flags(t.good_hits, CASE, A.wrap_diff("lon", c("case_id") % 360) * 0.05, (c("lat") + 19.8) * 0.05, "ord")
    return rounded(g, ["case_id", "n", "stable"])


@query(
    "a19_sample_summary",
    f"""WITH m AS (SELECT series_id, {cmean('lon')} AS mean_lon, degrees(sqrt(-2*ln(least(greatest(sqrt(pow(avg(cos(radians(lon))),2)+pow(avg(sin(radians(lon))),2)),1e-12),1)))) AS std_lon, avg(lat) AS mean_lat, stddev_samp(lat) AS std_lat FROM d_steady GROUP BY 1)
SELECT series_id, {R('any_value(mean_lon)', 'mean_lon')}, {R('any_value(std_lon)', 'std_lon')}, {R('any_value(mean_lat)', 'mean_lat')}, {R('any_value(std_lat)', 'std_lat')}, {R('quantile_cont(' + D('lon', 'mean_lon') + ',0.16)', 'p16')}, {R('quantile_cont(' + D('lon', 'mean_lon') + ',0.84)', 'p84')},
 any_value(std_lon)<=5 AS on_target, {R('covar_samp(' + D('lon', 'mean_lon') + ',lat)', 'cov_d_lat')}, {R('covar_samp(' + D('lon', 'mean_lon') + ',sigma)', 'cov_d_sigma')}, {R('covar_samp(lat,sigma)', 'cov_lat_sigma')}, {R('var_samp(sigma)', 'cov_sigma_sigma')} FROM d_steady JOIN m USING (series_id) GROUP BY 1""",
)
def _(t):
    k = ["series_id"]
    m = t.steady.groupBy(*k).agg(
        C.circular_mean("lon").alias("mean_lon"), C.circular_std_deg("lon").alias("std_lon"), F.avg("lat").alias("mean_lat"),
        F.stddev_samp("lat").alias("std_lat"))
    r = skew.cut(skew.attach(t.steady, m, k).withColumn("d", A.wrap_diff("lon", "mean_lon")))
    q = skew.group_quantiles(r, k, "d", {"p16": 0.16, "p84": 0.84}).drop("n")
    cov = RU.samples_covariance(r, k, ["d", "lat", "sigma"])
    s = m.join(q, k).join(cov, k).withColumn("on_target", c("std_lon") <= 5.0)
    names = ["mean_lon", "std_lon", "mean_lat", "std_lat", "p16", "p84", "cov_d_lat", "cov_d_sigma", "cov_lat_sigma", "cov_sigma_sigma"]
    return out(s, ["series_id", "on_target"], **{n: c(n) for n in names})


_INJ = f"tr AS (SELECT series_id, ord, {D('lon', '(series_id*7)')} AS dlon, lat+19.8e0 AS dlat FROM d_steady)"


@query("p08_injection_trials", f"WITH {_INJ} SELECT series_id, ord FROM tr WHERE abs(dlon)<=10 AND abs(dlat)<=6")
def _(t):
    d = t.steady.withColumn("dlon", A.wrap_diff("lon", c("series_id") * 7))
    return d.where((F.abs("dlon") <= 10) & (F.abs(c("lat") + 19.8) <= 6)).select("series_id", "ord")


@query(
    "a20_injection_bias",
    f"""WITH {_INJ}, k AS (SELECT *, {sky_sql('dlon', 'dlat', '(-19.8e0)', '5.2e0')} AS sky FROM tr WHERE abs(dlon)<=10 AND abs(dlat)<=6), g AS (SELECT series_id, count(*) AS n, avg(dlon) AS bl, avg(dlat) AS ba, stddev_samp(dlon) AS sl, avg(sky) AS sk FROM k GROUP BY 1)
SELECT series_id, n, {R('CASE WHEN n<5 THEN 0 ELSE bl END', 'bias_lon')}, {R('CASE WHEN n<5 THEN 0 ELSE ba END', 'bias_lat')}, {R('CASE WHEN n>=5 THEN sl END', 'scatter_lon')}, {R('CASE WHEN n>=5 THEN sk END', 'mean_sky')} FROM g""",
)
def _(t):
    d = t.steady.select("series_id", A.wrap_diff("lon", c("series_id") * 7).alias("dlon"), (c("lat") + 19.8).alias("dlat"))
    d = d.where((F.abs("dlon") <= 10) & (F.abs("dlat") <= 6)).withColumn("sky", A.sky_error_arcsec("dlon", "dlat", -19.8, 5.2))
    return rounded(RU.injection_bias(d, ["series_id"]), ["series_id", "n"])


_FILT = {"click": ("R", 620.0), "view": ("G", 530.0), "error": ("B", 470.0), "purchase": ("IR742", 742.0), "signup": ("IR685", 685.0)}


@query(
    "a21_filter_closure",
    f"""WITH f AS (SELECT case_id, {'CASE family ' + ' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _FILT.items()) + ' END'} AS filter, {'CASE family ' + ' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_FILT)) + ' END'} AS rank,
 {'CASE family ' + ' '.join(f"WHEN '{k}' THEN {v[1]}e0" for k, v in _FILT.items()) + ' END'} AS lam, lon, lat FROM d_good QUALIFY row_number() OVER (PARTITION BY case_id, family ORDER BY ord)=1),
p AS (SELECT case_id, lon AS pl, lat AS pa FROM f QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN filter='G' THEN -1 ELSE rank END)=1),
d AS (SELECT case_id, 1e6/(lam*lam) AS x, {D('lon', 'pl')} AS yl, lat-pa AS ya, lat FROM f JOIN p USING (case_id)),
c AS (SELECT case_id, count(*) AS n, avg(x) AS mx, avg(yl) AS ml, avg(ya) AS ma, avg(lat) AS l0, coalesce(regr_slope(yl,x),0) AS bl, coalesce(regr_slope(ya,x),0) AS ba FROM d GROUP BY 1 HAVING count(*)>=2),
r AS (SELECT case_id, any_value(n) AS n, any_value(l0) AS l0, stddev_samp(yl-ml-bl*(x-mx)) AS rl, stddev_samp(ya-ma-ba*(x-mx)) AS ra FROM d JOIN c USING (case_id) GROUP BY 1)
SELECT case_id, n, {R('rl', 'res_lon')}, {R('ra', 'res_lat')}, {R(sky_sql('rl', 'ra', 'l0', '5.2e0'), 'closure_sky')} FROM r""",
)
def _(t):
    m = F.create_map(*[x for i, (k, (f, lam)) in enumerate(_FILT.items()) for x in (
        F.lit(k), F.struct(F.lit(f).alias("filter"), F.lit(i).alias("rank"), F.lit(lam).alias("lam")))])
    one = t.good_hits.groupBy("case_id", "family").agg(F.min_by(F.struct("lon", "lat"), "ord").alias("p"))
    one = one.select("case_id", m[c("family")].alias("f"), "p").select("case_id", "f.*", "p.*")
    return rounded(RU.filter_closure(one, CASE, 5.2), ["case_id", "n"])


@query(
    "a44_method_difficulty",
    f"""WITH m AS (SELECT case_id, {cmean('lon')} AS cm FROM d_good GROUP BY 1),
s AS (SELECT case_id, CASE WHEN count(*)>=5 THEN quantile_cont({D('lon', 'cm')},0.9)-quantile_cont({D('lon', 'cm')},0.1) END AS span FROM d_good JOIN m USING (case_id) GROUP BY 1),
o AS (SELECT case_id, count(*) FILTER (WHERE ok) AS n_in, count(*) FILTER (WHERE NOT ok) AS n_out, (case_id%30)*0.05e0 AS sl, (case_id%20)*0.05e0 AS sa, -22.0e0+(case_id%11-5) AS la, ['GOOD','FAIR','POOR'][case_id%3+1] AS g FROM d_hits GROUP BY case_id)
SELECT case_id, {R('span', 'span', 5)}, {R('''least(greatest(CASE WHEN n_in<8 THEN 0.35 WHEN n_in<15 THEN 0.15 ELSE 0 END+CASE WHEN sl>1 THEN 0.35 WHEN sl>0.4 THEN 0.15 ELSE 0 END+CASE WHEN sa>0.8 THEN 0.15 ELSE 0 END+CASE WHEN abs(la+22)>4 THEN 0.25 ELSE 0 END
 +CASE WHEN g='POOR' THEN 0.2 WHEN g='FAIR' THEN 0.1 ELSE 0 END+CASE WHEN n_out>2*greatest(n_in,1) AND n_in<12 THEN 0.15 ELSE 0 END+CASE WHEN span>15 THEN 0.3 WHEN span>6 THEN 0.15 ELSE 0 END,0),1)''', 'difficulty')} FROM o LEFT JOIN s USING (case_id)""",
)
def _(t):
    k = c("case_id")
    sota = t.hits.groupBy("case_id").agg(F.count_if("ok").alias("n_in"), F.count_if(~c("ok")).alias("n_out")).withColumns({
        "sig_lon": (k % 30) * 0.05, "sig_lat": (k % 20) * 0.05, "lat": -22.0 + (k % 11 - 5),
        "grade": F.element_at(F.array(*[F.lit(x) for x in ("GOOD", "FAIR", "POOR")]), (k % 3 + 1).cast("int")),
    })
    d = RU.difficulty(t.good_hits, CASE, sota).withColumn("span", F.round("span", 5))
    return out(d, ["case_id", "span"], difficulty=c("difficulty"))


@query(
    "j12_geometry_sources",
    """WITH ov AS (SELECT job_id, cm+1 AS cm, NULL::DOUBLE AS au FROM d_jobs WHERE job_id%11=0), tb AS (SELECT job_id, CASE WHEN job_id%2=0 THEN cm END AS cm, distance_au AS au FROM d_jobs WHERE job_id%5=0), sp AS (SELECT job_id, cm-0.5e0 AS cm, distance_au+0.1e0 AS au FROM d_jobs WHERE cm_source='spice_auto'),
an AS (SELECT job_id, cm+3 AS cm, 5.2e0 AS au FROM d_jobs)
SELECT job_id, round(coalesce(ov.cm,tb.cm,sp.cm,an.cm),6) AS cm, CASE WHEN ov.cm IS NOT NULL THEN 'override' WHEN tb.cm IS NOT NULL THEN 'table' WHEN sp.cm IS NOT NULL THEN 'spice' ELSE 'analytical' END AS cm_source,
 round(coalesce(ov.au,tb.au,sp.au,an.au),6) AS distance_au, CASE WHEN ov.au IS NOT NULL THEN 'override' WHEN tb.au IS NOT NULL THEN 'table' WHEN sp.au IS NOT NULL THEN 'spice' ELSE 'analytical' END AS distance_au_source
FROM d_jobs j LEFT JOIN ov USING (job_id) LEFT JOIN tb USING (job_id) LEFT JOIN sp USING (job_id) LEFT JOIN an USING (job_id)""",
)
def _(t):
    j, k = t.jobs, c("job_id")
    src = lambda w, cm, au: j.where(w).select("job_id", cm.alias("cm"), au.alias("distance_au"))
    sources = [
        ("override", src(k % 11 == 0, c("cm") + 1, F.lit(None).cast("double"))),
        ("table", src(k % 5 == 0, F.when(k % 2 == 0, c("cm")), c("distance_au"))),
        ("spice", src(c("cm_source") == "spice_auto", c("cm") - 0.5, c("distance_au") + 0.1)),
        ("analytical", src(F.lit(True), c("cm") + 3, F.lit(5.2))),
    ]
    df = RU.first_source(j, "job_id", sources, ["cm", "distance_au"])
    return out(df, ["job_id", "cm_source", "distance_au_source"], cm=c("cm"), distance_au=c("distance_au"))


@query(
    "n01_explode_methods",
    f"SELECT case_id, method_id, {R('lon', 'lon')}, {R('lat', 'lat')} FROM d_hits WHERE ok AND score>0.05",
)
def _(t):
    """The ragged method map of each case, exploded; rejected and non-finite entries are skipped."""
    val = F.struct(
        F.when(c("score") > 0.05, c("lon")).otherwise(F.lit(float("nan"))).alias("lon"), "lat", (~c("ok")).alias("rejected"))
    packed = t.hits.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("method_id", val))).alias("methods"))
    m = packed.select("case_id", F.explode("methods").alias("method_id", "m"))
    m = m.where(~c("m.rejected") & A.finite("m.lon").isNotNull() & A.finite("m.lat").isNotNull())
    return out(m, ["case_id", "method_id"], lon=c("m.lon"), lat=c("m.lat"))


@query(
    "n02_first_finite_path",
    "SELECT job_id, round(coalesce(manual_lon, CASE WHEN job_id%5<>0 THEN pipe_lon END, lon),6) AS lon FROM d_jobs",
)
def _(t):
    doc = F.struct(
        F.struct(c("manual_lon").alias("lon")).alias("publish"),
        F.struct(F.struct(F.when(c("job_id") % 5 == 0, F.lit(float("nan"))).otherwise(c("pipe_lon")).alias("lon")).alias("fit")).alias("twin"),
        F.struct(c("lon").alias("lon")).alias("headline"))
    df = t.jobs.withColumn("doc", doc)
    paths = ("doc.publish.lon", "doc.twin.fit.lon", "doc.headline.lon")
    return out(df, ["job_id"], lon=F.coalesce(*[A.finite(c(p)) for p in paths]))


@query(
    "n05_drop_secret_keys",
    """SELECT ord, CAST(json_extract_string(detail,'$.k') AS VARCHAR) AS k, 1 AS n_left FROM d_usage""",
)
def _(t):
    secret = ["password", "token", "secret"]
    m = F.map_concat(F.from_json("detail", "map<string,string>"), F.create_map(F.lit("token"), F.lit("x"), F.lit("password"), F.lit("y")))
    d = t.usage.withColumn("d", F.map_filter(m, lambda k, v: ~F.lower(k).isin(secret)))
    return d.select("ord", F.try_element_at("d", F.lit("k")).alias("k"), F.size("d").alias("n_left"))


@query(
    "n06_citation_line",
    """SELECT job_id, CASE WHEN lat IS NULL OR pipe_lon IS NULL THEN 'Measure incomplete' ELSE printf('%s lon=%.4f lat_c=%.3f lat_g=%.3f sigma=%.3f CM=%.4f (%s) grade=%s', definition, (job_id%360)::DOUBLE+0.25, lat, lat-1.0, pipe_sky, (job_id%90)::DOUBLE+0.5, cm_source, pipe_grade) END AS line FROM d_jobs""",
)
def _(t):
    lon = F.when(c("pipe_lon").isNotNull(), (c("job_id") % 360).cast("double") + 0.25)
    line = RU.citation("definition", lon, "lat", c("lat") - 1.0, "pipe_sky", (c("job_id") % 90).cast("double") + 0.5, "cm_source", "pipe_grade")
    return t.jobs.select("job_id", line.alias("line"))


@query(
    "n07_cascade_card",
    """SELECT job_id, round(coalesce(nullif(manual_lon,0),nullif(pipe_lon,0),nullif(lon,0)),6) AS lon, round(coalesce(nullif(limb,0),nullif(pipe_sky,0),nullif(def_spread,0)),6) AS sigma,
 CASE WHEN pipe_grade<>'' THEN pipe_grade ELSE '-' END AS grade, coalesce(CASE WHEN job_id%3=0 THEN NULL ELSE job_id%2=0 END, orange_ok) AS absolute_ok FROM d_jobs""",
)
def _(t):
    first = lambda *x: F.coalesce(*[RU.truthy(v) for v in x])
    ok = F.coalesce(F.when(c("job_id") % 3 != 0, c("job_id") % 2 == 0), c("orange_ok"))
    grade = F.coalesce(F.nullif(c("pipe_grade"), F.lit("")), F.lit("-"))
    return out(
        t.jobs.withColumns({"grade": grade, "absolute_ok": ok}), ["job_id", "grade", "absolute_ok"],
        lon=first("manual_lon", "pipe_lon", "lon"), sigma=first("limb", "pipe_sky", "def_spread"))


_WE, _EE = "CASE WHEN job_id%3<>0 THEN lon-6 END", "CASE WHEN job_id%4<>0 THEN lon+7 END"


@query(
    "n08_rim_block",
    f"""WITH r AS (SELECT job_id, {_WE} AS we, {_EE} AS ee, CASE WHEN job_id%5=0 THEN 14.5e0 END AS ex, lon-5 AS gw, lon+5 AS ge, lon FROM d_jobs), s AS (SELECT job_id, coalesce(we,gw) AS w, coalesce(ee,ge) AS e, coalesce(ex,abs({D('ee', 'we')}),10) AS x FROM r)
SELECT job_id, {R('w', 'west')}, {R('e', 'east')}, {R('x', 'extent')}, {R(W('degrees(atan2(sin(radians(w))+sin(radians(e)),cos(radians(w))+cos(radians(e))))'), 'mid')} FROM s""",
)
def _(t):
    k, lon = c("job_id"), c("lon")
    b = RU.rim_block(
        F.when(k % 3 != 0, lon - 6), F.when(k % 4 != 0, lon + 7), F.when(k % 5 == 0, F.lit(14.5)), lon - 5, lon + 5, F.lit(10.0))
    return out(t.jobs, ["job_id"], **b)


@query(
    "u04_inlier_lists",
    f"""WITH k AS (SELECT case_id, method_id, abs({D('lon', '(case_id%360)')})<=10 AS i FROM d_good), a AS (SELECT case_id, list_sort(list(method_id) FILTER (WHERE i)) AS ins, list_sort(list(method_id) FILTER (WHERE NOT i)) AS outs FROM k GROUP BY 1)
SELECT case_id, coalesce(array_to_string(ins,','),'') AS inliers, coalesce(array_to_string(outs,','),'') AS outliers, coalesce(len(ins),0)::INTEGER AS n_in FROM a""",
)
def _(t):
    near = F.abs(A.wrap_diff("lon", c("case_id") % 360)) <= 10.0
    g = t.good_hits.groupBy("case_id").agg(  # at most one entry per method of the catalogue
        F.array_sort(F.array_distinct(F.collect_list(F.when(near, c("method_id"))))).alias("ins"),
        F.array_sort(F.collect_list("method_id")).alias("everyone"))
    outs = F.array_distinct(F.array_except("everyone", "ins"))
    return g.select(
        "case_id", F.array_join("ins", ",").alias("inliers"), F.array_join(outs, ",").alias("outliers"), F.size("ins").alias("n_in"))
