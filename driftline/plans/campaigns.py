"""Campaign queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.operators import campaign as CP
from driftline.sources.append_log import AppendLog, resume
from driftline.streaming.jobs import work_folder

from .consensus import CASE, IMG_ROLE, image_hits, role_rows_sql
from .registry import D, R, W, query
from .scalars import c, out, sky_sql

_SKY = sky_sql("dlon", "dlat", "(-19.8e0+dlat)", "distance_au")
_E = f"e AS (SELECT *, abs(dlon) AS al, abs(dlat) AS aa, {_SKY} AS sky FROM d_campaign)"


def q_sql(p, x, name):
    return R(f"quantile_cont({x},{p}) FILTER (WHERE ok)", name)


def w_sql(x, name):
    return R(f"avg(CASE WHEN al<={x} AND aa<={x} THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok)", name)


_SUM_COLS = f"""count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, {R('1-count(*) FILTER (WHERE ok)/count(*)', 'fail_rate')},
 {q_sql(0.5, 'al', 'abs_dlon_med')}, {q_sql(0.9, 'al', 'abs_dlon_p90')}, {q_sql(0.99, 'al', 'abs_dlon_p99')}, {R('max(al) FILTER (WHERE ok)', 'lon_max')},
 {q_sql(0.5, 'aa', 'abs_dlat_med')}, {q_sql(0.9, 'aa', 'abs_dlat_p90')}, {q_sql(0.99, 'aa', 'abs_dlat_p99')}, {R('max(aa) FILTER (WHERE ok)', 'lat_max')},
 {q_sql(0.5, 'sky', 'sky_med')}, {q_sql(0.9, 'sky', 'sky_p90')}, {q_sql(0.99, 'sky', 'sky_p99')}, {R('max(sky) FILTER (WHERE ok)', 'sky_max')},
 {R('avg(dlon) FILTER (WHERE ok)', 'lon_bias')}, {R('stddev_pop(dlon) FILTER (WHERE ok)', 'lon_sd')}, {R('avg(dlat) FILTER (WHERE ok)', 'lat_bias')},
 {R('stddev_pop(dlat) FILTER (WHERE ok)', 'lat_sd')}, {w_sql(0.2, 'within_02')}, {w_sql(0.5, 'within_05')}, {w_sql('1.0', 'within_10')}"""


def rounded(df, keys):
    return df.select(*keys, *[F.round(x, 6).alias(x) for x in df.columns if x not in keys])


@query("a23_campaign_summary", f"WITH {_E} SELECT quality, {_SUM_COLS} FROM e GROUP BY quality")
def _(t):
    return rounded(CP.summary(CP.with_errors(t.campaign), ["quality"]), ["quality", "n", "n_ok"])


@query(
    "a24_overall_and_cells",
    f"""WITH {_E} SELECT coalesce(resolution,'ALL') AS resolution, coalesce(quality,'ALL') AS quality, {_SUM_COLS} FROM e
GROUP BY GROUPING SETS ((),(resolution,quality))""",
)
def _(t):
    cells = CP.with_overall(CP.with_errors(t.campaign), ["resolution", "quality"])
    return rounded(CP.summary(cells, ["resolution", "quality"]), ["resolution", "quality", "n", "n_ok"])


@query(
    "a25_method_audit",
    f"""WITH d AS (SELECT method_id, {D('lon', '(case_id%360)')} AS dlon, lat+19.8e0 AS dlat FROM d_good),
r AS (SELECT *, abs(dlon) AS al, abs(dlat) AS aa, row_number() OVER (PARTITION BY method_id ORDER BY abs(dlon)) AS k, count(*) OVER (PARTITION BY method_id) AS n FROM d),
s AS (SELECT *, least(greatest((9*(n+1))//10,1),n-1) AS j FROM r)
SELECT method_id, count(*) AS n, {R('avg(dlon)', 'dlon_mean')}, {R('median(dlon)', 'dlon_median')}, {R('stddev_pop(dlon)', 'dlon_sd')}, {R('avg(dlat)', 'dlat_mean')},
 {R('avg(al)', 'abs_dlon_mean')}, {R('max(al)', 'abs_dlon_max')}, {R('avg(CASE WHEN al<=1 AND aa<=1 THEN 1.0 ELSE 0.0 END)', 'within_1deg')},
 {R('CASE WHEN any_value(n)>=10 THEN (max(al) FILTER (WHERE k=j)*(10-(9*(any_value(n)+1)-10*any_value(j)))+max(al) FILTER (WHERE k=j+1)*(9*(any_value(n)+1)-10*any_value(j)))/10.0e0 ELSE max(al) END', 'abs_dlon_p90')}
FROM s GROUP BY 1""",
)
def _(t):
    d = t.good_hits.select(
        "method_id", A.wrap_diff("lon", c("case_id") % 360).alias("dlon"), (c("lat") + 19.8).alias("dlat")
    )
    return rounded(CP.method_audit(d, "method_id"), ["method_id", "n"])


_CELL = f"""{_E}, h AS (SELECT resolution, seeing, string_agg(m, ',' ORDER BY m) AS methods FROM
 (SELECT resolution, seeing, method||':'||count(*) AS m FROM e WHERE ok GROUP BY resolution, seeing, method) GROUP BY 1,2),
cell AS (SELECT e.resolution, e.seeing, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, quantile_cont(al,0.5) FILTER (WHERE ok) AS med, quantile_cont(al,0.9) FILTER (WHERE ok) AS p90,
 max(al) FILTER (WHERE ok) AS mx, quantile_cont(aa,0.5) FILTER (WHERE ok) AS meda, quantile_cont(aa,0.9) FILTER (WHERE ok) AS p90a, avg(CASE WHEN al<=1 AND aa<=1 THEN 1.0 ELSE 0 END) FILTER (WHERE ok) AS w1,
 avg(CASE WHEN al<=0.5 AND aa<=0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE ok) AS w5, avg(CASE WHEN al>10 THEN 1.0 ELSE 0 END) FILTER (WHERE ok) AS cat FROM e GROUP BY 1,2)"""


@query(
    "a26_cell_summary",
    f"""WITH {_CELL} SELECT resolution, seeing, n, n_ok, {R('med', 'abs_dlon_median')}, {R('p90', 'abs_dlon_p90')}, {R('mx', 'max_abs_dlon')}, {R('meda', 'abs_dlat_median')},
 {R('p90a', 'abs_dlat_p90')}, {R('coalesce(w1,0)', 'within_1deg')}, {R('coalesce(w5,0)', 'within_0p5deg')}, {R('coalesce(cat,1)', 'catastrophic_rate')}, coalesce(methods,'') AS methods
FROM cell LEFT JOIN h USING (resolution, seeing)""",
)
def _(t):
    df = CP.cell_summary(CP.with_errors(t.campaign), ["resolution", "seeing"])
    return rounded(df, ["resolution", "seeing", "n", "n_ok", "methods"])


@query(
    "a27_proof_summary",
    f"""WITH {_E} SELECT resolution, count(*) AS n_ok, {R('avg(sky)', 'mean')}, {R('stddev_samp(sky)', 'stdev')}, {R('min(sky)', 'min')}, {R('max(sky)', 'max')},
 {R('quantile_cont(sky,0.5)', 'median')}, {R('quantile_cont(sky,0.16)', 'p16')}, {R('quantile_cont(sky,0.84)', 'p84')}, {R('quantile_cont(sky,0.95)', 'p95')},
 {R('avg(CASE WHEN sky<=0.1 THEN 1.0 ELSE 0 END)', 'le_0_1')}, {R('avg(CASE WHEN sky<=0.25 THEN 1.0 ELSE 0 END)', 'le_0_25')},
 {R('avg(CASE WHEN sky<=0.5 THEN 1.0 ELSE 0 END)', 'le_0_5')}, {R('avg(CASE WHEN sky<=1.0 THEN 1.0 ELSE 0 END)', 'le_1_0')} FROM e WHERE ok GROUP BY 1""",
)
def _(t):
    return rounded(CP.proof_summary(CP.with_errors(t.campaign), ["resolution"]), ["resolution", "n_ok"])


@query(
    "a28_certification",
    f"""WITH {_E}, s AS (SELECT method, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, max(sky) FILTER (WHERE ok) AS mx, quantile_cont(sky,0.5) FILTER (WHERE ok) AS med,
 quantile_cont(sky,0.95) FILTER (WHERE ok) AS p95 FROM e GROUP BY 1),
f AS (SELECT *, concat_ws(',', CASE WHEN n_ok/n<0.95 THEN 'ok_ratio' END, CASE WHEN NOT med<=0.18 THEN 'median_le' END, CASE WHEN NOT p95<=0.5 THEN 'p95_le' END, CASE WHEN NOT mx<=0.9 THEN 'max_le' END) AS failed_gates FROM s)
SELECT method, n, n_ok, {R('med', 'median_sky')}, {R('p95', 'p95_sky')}, {R('mx', 'max_sky')}, failed_gates, CASE WHEN failed_gates='' THEN 'SHIP' ELSE 'HOLD' END AS grade FROM f""",
)
def _(t):
    df = CP.certify(CP.with_errors(t.campaign), ["method"], 0.18, 0.5, 0.9)
    return rounded(df, ["method", "n", "n_ok", "failed_gates", "grade"])


_STRESS = f"""{_E}, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY sky)-1 AS i, count(*) OVER (PARTITION BY method) AS m FROM e WHERE ok),
s AS (SELECT method, max(sky) FILTER (WHERE i=m//2) AS med, max(sky) FILTER (WHERE i=least(m-1,CAST(round_even(0.95e0*(m-1),0) AS BIGINT))) AS p95, max(sky) AS mx, avg(CASE WHEN al<=1 AND aa<=1 THEN 1.0 ELSE 0 END) AS w1 FROM k GROUP BY 1)"""


@query(
    "a29_stress_summary",
    f"""WITH {_STRESS} SELECT method, n_total, n_ok, {R('med', 'median_sky')}, {R('p95', 'p95_sky')}, {R('mx', 'max_sky')}, {R('w1', 'within_1deg')} FROM s
JOIN (SELECT method, count(*) AS n_total, count(*) FILTER (WHERE ok) AS n_ok FROM e GROUP BY 1) USING (method)""",
)
def _(t):
    df = CP.stress_summary(CP.with_errors(t.campaign), ["method"]).drop("calibration_grade")
    return rounded(df, ["method", "n_total", "n_ok"])


@query(
    "g08_calibration_grade",
    f"""WITH {_STRESS} SELECT method, CASE WHEN med<=0.2 AND p95<=0.5 AND w1>=0.95 THEN 'A' WHEN med<=0.4 AND p95<=1 AND w1>=0.85 THEN 'B'
 WHEN med<=0.8 AND p95<=2 AND w1>=0.7 THEN 'C' ELSE 'D' END AS grade FROM s""",
)
def _(t):
    df = CP.stress_summary(CP.with_errors(t.campaign), ["method"])
    return df.select("method", c("calibration_grade").alias("grade"))


@query(
    "a30_failure_modes",
    f"""WITH h AS (SELECT case_id, role, {D('lon', '(case_id%360)')} AS dlon, abs(lat+19.8e0) AS sky FROM {role_rows_sql(IMG_ROLE)}),
b AS (SELECT * FROM h WHERE role IS NOT NULL), f AS (SELECT case_id, role AS best FROM b QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sky, role)=1),
p AS (SELECT case_id, max(dlon) FILTER (WHERE role='template') AS td, max(sky) FILTER (WHERE role='template') AS ts, max(dlon) FILTER (WHERE role='moment') AS md,
 max(sky) FILTER (WHERE role='moment') AS ms, max(sky) FILTER (WHERE role='redness') AS rs FROM b GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE best IN ('template','moment')) AS dark_right, count(*) FILTER (WHERE best='redness') AS colour_right,
 count(*) FILTER (WHERE best='map_dark') AS other, count(*) FILTER (WHERE abs(abs(td)-abs(md))>12) AS dark_split,
 count(*) FILTER (WHERE abs(abs(td)-abs(md))>12 AND ts<>ms AND rs<least(ts,ms)) AS rescued_by_colour FROM f JOIN p USING (case_id)""",
)
def _(t):
    d = image_hits(t).withColumns({
        "dlon": A.wrap_diff("lon", c("case_id") % 360), "sky": F.abs(c("lat") + 19.8),
    })
    return CP.failure_modes(d, CASE, "role")


@query(
    "a45_batch_status",
    "SELECT resolution, count(*) AS n_total, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed FROM d_campaign GROUP BY 1",
)
def _(t):
    return t.campaign.groupBy("resolution").agg(
        F.count("*").alias("n_total"), F.count_if("ok").alias("n_ok"), F.count_if(~c("ok")).alias("n_failed")
    )


_CURVE = "(seeing*0.35e0)*med/(SELECT max(med) FROM cell)"


def _floor_cells(t):
    """Cell medians tilted with seeing, so that the curves rise through the thresholds."""
    df = CP.measure_quantiles(CP.with_errors(t.campaign).where("ok"), ["resolution", "seeing"], ["abs_dlon"], {"median": 0.5})
    return df.withColumn("y", c("seeing") * 0.6 * c("abs_dlon_median"))


@query(
    "w12_error_floor",
    f"""WITH {_CELL}, y AS (SELECT resolution, seeing, seeing*0.6e0*med AS y, lead(seeing) OVER w AS s2, lead(seeing*0.6e0*med) OVER w AS y2 FROM cell WINDOW w AS (PARTITION BY resolution ORDER BY seeing)),
l AS (SELECT resolution, arg_max(y, seeing) AS yl, max(seeing) AS sl, arg_min(y, seeing) AS best FROM y GROUP BY 1),
f5 AS (SELECT resolution, arg_min(seeing+(0.5e0-y)/(y2-y)*(s2-seeing), seeing) AS x FROM y WHERE y<=0.5 AND y2>0.5 GROUP BY 1),
f10 AS (SELECT resolution, arg_min(seeing+(1.0e0-y)/(y2-y)*(s2-seeing), seeing) AS x FROM y WHERE y<=1.0 AND y2>1.0 GROUP BY 1)
SELECT resolution, {R('coalesce(f5.x, CASE WHEN yl<0.5 THEN sl END)', 'floor_0p5')}, {R('coalesce(f10.x, CASE WHEN yl<1.0 THEN sl END)', 'floor_1p0')}, {R('best', 'best')}
FROM l LEFT JOIN f5 USING (resolution) LEFT JOIN f10 USING (resolution)""",
)
def _(t):
    df = CP.error_floor(_floor_cells(t), ["resolution"], "seeing", "y", {"floor_0p5": 0.5, "floor_1p0": 1.0})
    return rounded(df, ["resolution"])


@query(
    "w13_seeing_curves",
    f"""WITH {_E} SELECT resolution, {R("quantile_cont(al,0.5) FILTER (WHERE quality='F')", 'F')}, {R("quantile_cont(al,0.5) FILTER (WHERE quality='O')", 'O')} FROM e WHERE ok GROUP BY 1""",
)
def _(t):
    q = CP.measure_quantiles(CP.with_errors(t.campaign).where("ok"), ["resolution", "quality"], ["abs_dlon"], {"median": 0.5})
    return rounded(q.groupBy("resolution").pivot("quality", ["F", "O"]).agg(F.max("abs_dlon_median")), ["resolution"])


@query(
    "t08_worst_tail",
    f"""WITH {_E} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, resolution, quality, method, {R('al', 'dlon', 3)}, {R('aa', 'dlat', 3)} FROM e WHERE ok
ORDER BY round(abs(e.dlon)+abs(e.dlat),9) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 15""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = CP.with_errors(t.campaign).where("ok")
    top = df.orderBy(F.desc(F.round(c("abs_dlon") + c("abs_dlat"), 9)), *keys).limit(15)
    return top.select(
        *keys, "resolution", "quality", "method", F.round("abs_dlon", 3).alias("dlon"), F.round("abs_dlat", 3).alias("dlat")
    )


_LT = W("o_totalprice")
_LM = W(_LT + "+((l_discount-0.05e0)*6.0e0+fmod(l_extendedprice,1.0e0)-0.5e0)")


@query(
    "j02_truth_join",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('dlon', 'dlon')}, {R('dlat', 'dlat')}, {R('abs(dlon)', 'abs_dlon')},
 {R(sky_sql('dlon', 'dlat', '(-19.8e0)', 'distance_au'), 'sky')} FROM (SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, {D(_LM, _LT)} AS dlon, c.dlat, c.distance_au
 FROM d_campaign c JOIN orders ON c.l_orderkey=o_orderkey JOIN lineitem l ON l.l_orderkey=c.l_orderkey AND l.l_linenumber=c.l_linenumber AND l.l_partkey=c.l_partkey AND l.l_suppkey=c.l_suppkey)""",
)
def _(t):
    truth = t.orders.select(c("o_orderkey").alias("l_orderkey"), A.wrap_deg("o_totalprice").alias("lon_truth"))
    both = CP.attach_truth(t.campaign, truth, ["l_orderkey"])
    both = both.withColumn("lon_meas", A.wrap_deg(c("lon_truth") + c("dlon")))
    both = both.withColumn("dlon", A.wrap_diff("lon_meas", "lon_truth"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return out(
        both, keys, dlon=c("dlon"), dlat=c("dlat"), abs_dlon=F.abs("dlon"),
        sky=A.sky_error_arcsec("dlon", "dlat", -19.8, "distance_au"),
    )


@query(
    "j04_resume",
    """WITH m AS (SELECT o_orderkey AS idx, o_orderstatus AS resolution, o_orderkey*7 AS seed, (o_custkey%10)*0.1e0 AS seeing FROM orders),
k AS (SELECT o_orderkey AS idx, o_orderkey%11<>0 AS ok, o_orderstatus AS resolution, CASE WHEN o_orderkey%7=0 THEN 0 ELSE o_orderkey*7 END AS seed, (o_custkey%10)*0.1e0+CASE WHEN o_orderkey%5=0 THEN 0.1e0 ELSE 0 END AS seeing FROM orders WHERE o_orderkey%3<>0)
SELECT m.idx, m.resolution, m.seed FROM m LEFT JOIN k USING (idx) WHERE k.idx IS NULL OR NOT k.ok OR k.resolution<>m.resolution OR k.seed<>m.seed OR abs(k.seeing-m.seeing)>1e-9""",
)
def _(t):
    k = c("o_orderkey")
    seeing = (c("o_custkey") % 10) * 0.1
    m = t.orders.select(k.alias("idx"), c("o_orderstatus").alias("resolution"), (k * 7).alias("seed"), seeing.alias("seeing"))
    cache = t.orders.where(k % 3 != 0).select(
        k.alias("idx"), (k % 11 != 0).alias("ok"), c("o_orderstatus").alias("resolution"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(k * 7).alias("seed"),
        (seeing + F.when(k % 5 == 0, F.lit(0.1)).otherwise(F.lit(0.0))).alias("seeing"),
    )
    log = AppendLog(t.spark, f"{work_folder(t.spark)}/cache")
    log.append(cache)
    todo = resume(m, log, "idx bigint, ok boolean, resolution string, seed bigint, seeing double", "idx", ["resolution", "seed"], ["seeing"])
    return todo.select("idx", "resolution", "seed")


@query(
    "u05_case_matrix",
    """WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS k FROM customer GROUP BY 1), o AS (SELECT *, coalesce(sum(k) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS off FROM s)
SELECT stratum, (off+i)::BIGINT AS idx, (4100+(off+i)*17)::BIGINT AS seed FROM (SELECT stratum, off, unnest(range(k)) AS i FROM o)""",
)
def _(t):
    strata = t.customer.groupBy(c("c_mktsegment").alias("stratum")).agg(F.count("*").alias("k"))
    return CP.case_matrix(strata, "stratum", "k", 4100, 17, block=100).select("stratum", "idx", "seed")
