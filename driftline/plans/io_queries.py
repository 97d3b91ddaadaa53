"""Source, sink, metadata and log queries over text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import logs as L
from driftline.operators import series as S
from driftline.sources import readers as RD
from driftline.sources import writers as WR
from driftline.sources.append_log import AppendLog
from driftline.streaming.jobs import work_folder

from .registry import R, W, query
from .scalars import c, order_times, out, _ORD_TS
from .series_queries import _DRIFT
from .track_queries import _WB, wind

_K = "o_orderkey"
_TXT = f"""(SELECT o_orderkey, ts, CASE o_orderkey%4 WHEN 0 THEN 'GRS' WHEN 1 THEN '' WHEN 2 THEN 'Oval BA' ELSE 'grs core' END AS obj, o_totalprice/1000.0e0 AS v FROM ({_ORD_TS}))"""


def observation_text(t):
    """Observation rows as text: rotating date formats, decimal commas, blanks and unreadable dates."""
    k = c(_K)
    f = lambda p: F.date_format("ts", p)
    date = F.when(k % 5 == 0, f("yyyy-MM-dd")).when(k % 5 == 1, f("dd.MM.yyyy")).when(k % 5 == 2, f("yyyy/MM/dd")).when(
        k % 5 == 3, F.lit("??")).otherwise(f("yyyy-MM-dd"))
    time = F.when(k % 5 == 4, F.lit("")).otherwise(f("HH:mm:ss"))
    num = F.format_string("%.5f", c("o_totalprice") / 1000.0)
    return order_times(t).select(
        _K, F.element_at(F.array(*[F.lit(x) for x in ("GRS", "", "Oval BA", "grs core")]), (k % 4 + 1).cast("int")).alias("Object"),
        date.alias("Date"), time.alias("Time"), F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("obs")).alias("Observer"),
        F.when(k % 7 == 0, F.lit("")).when(k % 2 == 0, F.replace(num, F.lit("."), F.lit(","))).otherwise(num).alias("L_II"),
        F.when(k % 9 == 0, F.lit("n/a")).otherwise(F.lit("-19,5")).alias("Lat"),
    )


def observation_files(t):
    """The rows in three sets of files, one for each separator; the order number is the comment."""
    folder = f"{work_folder(t.spark)}/observations"
    rows = observation_text(t).withColumn("Comment", c(_K).cast("string"))
    for n, sep in enumerate((",", ";", "\t")):
        WR.write_observations(rows.where(c(_K) % 3 == n), folder, sep=sep, mode="append")
    return folder


def observations(t):
    return RD.read_observations(t.spark, observation_files(t), ordered=False).withColumn(_K, c("Comment").cast("bigint"))


_OBS = f"""ob AS (SELECT o_orderkey, obj AS Object, CASE WHEN o_orderkey%5=4 THEN epoch_us(date_trunc('day',ts)::TIMESTAMP) ELSE epoch_us(ts) END AS t_us, CASE WHEN o_orderkey%7<>0 THEN round(v,5) END AS L_II, CASE WHEN o_orderkey%9<>0 THEN -19.5e0 END AS Lat, CASE WHEN o_orderkey%6=0 THEN '' ELSE 'obs' END AS Observer FROM {_TXT} WHERE o_orderkey%5<>3)"""


@query("s01_observations", f"WITH {_OBS} SELECT o_orderkey, Object, t_us, L_II, Lat FROM ob")
def _(t):
    return observations(t).select(_K, "Object", "t_us", "L_II", "Lat")


@query(
    "s02_drift_points",
    f"WITH {_OBS} SELECT o_orderkey, t_us, {R(W('L_II'), 'lon')}, 1.0::DOUBLE AS sigma, CASE WHEN Observer='' THEN 'jupos' ELSE Observer END AS source FROM ob WHERE L_II IS NOT NULL AND (Object='' OR contains(lower(Object),'grs'))",
)
def _(t):
    return out(RD.drift_points(observations(t)), [_K, "t_us", "sigma", "source"], lon=c("lon"))


@query(
    "s03_ephemeris_table",
    f"""SELECT CASE WHEN o_orderkey%2=0 THEN epoch_us(ts) ELSE epoch_us(o_orderdate) END AS t_us, round(o_totalprice/2000.0e0,6) AS cm, CASE WHEN o_orderkey%3<>0 THEN 1.5e0 ELSE 0 END AS sub_lat, (o_orderkey%40)::DOUBLE AS np_pa, CASE WHEN o_orderkey%4<>0 THEN 4.5e0 END AS distance_au FROM ({_ORD_TS}) WHERE o_orderkey%11<>0""",
)
def _(t):
    k = c(_K)
    raw = order_times(t).select(
        F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"),
        (F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) + 40587).cast("string").alias("mjd"),
        F.when(k % 11 != 0, F.replace(F.format_string("%.7f", c("o_totalprice") / 2000.0), F.lit("."), F.lit(","))).alias("cm"),
        F.when(k % 3 != 0, F.lit("1,5")).alias("de"), (k % 40).cast("string").alias("pa"), F.when(k % 4 != 0, F.lit("4.5")).otherwise(F.lit("")).alias("delta"), _K,
    )
    folder = f"{work_folder(t.spark)}/ephemerides"
    spelled = [
        (",", ["DateTime", "MJD", "CM", "DE", "PA", "Delta"]), (";", ["Epoch", "mjd", "CML III", "Sub_Lat", "North PA", "distance_au"]),
        ("\t", ["Date", "MJD", "Longitude CM", "sublat", "P", "DELTA"]),
    ]
    for n, (sep, names) in enumerate(spelled):
        rows = raw.where(k % 3 == n).select(*[c(x).alias(y) for x, y in zip(("time", "mjd", "cm", "de", "pa", "delta"), names)])
        rows.write.csv(f"{folder}/{n}", sep=sep, header=True)
    return RD.read_ephemeris(t.spark, folder).withColumn("cm", F.round("cm", 6))


@query(
    "s04_epoch_documents",
    """WITH d AS (SELECT job_id, job_id//7 AS series_id, CASE WHEN job_id%10<3 AND (job_id//7)%3<>0 THEN 'research' ELSE 'vlbi' END AS kind, coalesce(manual_lon,pipe_lon) AS lon, coalesce(manual_lat,lat) AS lat, CASE WHEN job_id%2=0 THEN sig_lon END AS sg FROM d_jobs),
e AS (SELECT * FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL) SELECT job_id, series_id, round(lon,6) AS lon, round(lat,6) AS lat, round(coalesce(sg,0.2e0),6) AS sigma FROM e WHERE kind='research' OR series_id NOT IN (SELECT series_id FROM e WHERE kind='research')""",
)
def _(t):
    k = c("job_id")
    s = F.call_function("div", k, F.lit(7))
    docs = t.jobs.select(
        c("job_id").cast("string").alias("epoch_id"), s.cast("string").alias("series_id"), F.when((k % 10 < 3) & (s % 3 != 0), F.lit("research")).otherwise(F.lit("vlbi")).alias("kind"),
        F.struct(c("manual_lon").alias("lon"), c("manual_lat").alias("lat")).alias("publish"),
        F.struct(c("pipe_lon").alias("lon"), c("lat").alias("lat"), F.when(k % 2 == 0, c("sig_lon")).alias("sigma")).alias("headline"),
        F.struct(F.lit(float("nan")).alias("lon_iii_deg"), F.lit(float("nan")).alias("lat_deg"), F.lit(float("nan")).alias("sigma_lon_deg")).alias("result"),
    )
    folder = f"{work_folder(t.spark)}/epochs"
    docs.write.json(folder)
    e = RD.read_epochs(t.spark, folder, lines=True)
    return out(e, [c("epoch_id").cast("bigint").alias("job_id"), c("series_id").cast("bigint").alias("series_id")], lon=c("lon"), lat=c("lat"), sigma=c("sigma"))


@query(
    "s05_last_per_case",
    "SELECT l_partkey AS idx, l_orderkey, round(l_extendedprice,2) AS price FROM lineitem WHERE l_orderkey%50<>7 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber%3 DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC)=1",
)
def _(t):
    """Three segments of JSON lines, some of them broken; the last readable record of a case wins."""
    log = AppendLog(t.spark, f"{work_folder(t.spark)}/cache")
    line = F.to_json(F.struct(c("l_partkey").alias("idx"), "l_orderkey", F.round("l_extendedprice", 2).alias("price")))
    broken = F.when(c("l_orderkey") % 50 == 7, F.substr(line, F.lit(1), F.lit(9))).otherwise(line)
    for n in range(3):
        rows = t.lineitem.where(c("l_linenumber") % 3 == n).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
        log.append_lines(rows.select(broken.alias("value")))
    return log.latest("idx", "idx bigint, l_orderkey bigint, price double")


@query(
    "s06_capture_list",
    r"""SELECT DISTINCT url AS path FROM (SELECT regexp_replace(url,'[?#].*$','')||CASE page_id%3 WHEN 0 THEN '.ser' WHEN 1 THEN '.AVI' ELSE '.txt' END AS url FROM pages) WHERE regexp_matches(lower(url),'\.(ser|avi)$')""",
)
def _(t):
    ext = F.element_at(F.array(F.lit(".ser"), F.lit(".AVI"), F.lit(".txt")), (c("page_id") % 3 + 1).cast("int"))
    files = t.pages.select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), ext).alias("path"))
    return RD.capture_list(files, "path", (".ser", ".avi"))


@query("u02_distinct_paths", "SELECT DISTINCT regexp_replace(url,'[?#].*$','') AS path FROM pages")
def _(t):
    return t.pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("path")).distinct().orderBy("path")


@query(
    "s07_usage_lines",
    "SELECT ord, CASE WHEN ord%13<>0 THEN action END AS action, CASE WHEN ord%13<>0 THEN json_extract_string(detail,'$.k')::BIGINT END AS k, CASE WHEN ord%13=0 THEN '{broken '||ord END AS raw FROM d_usage",
)
def _(t):
    line = F.when(c("ord") % 13 == 0, F.concat(F.lit("{broken "), c("ord").cast("string"))).otherwise(
        F.to_json(F.struct("action", c("ord").cast("double").alias("unix"), F.from_json("detail", "k bigint").alias("detail"))))
    logs = [f"{work_folder(t.spark)}/{name}" for name in ("server", "desktop")]
    for n, path in enumerate(logs):
        t.usage.where(c("ord") % 2 == n).select(line.alias("value")).write.text(path)
    u = RD.read_usage(t.spark, logs)
    ord_ = F.coalesce(c("unix").cast("bigint"), F.regexp_extract("raw", r"(\d+)$", 1).cast("bigint"))
    return u.select(ord_.alias("ord"), "action", F.get_json_object("detail", "$.k").cast("bigint").alias("k"), "raw")


def package_files(t):
    """Job packages as JSON lines: some give `time_utc`, some `utc_iso`, some no time."""
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss")
    folder, even = f"{work_folder(t.spark)}/packages", c("job_id") % 2 == 0
    rows = t.jobs.join(export_input(t).select("job_id", "t_us", "lon_iii", c("lat").alias("b")), "job_id")
    rows.select(
        "job_id", F.when(even, stamp).alias("time_utc"), F.when(~even, F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z"))).alias("utc_iso"),
        c("lon_iii").alias("lon_iii_deg"), c("b").alias("lat_deg"), F.when(c("job_id") % 3 == 0, c("definition")).alias("method"),
        F.concat(F.lit("job "), c("job_id").cast("string")).alias("comment"),
        F.struct("lon", "lat").alias("headline"), F.struct("cm_source", "limb").alias("publish"),
    ).write.json(folder)
    return folder


@query("s08_job_packages", "SELECT job_id, round(lon,6) AS lon, round(lat,6) AS lat, cm_source FROM d_jobs")
def _(t):
    d = RD.read_packages(t.spark, package_files(t))
    return d.select("job_id", F.round("headline.lon", 6).alias("lon"), F.round("headline.lat", 6).alias("lat"), "publish.cm_source")


@query(
    "s09_sampled_frames",
    """WITH y AS (SELECT capture_id, frame_idx FROM d_frames WHERE frame_idx%3=0 QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY frame_idx)<=100)
SELECT capture_id, frame_idx, (y//2)::INTEGER AS y, (x//2)::INTEGER AS x, round(avg(v),6) AS v FROM d_pixels JOIN y USING (capture_id, frame_idx) GROUP BY 1,2,3,4""",
)
def _(t):
    f = RD.sampled_frames(t.frames, 3, 100, 2, 8).select("capture_id", "frame_idx", F.posexplode("data").alias("pos", "v"))
    return out(f.withColumns({"y": F.floor(c("pos") / 4).cast("int"), "x": c("pos") % 4}), ["capture_id", "frame_idx", "y", "x"], v=c("v"))


_MR = """(SELECT job_id, CASE WHEN has_time THEN TIMESTAMP '2024-01-01'+to_seconds(job_id*977%8640000) END AS ts, (job_id%359)+0.123456e0 AS a, CASE WHEN lat IS NOT NULL THEN -20.0e0-(job_id%7)*0.3337e0 END AS b FROM d_jobs)"""


def export_input(t):
    k = c("job_id")
    return t.jobs.select(
        "job_id", F.when(c("has_time"), F.lit(1704067200000000) + (k * 977 % 8640000) * 1000000).alias("t_us"),
        (k % 359 + 0.123456).alias("lon_iii"), F.when(c("lat").isNotNull(), -20.0 - (k % 7) * 0.3337).alias("lat"))


@query(
    "k01_measurement_rows",
    f"SELECT job_id, 'GRS' AS Object, strftime(ts,'%Y-%m-%d') AS Date, strftime(ts,'%H:%M:%S') AS Time, '' AS L_II, printf('%.3f',a) AS L_III, coalesce(printf('%.3f',b),'') AS Lat FROM {_MR} WHERE ts IS NOT NULL",
)
def _(t):
    path = f"{work_folder(t.spark)}/measurements"
    WR.write_observations(WR.measurement_rows(export_input(t).withColumn("Comment", c("job_id").cast("string"))), path)
    cells = RD.observation_cells(t.spark, path)
    return cells.select(c("Comment").cast("bigint").alias("job_id"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("Object", "Date", "Time", "L_II", "L_III", "Lat")])


@query(
    "k02_package_export",
    f"""SELECT job_id, strftime(ts,'%Y-%m-%d') AS Date, strftime(ts,'%H:%M:%S') AS Time, printf('%.3f',a) AS L_III, coalesce(printf('%.3f',b),'') AS Lat,
 CASE WHEN job_id%3=0 THEN definition ELSE 'GS-MAP' END AS Method, 'job '||job_id AS Comment FROM {_MR} JOIN (SELECT job_id, definition FROM d_jobs) USING (job_id) WHERE ts IS NOT NULL""",
)
def _(t):
    path = f"{work_folder(t.spark)}/export"
    WR.export_packages(RD.read_packages(t.spark, package_files(t)), path, {"Method": "GS-MAP"})
    cells = RD.observation_cells(t.spark, path)
    return cells.select(
        F.regexp_extract("Comment", r"(\d+)$", 1).cast("bigint").alias("job_id"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("Date", "Time", "L_III", "Lat", "Method", "Comment")])


def kept_csv(t, df):
    """The rows after a round through CSV files."""
    path = f"{work_folder(t.spark)}/csv"
    WR.write_csv(df, path)
    return t.spark.read.schema(df.schema).csv(path, header=True, escape="\"", nullValue="")


@query("k03_drift_rows", f"WITH {_DRIFT} SELECT series_id, ord, t_us, printf('%.4f',lon) AS lon, (NOT kept)::INTEGER AS clipped FROM q3")
def _(t):
    _fits, points = S.fit_drift(t.steady, ["series_id"])
    return kept_csv(t, WR.drift_rows(points, ["series_id"]))


@query(
    "k04_profile_rows",
    f"""WITH {_WB} SELECT capture_id, bin, {", ".join(f"coalesce(printf('%.4f',{x}),'') AS {x}" for x in ("abs_lat", "rate", "rate_std", "resid", "resid_std"))}, n_tracks, n_frames FROM wb""",
)
def _(t):
    rows = WR.profile_rows(wind(t), ["capture_id"], ["abs_lat", "rate", "rate_std", "resid", "resid_std"], ["n_tracks", "n_frames"])
    return kept_csv(t, rows).na.fill("")


@query(
    "k05_trajectory_rows",
    """SELECT job_id AS id, round(lon,4) AS lon, NULL::DOUBLE AS sigma, '{"source":"'||cm_source||'"}' AS meta FROM d_jobs UNION ALL SELECT ord, NULL, round(sigma,4), NULL FROM d_series""",
)
def _(t):
    a = t.jobs.select(c("job_id").alias("id"), F.round("lon", 4).alias("lon"), F.struct(c("cm_source").alias("source")).alias("meta"))
    return kept_csv(t, WR.union_of_keys(a, t.series.select(c("ord").alias("id"), F.round("sigma", 4).alias("sigma"))))


@query(
    "k06_batch_rows",
    """SELECT cm_source, count(*) AS n, count(*) FILTER (WHERE has_time) AS n_ok, '{"n":'||count(*)||',"n_ok":'||count(*) FILTER (WHERE has_time)||'}' AS summary FROM d_jobs GROUP BY 1""",
)
def _(t):
    g = t.jobs.groupBy("cm_source").agg(F.count("*").alias("n"), F.count_if("has_time").alias("n_ok"))
    path = f"{work_folder(t.spark)}/batch"
    WR.write_batch(g.withColumn("summary", F.to_json(F.struct("n", "n_ok"))), path)
    rows, docs = t.spark.read.csv(f"{path}/csv", header=True, escape="\"", schema="cm_source string, n bigint, n_ok bigint, summary string"), t.spark.read.json(f"{path}/json")
    return rows.join(docs.select("cm_source", "n", "n_ok"), ["cm_source", "n", "n_ok"])


RESULT = "job_id bigint, definition string, n_in bigint"


@query(
    "k07_result_lines",
    "SELECT job_id, definition, n_in + CASE WHEN job_id%2=0 THEN 100 ELSE 0 END AS n_in FROM d_jobs WHERE job_id%3<2 OR job_id%2=0",
)
def _(t):
    """Runs append their results; a repeated run changes nothing, a second look at a case replaces its record."""
    log = AppendLog(t.spark, f"{work_folder(t.spark)}/results")
    rows = t.jobs.select("job_id", "definition", "n_in")
    for token, part in (("a", "job_id % 3 = 0"), ("b", "job_id % 3 = 1"), ("a", "job_id % 3 = 0")):
        log.append(rows.where(part), token=token)
    log.append(rows.where("job_id % 2 = 0").withColumn("n_in", c("n_in") + 100), token="c")
    return log.latest("job_id", RESULT)


@query(
    "k08_report_documents",
    "SELECT case_id, count(*) AS n, string_agg(ord||':'||round(lat,1), ',' ORDER BY ord) AS points FROM d_good GROUP BY 1",
)
def _(t):
    head = t.good_hits.groupBy("case_id").agg(F.count("*").alias("n"))
    d = WR.report_documents(head, t.good_hits.select("case_id", "ord", "lat"), ["case_id"], "ord")
    path = f"{work_folder(t.spark)}/reports"
    d.write.json(path)
    d = t.spark.read.schema(d.schema).json(path)
    text = F.transform("points", lambda p: F.concat_ws(":", p["ord"].cast("string"), F.round(p["lat"], 1).cast("string")))
    return d.select("case_id", "n", F.array_join(text, ",").alias("points"))


@query(
    "k09_manifest",
    """SELECT url AS input, sha256(html) AS sha256, sha256('{"a":"1","mode":"full"}') AS config_sha256 FROM pages""",
)
def _(t):
    return WR.manifest(t.pages, {"mode": "full", "a": "1"}, "html", "url")


def header_rows(t):
    """Several header keys per part, under alias names and with gaps."""
    k = c("p_partkey")
    rows = F.array_compact(F.array(
        F.when(k % 2 == 0, F.struct(F.lit("XPIXSZ").alias("key"), (c("p_size") * 0.2).cast("string").alias("value"))),
        F.struct(F.lit("pixsize1").alias("key"), F.lit("3.75").alias("value")),
        F.when(k % 3 == 0, F.struct(F.lit("Filter").alias("key"), c("p_name").alias("value"))),
        F.struct(F.lit("BAND").alias("key"), F.lit("None").alias("value")),
        F.when(k % 5 != 0, F.struct(F.lit("PASSBAND").alias("key"), c("p_type").alias("value"))),
        F.struct(F.lit("TELNAME").alias("key"), c("p_brand").alias("value")),
        F.when(k % 4 == 0, F.struct(F.lit("TELESCOP").alias("key"), F.lit("C14 ").alias("value"))),
        F.struct(F.lit("FOCALLEN").alias("key"), F.when(k % 7 == 0, F.lit("0")).otherwise(F.lit("4000")).alias("value")),
    ))
    return t.part.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.*")


@query(
    "j11_header_metadata",
    """SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN p_name WHEN p_partkey%5<>0 THEN p_type END AS filter, CASE WHEN p_partkey%4=0 THEN 'C14' ELSE p_brand END AS telescope,
 CASE WHEN p_partkey%2=0 AND round(p_size*0.2e0,9)>0.1 THEN round(p_size*0.2e0,6) ELSE 3.75 END::DOUBLE AS pixel_um, CASE WHEN p_partkey%7<>0 THEN '4000' END AS focal_mm FROM part""",
)
def _(t):
    m = L.header_metadata(header_rows(t), "p_partkey")
    return m.select("p_partkey", "filter", "telescope", F.round(c("pixel_um").cast("double"), 6).alias("pixel_um"), "focal_mm")


@query(
    "j17_merged_logs",
    "SELECT ord, CASE WHEN ord%2=0 THEN 'server' ELSE 'desktop' END AS log, machine, c_mktsegment AS device FROM d_usage LEFT JOIN customer ON c_custkey=machine AND c_custkey%3<>0",
)
def _(t):
    dev = t.customer.where("c_custkey % 3 <> 0").select(c("c_custkey").alias("machine"), c("c_mktsegment").alias("device"))
    u = t.usage.select("ord", "machine")
    logs = {"server": u.where("ord % 2 = 0"), "desktop": u.where("ord % 2 <> 0")}
    return L.merged_logs(logs, dev, "machine").select("ord", "log", "machine", "device")


@query(
    "a42_usage_summary",
    """WITH s AS (SELECT machine, count(*) AS n_events, max_by(action, (t_us, ord)) AS last_action, max(t_us) AS t_us FROM d_usage GROUP BY 1), a AS (SELECT machine, string_agg(action||':'||n, ',' ORDER BY action) AS by_action FROM (SELECT machine, action, count(*) AS n FROM d_usage GROUP BY 1,2) GROUP BY 1)
SELECT machine, n_events, last_action, t_us, by_action FROM s JOIN a USING (machine)""",
)
def _(t):
    u = t.usage
    s = L.last_state(u, "machine", ["t_us", "ord"], ["action", "t_us"])
    per = L.usage_summary(u, ["machine", "action"])
    by = per.groupBy("machine").agg(  # one entry per action name
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "action", c("n").cast("string")))), ",").alias("by_action"))
    return s.join(by, "machine").select("machine", "n_events", c("action").alias("last_action"), "t_us", "by_action")


@query("t07_last_events", "SELECT ord, action, machine FROM d_usage ORDER BY t_us DESC, ord DESC LIMIT 200")
def _(t):
    return L.last_events(t.usage, 200, "t_us", "ord").select("ord", "action", "machine")
