"""Streaming queries: the given tables are read as file streams and processed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.streaming import jobs as J

from .registry import D, R, W, query
from .scalars import c, out
from .tables import Tables


BATCHES = 4


class Stream(Tables):
    """The same adapters over one table that arrives as a stream."""

    def __init__(self, spark, sf_dir, rows):
        super().__init__(spark, sf_dir)
        self.rows = rows

    def raw(self, name):
        return self.rows


def arriving(rows, part, order, job):
    """Runs `job(stream, folder)` each time one more set of files has come, first those with the first part number of the order.

    Every run goes on from the checkpoint in `folder` and takes its set as one batch, however many files the set has.
    """
    folder = J.work_folder(rows.sparkSession)
    for n, k in enumerate(order):
        rows.where(part == k).write.parquet(f"{folder}/in/{n:03}")
        result = job(J.read_stream(rows.sparkSession, f"{folder}/in/*", "*.parquet", rows.schema), folder)
    return result


def streamed(t, name, part, job):
    return arriving(t.raw(name), part, range(BATCHES), lambda rows, folder: job(Stream(t.spark, t.dir, rows), folder))


@query(
    "r01_usage_windows",
    """WITH g AS (SELECT t_us//86400000000*86400000000 AS start_us, action, count(*) AS n FROM d_usage GROUP BY 1,2) SELECT * FROM g WHERE start_us+86400000000<=(SELECT max(t_us)-600000000 FROM d_usage)""",
)
def _(t):
    span = t.events.agg(F.min("ts").cast("date").alias("a"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("d")).first()
    week = F.floor(F.datediff("ts", F.lit(span["a"])) * BATCHES / F.lit(span["d"]))  # in time order, so that no row is late

    def job(s, folder):
        w = J.usage_windows(s.usage.withColumn("ts", F.timestamp_micros("t_us")), "ts", "1 day", "10 minutes")
        return J.run_available(w.select(F.unix_micros("w.start").alias("start_us"), "action", "n"), "append", folder)

    return streamed(t, "events", week, job).drop("batch_id")


@query(
    "r02_last_seen",
    "SELECT machine, count(*) AS n, max_by(action,(t_us,ord)) AS action, max(t_us) AS t_us FROM d_usage GROUP BY 1",
)
def _(t):
    def job(s, folder):
        seen = J.last_seen(s.usage, "machine", ["t_us", "ord"], ["action", "t_us"]).select("machine", "n", "s.action", "s.t_us")
        return J.run_available(seen, "update", folder)

    return J.latest(streamed(t, "events", c("event_id") % BATCHES, job), ["machine"])


@query(
    "r03_campaign_progress",
    """WITH l AS (SELECT l_partkey AS idx, resolution, quality, ok, dlon, dlat FROM d_campaign QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, dlon DESC)=1)
SELECT resolution, quality, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE ok AND abs(dlon)<=0.5 AND abs(dlat)<=0.5) AS n_05, count(*) FILTER (WHERE ok AND abs(dlon)<=1 AND abs(dlat)<=1) AS n_10 FROM l GROUP BY 1,2""",
)
def _(t):
    line = F.format_string("%015d %05d %015d %020.9f", "l_orderkey", "l_linenumber", "l_suppkey", c("dlon") + 1000.0)

    def job(s, folder):
        rows = s.campaign.select(c("l_partkey").alias("idx"), line.alias("line"), *J.LAST_FIELDS)
        return J.campaign_stream(rows, ["resolution", "quality"], folder)

    return J.latest(streamed(t, "lineitem", c("l_orderkey") % BATCHES, job), ["resolution", "quality"]).where("n > 0")


@query(
    "r04_stack_accumulators",
    f"SELECT capture_id, y, x, count(*) AS n, {R('avg(v)', 'mean')}, {R('sum((1+frame_idx%3)*v)/sum(1+frame_idx%3)', 'weighted')}, {R('var_pop(v)', 'var')} FROM d_pixels GROUP BY 1,2,3",
)
def _(t):
    def job(s, folder):
        px = s.pixels.withColumn("w", 1.0 + c("frame_idx") % 3)
        return J.run_available(J.stack_accumulators(px), "update", folder)

    acc = J.latest(streamed(t, "embeddings", c("vec_id") % BATCHES, job), ["capture_id", "y", "x"])
    return out(J.stack_from_accumulators(acc), ["capture_id", "y", "x", "n"], mean=c("mean"), weighted=c("weighted"), var=c("var"))


_R05 = f"""d AS (SELECT *, row_number() OVER (PARTITION BY series_id, t_us ORDER BY ord) AS k FROM d_steady),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_us) AS i, lag(t_us) OVER (PARTITION BY series_id ORDER BY t_us) AS t0, greatest(sigma,1e-6) AS s FROM d WHERE k=1),
st AS (SELECT p.*, greatest((t_us-t0)/86400e6,1e-9) AS h, 1e-6*pow(greatest(sigma,0.05),2) AS q FROM p),
tr AS (SELECT series_id, i, t_us, ord, lon AS x, 0.0::DOUBLE AS v, (1-(s*s+0.1)/(s*s+0.1+s*s))*(s*s+0.1) AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM st WHERE i=1
 UNION ALL SELECT series_id, i, t_us, ord, x+a/(a+s*s)*e, v+b/(a+s*s)*e, (1-a/(a+s*s))*a, (1-a/(a+s*s))*b, d-b/(a+s*s)*b FROM
 (SELECT *, {D('lon', 'x')} AS e FROM (SELECT st.series_id, st.i, st.t_us, st.ord, st.lon, s, x+h*v AS x, v, a+2*h*b+h*h*d+q*h*h*h/3 AS a, b+h*d+q*h*h/2 AS b, d+q*h AS d
  FROM tr JOIN st ON st.series_id=tr.series_id AND st.i=tr.i+1)))"""


@query(
    "r05_online_track",
    f"""WITH RECURSIVE {_R05} SELECT series_id, t_us, ord, 'applied' AS status, i::BIGINT AS n, {R(W('x'), 'pos')}, {R('v', 'rate')}, {R('sqrt(greatest(a,0))', 'sigma')} FROM tr
 UNION ALL SELECT series_id, t_us, ord, 'tied', NULL, NULL, NULL, NULL FROM d WHERE k>1""",
)
def _(t):
    """Five sets of files in the wrong order, and a last one that moves the watermark past all points."""
    pts = t.steady.select("series_id", "t_us", "ord", "lon", "sigma")
    ends = pts.agg(F.min("t_us").alias("a"), F.max("t_us").alias("z")).first()
    width = (ends["z"] - ends["a"]) // 5 + 1
    end = pts.sparkSession.createDataFrame([(None, ends["z"] + 4 * width, 0, 0.0, 1.0)], pts.schema)
    part = F.when(c("series_id").isNull(), 5).otherwise(F.floor((c("t_us") - ends["a"]) / width))
    delay = f"{3 * width // 1000} milliseconds"
    tr = arriving(pts.unionByName(end), part, [2, 0, 1, 4, 3, 5], lambda rows, folder: J.run_track(rows, delay, folder))
    return out(tr.where("series_id is not null"), ["series_id", "t_us", "ord", "status", "n"], pos=c("pos"), rate=c("rate"), sigma=c("sigma"))
