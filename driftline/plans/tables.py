"""Domain tables derived from the given parquet tables, with the same definitions as SQL table expressions.

Whole tables are used. Where a domain key must be unique (one row per image and method), it is built from row numbers so
that no row is left out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.angles import wrap_deg
from driftline.functions.timebase import epoch_us

FAMILIES = ("click", "view", "purchase", "signup", "error")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.raw(name)

    @cached_property
    def series(self) -> DataFrame:
        """One row per observation of a feature."""
        e = F.col("event_id")
        return self.events.select(
            F.col("user_id").alias("series_id"),
            epoch_us("ts").alias("t_us"),
            e.alias("ord"),
            wrap_deg(F.col("value") * 3.7).alias("lon"),
            (-19.8 + (e % 17 - 8) * 0.5).alias("lat"),
            (0.2 + (e % 7) * 0.1).alias("sigma"),
            F.col("event_type").alias("source"),
        )

    @cached_property
    def steady(self) -> DataFrame:
        """Observations that follow a slow drift per feature, with noise and far outliers."""
        days = (F.col("t_us") - F.lit(1704067200000000)) / F.lit(86400e6)
        rate = (F.col("series_id") % 9 - 4) * 0.7
        noise = (F.col("ord") % 13 - 6) * 0.15 + F.when(F.col("ord") % 19 == 0, F.lit(25.0)).otherwise(F.lit(0.0))
        return self.series.withColumn("lon", wrap_deg(F.col("series_id") * 7.0 + rate * days + noise))

    @cached_property
    def hits(self) -> DataFrame:
        """Every event is a hit. A case takes its rows from 20 consecutive event numbers and the method follows from the
        number's place among them, so a case holds a method at most once and at most 20 rows."""
        e, v = F.col("event_id"), F.col("value")
        part = lambda n: F.call_function("div", e, F.lit(n))
        family = F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), (part(4) % 5 + 1).cast("int"))
        rows = self.events.select("*", (part(20) * 2 + F.col("user_id") % 2).alias("case_id"), family.alias("family"))
        return rows.select(
            "case_id",
            F.concat_ws("_", "family", (e % 4).cast("string")).alias("method_id"),
            e.alias("ord"),
            "family",
            wrap_deg(F.col("case_id") % 360 + (v - 40.0) * 0.35).alias("lon"),
            (-19.8 + (e % 17 - 8) * 1.5).alias("lat"),
            (1 + part(3) % 5).cast("double").alias("weight"),
            F.round(v * 0.01, 4).alias("score"),
            (e % 11 != 0).alias("ok"),
            (8.0 + part(7) % 10).alias("length"),
            (5.0 + e % 7).alias("width"),
        )

    @cached_property
    def good_hits(self) -> DataFrame:
        return self.hits.where("ok")

    @cached_property
    def campaign(self) -> DataFrame:
        """One row per test case."""
        price = F.col("l_extendedprice")
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_returnflag").alias("resolution"),
            F.col("l_linestatus").alias("quality"),
            (F.col("l_linenumber") * 0.5).alias("seeing"),
            F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"),
            (F.col("l_suppkey") % 13 != 0).alias("ok"),
            ((F.col("l_discount") - 0.05) * 6.0 + F.pmod(price, F.lit(1.0)) - 0.5).alias("dlon"),
            ((F.col("l_tax") - 0.04) * 10.0 + F.pmod(price, F.lit(7.0)) * 0.05).alias("dlat"),
            (4.0 + F.col("l_quantity") / 25.0).alias("distance_au"),
        )

    @cached_property
    def tracks(self) -> DataFrame:
        """One row per frame and alignment point."""
        price = F.col("l_extendedprice")
        return self.lineitem.select(
            F.col("l_returnflag").alias("capture_id"),
            (F.col("l_orderkey") % 64).alias("frame_idx"),
            (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("ap_id"),
            F.col("l_orderkey").alias("track_ord"),
            ((F.col("l_quantity") - 25.5) * 3.4).alias("ap_lat"),
            (60.0 * F.col("l_linenumber")).alias("dt_s"),
            ((F.col("l_discount") - 0.05) * 40.0 + F.pmod(price, F.lit(1.0))).alias("dx"),
            ((F.col("l_tax") - 0.04) * 20.0 + F.pmod(price, F.lit(3.0)) * 0.1).alias("dy"),
            (F.col("l_tax") * 50.0).alias("snr"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        """One 8 x 8 frame per row."""
        return self.embeddings.select(
            F.col("label").alias("capture_id"),
            F.col("vec_id").alias("frame_idx"),
            F.col("embedding").cast("array<double>").alias("data"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        return self.frames.select("capture_id", "frame_idx", F.posexplode("data").alias("pos", "v")).select(
            "capture_id",
            "frame_idx",
            F.call_function("div", F.col("pos"), F.lit(8)).cast("int").alias("y"),
            (F.col("pos") % 8).alias("x"),
            "v",
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """One wide row per job, with gaps."""
        k = F.col("o_orderkey")
        some = lambda m, x: F.when(k % m != 0, x)
        pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
        j = self.orders.select(
            k.alias("job_id"), wrap_deg(F.col("o_totalprice") / 97.0).alias("lon"),
            some(29, -19.8 + (k % 23 - 11) * 1.3).alias("lat"),
            pick(5, "spice_auto", "analytical", "horizons", "user_cm", "unknown").alias("cm_source"),
            some(13, (k % 31) * 0.4).alias("limb"), some(17, (k % 53) * 0.9).alias("def_spread"),
            ((k % 11) * 12.0).alias("time_err"), (k % 3 == 0).alias("orange_ok"), (k % 5 == 0).alias("orange_near_limb"),
            pick(6, "GS-MAP", "GS-ORANGE", "GS-BARY", "CHAMPION", "UNBEATABLE_AUTO", "PIPELINE").alias("definition"),
            (k % 21).alias("n_in"), (k % 15).alias("n_out"), ((k % 20) * 0.1).alias("sig_lon"),
            ((k % 14) * 0.1).alias("sig_lat"), (1 + k % 4).alias("n_clusters"), ((k % 9) * 0.5).alias("pipe_sky"),
            pick(4, "METHOD_GOOD", "RESEARCH_FAIR", "NEEDS_WORK", "").alias("pipe_grade"), (k % 10 != 0).alias("has_time"),
            (30.0 + k % 70).alias("a_eq"), (4.0 + (k % 25) * 0.1).alias("distance_au"),
        )
        k = F.col("job_id")
        return j.withColumns({
            "pipe_lon": some(19, wrap_deg(F.col("lon") + (k % 17 - 8) * 4.5)), "cm": wrap_deg(F.col("lon") + (k % 37 - 18) * 5.0),
            "orange_lon": F.col("lon") + (k % 9 - 4), "manual_lon": some(4, F.col("lon") + (k % 7 - 3) * 0.3),
            "manual_lat": some(4, F.col("lat") + (k % 3 - 1) * 0.2),
        })

    @cached_property
    def usage(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("ord"),
            epoch_us("ts").alias("t_us"),
            F.col("event_type").alias("action"),
            F.col("user_id").alias("machine"),
            F.col("props").alias("detail"),
        )


_WRAP = "({0} - 360.0*floor(({0})/360.0))"

CTES = {
    "d_series": f"""
SELECT user_id AS series_id, epoch_us(ts) AS t_us, event_id AS ord,
 {_WRAP.format('(value*3.7)')}::DOUBLE AS lon,
 (-19.8+((event_id%17)-8)*0.5)::DOUBLE AS lat, (0.2+(event_id%7)*0.1)::DOUBLE AS sigma, event_type AS source
FROM events""",
    "d_steady": f"""
SELECT series_id, t_us, ord, {_WRAP.format('raw')}::DOUBLE AS lon, lat, sigma, source FROM (
 SELECT *, series_id*7.0::DOUBLE + (series_id%9-4)*0.7::DOUBLE*((t_us-1704067200000000)/86400e6)
   + (ord%13-6)*0.15::DOUBLE + CASE WHEN ord%19=0 THEN 25.0 ELSE 0.0 END::DOUBLE AS raw FROM d_series)""",
    "d_hits": f"""
SELECT case_id, family||'_'||(event_id%4) AS method_id, event_id AS ord, family,
 {_WRAP.format('((case_id%360) + (value-40.0)*0.35)')}::DOUBLE AS lon,
 (-19.8+((event_id%17)-8)*1.5)::DOUBLE AS lat, (1+(event_id//3)%5)::DOUBLE AS weight,
 round((value*0.01)::DOUBLE,4) AS score, event_id%11<>0 AS ok,
 (8.0+(event_id//7)%10)::DOUBLE AS length, (5.0+event_id%7)::DOUBLE AS width
FROM (SELECT *, (event_id//20)*2 + user_id%2 AS case_id, {list(FAMILIES)}[(event_id//4)%5+1] AS family FROM events)""",
    "d_good": "SELECT * FROM d_hits WHERE ok",
    "d_campaign": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS resolution, l_linestatus AS quality,
 (l_linenumber*0.5)::DOUBLE AS seeing, 'm'||l_linenumber AS method, l_suppkey%13<>0 AS ok,
 ((l_discount-0.05::DOUBLE)*6.0::DOUBLE + fmod(l_extendedprice,1.0::DOUBLE) - 0.5::DOUBLE) AS dlon,
 ((l_tax-0.04::DOUBLE)*10.0::DOUBLE + fmod(l_extendedprice,7.0::DOUBLE)*0.05::DOUBLE) AS dlat,
 (4.0+l_quantity/25.0)::DOUBLE AS distance_au FROM lineitem""",
    "d_tracks": """
SELECT l_returnflag AS capture_id, l_orderkey%64 AS frame_idx, l_partkey*8+l_linenumber AS ap_id,
 l_orderkey AS track_ord, ((l_quantity-25.5::DOUBLE)*3.4::DOUBLE) AS ap_lat, (60.0*l_linenumber)::DOUBLE AS dt_s,
 ((l_discount-0.05::DOUBLE)*40.0::DOUBLE + fmod(l_extendedprice,1.0::DOUBLE)) AS dx,
 ((l_tax-0.04::DOUBLE)*20.0::DOUBLE + fmod(l_extendedprice,3.0::DOUBLE)*0.1::DOUBLE) AS dy,
 (l_tax*50.0)::DOUBLE AS snr FROM lineitem""",
    "d_frames": "SELECT label AS capture_id, vec_id AS frame_idx, embedding::DOUBLE[] AS data FROM embeddings",
    "d_pixels": """
SELECT capture_id, frame_idx, (pos//8)::INTEGER AS y, (pos%8)::INTEGER AS x, v FROM (
 SELECT capture_id, frame_idx, unnest(range(64)) AS pos, unnest(data) AS v FROM d_frames)""",
    "d_jobs": f"""
SELECT *, CASE WHEN job_id%19<>0 THEN {_WRAP.format('(lon+(job_id%17-8)*4.5e0)')} END AS pipe_lon,
 {_WRAP.format('(lon+(job_id%37-18)*5.0e0)')} AS cm, lon+(job_id%9-4) AS orange_lon,
 CASE WHEN job_id%4<>0 THEN lon+(job_id%7-3)*0.3e0 END AS manual_lon, CASE WHEN job_id%4<>0 THEN lat+(job_id%3-1)*0.2e0 END AS manual_lat FROM (
SELECT o_orderkey AS job_id, {_WRAP.format('(o_totalprice/97.0e0)')} AS lon, CASE WHEN o_orderkey%29<>0 THEN -19.8e0+(o_orderkey%23-11)*1.3e0 END AS lat,
 ['spice_auto','analytical','horizons','user_cm','unknown'][o_orderkey%5+1] AS cm_source, CASE WHEN o_orderkey%13<>0 THEN (o_orderkey%31)*0.4e0 END AS limb,
 CASE WHEN o_orderkey%17<>0 THEN (o_orderkey%53)*0.9e0 END AS def_spread, (o_orderkey%11)*12.0e0 AS time_err, o_orderkey%3=0 AS orange_ok, o_orderkey%5=0 AS orange_near_limb,
 ['GS-MAP','GS-ORANGE','GS-BARY','CHAMPION','UNBEATABLE_AUTO','PIPELINE'][o_orderkey%6+1] AS definition, o_orderkey%21 AS n_in, o_orderkey%15 AS n_out,
 (o_orderkey%20)*0.1e0 AS sig_lon, (o_orderkey%14)*0.1e0 AS sig_lat, 1+o_orderkey%4 AS n_clusters, (o_orderkey%9)*0.5e0 AS pipe_sky,
 ['METHOD_GOOD','RESEARCH_FAIR','NEEDS_WORK',''][o_orderkey%4+1] AS pipe_grade, o_orderkey%10<>0 AS has_time, 30.0e0+o_orderkey%70 AS a_eq, 4.0e0+(o_orderkey%25)*0.1e0 AS distance_au FROM orders)""",
    "d_usage": """
SELECT event_id AS ord, epoch_us(ts) AS t_us, event_type AS action, user_id AS machine, props AS detail FROM events""",
}
