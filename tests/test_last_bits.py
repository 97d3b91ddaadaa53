"""Values whose rounded result hangs on the last bit of a double: Spark takes the same steps as the SQL twins in DuckDB."""

import random

import duckdb
from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.operators import hits as H
from driftline.operators import images as IM
from driftline.plans import catalog
from driftline.plans.registry import D, W


def test_wrap_takes_the_steps_of_the_sql(spark):
    xs = [-1e-14, -1e-13, 0.0, 359.99999999999994, 360.0, 719.9999999999999, -360.00000000000006, 1e7 / 3, -5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {tuple(r) for r in df.select("x", A.wrap_deg("x").alias("w"), A.wrap_diff("x", 180.0).alias("d")).collect()}
    con = duckdb.connect()
    want = con.sql(f"SELECT x, {W('x')}, {D('x', '180.0e0')} FROM (SELECT unnest([{','.join(f'{x!r}::DOUBLE' for x in xs)}]) AS x)").fetchall()
    assert got == set(want)
    odd = spark.range(1).select(A.wrap_deg(F.lit(float("inf"))).alias("i"), A.wrap_deg(F.lit(None).cast("double")).alias("n")).first()
    assert odd["i"] != odd["i"] and odd["n"] is None


def test_family_ensembles_at_the_zero_meridian(spark):
    """Pairs that mirror each other about longitude 0, as a06 has them in larger tables."""
    rows = [(k, "click", s * k * 0.0035 % 360.0, -19.8) for k in range(1, 400) for s in (1, -1)]
    df = spark.createDataFrame(rows, "case_id long, family string, lon double, lat double")
    got = H.family_ensembles(df, ["case_id"], ["click"]).select("case_id", F.round("lon", 6).alias("lon"))
    con = duckdb.connect()
    con.sql("CREATE TABLE t (case_id BIGINT, lon DOUBLE)")
    con.sql("INSERT INTO t VALUES " + ",".join(f"({k}, {lon!r})" for k, _, lon, _ in rows))
    mean = W("degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon)))))")
    want = con.sql(f"SELECT case_id, round({mean}, 6) FROM t GROUP BY 1").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


#: Sixteenths; its levels have centroids that mirror each other about the central meridian.
MIRRORED = [
    -2, 2, 1, -3, -3, -2, -1, 1, -1, 2, 0, 0, -1, 3, 1, 0,
    -1, 5, 2, 0, 2, -2, 2, -1, -3, -1, 6, -1, 4, 0, 1, -2,
    -1, -1, 0, 1, 1, 1, -4, -4, 3, -5, 2, 1, 1, 1, -2, 2,
    1, -2, 0, -1, -1, 0, 3, 0, 1, 1, 0, 2, -1, 1, 3, 1,
]


def run_both(spark, tmp_path, name, frames):
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.sql("INSERT INTO embeddings VALUES " + ",".join(f"({i}, {f}, {i % 10})" for i, f in enumerate(frames)))
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    rel = con.sql(catalog.ORACLES[name])
    return sorted(tuple(r) for r in df.select(list(rel.columns)).collect()), sorted(rel.fetchall())


def test_isophote_ladder_at_the_zero_meridian(spark, tmp_path):
    got, want = run_both(spark, tmp_path, "x17_isophote_ladder", [[v / 16 for v in MIRRORED]])
    assert want[0][3] == 360.0
    assert got == want


def test_quantile_has_the_bits_of_the_sql(spark):
    rng = random.Random(3)
    rows = [(i, sorted(rng.gauss(0.5, 0.125) for _ in range(40 + i % 25))) for i in range(500)]
    rows += [(500, [1.0]), (501, []), (502, [1e308, 1.5e308])]
    df = spark.createDataFrame(rows, "k long, a array<double>")
    got = sorted(tuple(r) for r in df.select("k", IM.quantile("a", 0.14).alias("p"), IM.quantile("a", 0.95).alias("q"), IM.quantile("a", 0.5).alias("m")).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k BIGINT, a DOUBLE[])")
    con.sql("INSERT INTO t VALUES " + ",".join(f"({k}, {a})" for k, a in rows))
    q = ", ".join(f"list_aggregate(a, 'quantile_cont', {p}e0)" for p in (0.14, 0.95, 0.5))
    assert got == sorted(con.sql(f"SELECT k, {q} FROM t").fetchall())
