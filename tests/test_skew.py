"""Balanced building blocks against plain computations on small, skewed data."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftline.operators import skew
from driftline.operators import tracks as TR


def skewed(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    v = np.round(rng.normal(0, 50, n), 1)
    v[rng.random(n) < 0.2] = 0.0
    pdf = pd.DataFrame({"k": k, "v": v, "i": np.arange(n), "t": rng.permutation(n) * 7})
    return pdf, spark.createDataFrame(pdf)


def test_group_quantiles_match_numpy(spark):
    pdf, df = skewed(spark)
    got = skew.group_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.99, "lo": 0.0, "hi": 1.0}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, p in {"a": 10, "m": 50, "z": 99, "lo": 0, "hi": 100}.items():
            assert abs(got.loc[k, name] - np.percentile(g.v, p)) < 1e-9
        assert got.loc[k, "n"] == len(g)


def test_quantiles_ignore_missing_and_work_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,), (-2.0,)], "v double")
    r = skew.group_quantiles(df, [], "v", {"m": 0.5}).first()
    assert r.n == 3 and r.m == 1.0


def test_radix_bucket_is_monotone(spark):
    vals = sorted({s * m * 2.0**e for s in (-1, 1) for e in (-40, -3, 0, 1, 5, 60) for m in (1.0, 1.0000001, 1.5, 1.9999999999999998)} | {0.0, 1e-300})
    df = spark.createDataFrame([(v,) for v in vals], "v double").coalesce(1)
    b = [r.b for r in df.select("v", skew.radix_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert b == sorted(b)


def test_keep_largest_matches_sort(spark):
    pdf, df = skewed(spark)
    kept = skew.keep_largest(df, ["k"], "v", "i", F.floor(F.col("n") * 0.3)).where("kept").toPandas()
    for k, g in pdf.groupby("k"):
        n = max(1, int(len(g) * 0.3))
        want = set(g.sort_values(["v", "i"], ascending=[False, True]).head(n).i)
        assert set(kept[kept.k == k].i) == want


def test_timeline_crosses_span_borders(spark):
    pdf, df = skewed(spark)
    df = df.withColumn("w", F.when(F.col("i") % 5 == 0, F.col("v")))
    line = skew.Timeline(df, ["k"], "t", "i", 500)
    r = line.neighbour({"p": "v"}).neighbour({"q": "v"}, offset=1).running_sum({"s": "v"}).known({"f": "w"}).known({"b": "w"}, forward=False).df
    got = r.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for _, g in got.groupby("k"):
        assert np.allclose(g.p.iloc[1:], g.v.iloc[:-1]) and np.isnan(g.p.iloc[0])
        assert np.allclose(g.q.iloc[:-1], g.v.iloc[1:]) and np.isnan(g.q.iloc[-1])
        assert np.allclose(g.s, g.v.cumsum(), atol=1e-6)
        w = g.v.where(g.i % 5 == 0)
        assert np.allclose(g.f, w.ffill(), equal_nan=True) and np.allclose(g.b, w.bfill(), equal_nan=True)


def test_attach_keeps_all_rows(spark):
    pdf, df = skewed(spark)
    small = df.groupBy("k").agg(F.avg("v").alias("m")).where("k <> 3")
    r = skew.attach(df, small, ["k"])
    assert r.count() == len(pdf)
    assert r.where("m is null").count() == (pdf.k == 3).sum()


def test_median_of_counted_values(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=301), 1)] + [("b", float(v)) for v in rng.normal(50, 3, 40)] + [("c", 2.0), ("d", float("nan")), ("d", None)]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("c"))
    got = {r["k"]: (r["m"], r["n"]) for r in skew.counted_median(counts, ["k"], F.col("v"), "c", "m", "n").collect()}
    for k in "abc":
        v = [x for g, x in rows if g == k]
        assert abs(got[k][0] - np.median(v)) < 1e-12 and got[k][1] == len(v)
    assert set(got) == {"a", "b", "c"}


def test_wind_bins_work_on_values_not_on_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [("c", int(i % 7), float(lat), 60.0, float(dx), 1.0) for i, (lat, dx) in enumerate(zip(rng.integers(-80, 80, 300), rng.normal(0, 0.5, 300)))]
    once = spark.createDataFrame(base, "capture_id string, frame_idx int, ap_lat double, dt_s double, dx double, snr double")
    many = once.crossJoin(spark.range(20)).drop("id")
    kept, cut = [], TR.cut

    def counting(df):
        done = cut(df)
        kept.append(done.count())
        return done

    monkeypatch.setattr(TR, "cut", counting)
    got = [TR.wind_bins(d, ["capture_id"], "Jupiter", 120.0).orderBy("bin").collect() for d in (once, many)]
    assert max(kept) <= len(base)
    for a, b in zip(*got):
        assert (a["resid"] is None) == (b["resid"] is None) and b["n_tracks"] == 20 * a["n_tracks"] and b["n_frames"] == a["n_frames"]
