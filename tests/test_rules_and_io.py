"""Literal rows: missing values, seams, ties; and write-read round trips."""

import math

import pandas as pd
from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import optics as O
from driftline.functions import parsing as P
from driftline.functions import timebase as T
from driftline.operators import hits as H
from driftline.operators import rules as RU
from driftline.plans import pixel_queries as PQ
from driftline.plans.tables import Tables
from driftline.sources import readers as RD
from driftline.sources import writers as WR


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_angles_and_missing_values(spark):
    r = one(
        spark, a=A.wrap_deg(-10.0), d=A.wrap_diff(5.0, 355.0), e=A.wrap_diff(180.0, 0.0), sky=A.sky_error_arcsec(1.0, 1.0, -20.0, -1.0),
        nan=A.finite(float("nan")), limb=O.limb_law(F.lit(None).cast("double")), km=A.km_per_deg_lat(0.0), pole=A.km_per_deg_lat(90.0))
    assert r.a == 350.0 and abs(r.d - 10.0) < 1e-12 and r.e == -180.0 and r.sky is None and r.nan is None and r.limb is None
    assert abs(r.km - 1247.8) < 0.1 and abs(r.pole - 1166.8) < 0.1


def test_frame_offset_anchor(spark):
    ts = F.lit("2000-01-01 11:58:55.816").cast("timestamp_ntz")
    assert abs(one(spark, o=T.system_offset_deg(ts, "II")).o + 241.65) < 1e-4
    ts = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")
    r = one(spark, a=T.iii_to_ii(13.35, ts), b=T.ii_to_iii(T.iii_to_ii(123.4, ts), ts))
    assert abs(r.a - 85.46) < 0.05 and abs(r.b - 123.4) < 1e-9


def test_text_parsing(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    r = one(
        spark, x=P.angle_deg(F.lit("-12 30 00")), y=P.angle_deg(F.lit("01:30:00"), True), bad=P.angle_deg(F.lit("abc")),
        mm=P.aperture_m(F.lit("355,6 mm")), t=P.instant_from_name_us(F.lit("2026-01-09-1540_x.fit")), f=P.filter_from_name(F.lit("run_IR742_1")))
    assert r.x == -12.5 and r.y == 22.5 and r.bad is None and abs(r.mm - 0.3556) < 1e-12 and r.f == "IR742"
    assert r.t == int(pd.Timestamp("2026-01-09 15:40:00").value // 1000)


def test_outlier_is_rejected_but_two_methods_are_kept(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0), (1, 2, 12.0), (1, 3, 110.0), (2, 1, 10.0), (2, 2, 200.0), (3, 1, 359.0), (3, 2, 2.0), (3, 3, 5.0)],
        "case_id int, ord int, lon double")
    r = {(x.case_id, x.ord): x.kept for x in H.reject_lon_outliers(df, ["case_id"], "lon", "ord").collect()}
    assert r == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): True, (2, 2): True, (3, 1): True, (3, 2): True, (3, 3): True}


def test_spread_without_pairs_equals_pairs(spark):
    rows = [(1, x, float(i)) for i, x in enumerate((0.0, 10.0, 170.0, 181.0, 355.0))] + [(2, 5.0, 1.0)]
    r = {x.case_id: x for x in H.max_spread(spark.createDataFrame(rows, "case_id int, lon double, lat double"), ["case_id"], "lon", "lat").collect()}
    lons = [x[1] for x in rows[:5]]
    want = max(abs((a - b + 180) % 360 - 180) for a in lons for b in lons)
    assert abs(r[1].lon_spread - want) < 1e-9 and r[1].lat_spread == 4.0 and r[2].lon_spread == 0.0


def consensus(spark, rows, **more):
    from driftline.operators import consensus as CO

    names = "case_id int, ord int, method_id string, family string, lon double, lat double, prior_weight double, cm double, pipe_lon double, pipe_lat double"
    return {r.case_id: r for r in CO.robust_consensus(spark.createDataFrame(rows, names), ["case_id"], [], **more).collect()}


def test_consensus_prefers_the_supported_cluster(spark):
    rows = [(1, i, f"m{i}", f"f{i}", 100 + i * 0.5, -21.0 - 0.1 * i, 1.0, 90.0, 101.0, -21.0) for i in range(6)]
    rows.append((1, 6, "far", "x", 220.0, -21.0, 1.2, 90.0, 101.0, -21.0))
    rows.append((2, 0, "m0", "f0", 359.0, -21.0, 1.0, None, None, None))  # alone
    rows.append((3, 0, "m0", "f0", 180.0, -21.0, 1.0, 90.0, None, None))  # at the map's edge
    rows += [(4, i, f"m{i}", "f", 50.0 + i * 0.1, -22.0, 5.0 - i * 0.1, None, None, None) for i in range(9)]
    rows += [(5, 0, "m0", "f0", 359.0, -22.0, 1.0, None, None, None), (5, 1, "m1", "f1", 1.0, -22.0, 1.0, None, None, None)]
    r = consensus(spark, rows)
    assert abs(r[1].lon - 101.2) < 1.0 and r[1].n_in == 6 and r[1].n_clusters == 2 and r[1].outliers == "far"
    assert abs(sum(w.weight for w in r[1].weights) - 1.0) < 1e-9 and 1.0 <= r[1].n_eff <= 6.0
    assert (r[2].lon, r[2].n_in, r[2].inliers, r[2].score) == (359.0, 1, "m0", None)
    assert r[3].lon is None and r[3].n_in is None and r[3].outliers == "m0"
    assert r[4].cut == ""  # two of nine would be too few, so the family limit does not apply
    assert abs((r[5].lon + 180.0) % 360.0 - 180.0) < 1e-6 and r[5].n_in == 2  # across the seam
    low = consensus(spark, rows[-11:-2], least=1)
    assert low[4].cut == ",".join(f"m{i}" for i in range(2, 9)) and low[4].n_in == 2


def test_consensus_of_no_hits(spark):
    assert consensus(spark, []) == {}


def test_observation_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1767973166000000, 123.4567, -19.5, 77.0), (1767973266000000, 10.0, None, math.nan), (None, 1.0, 1.0, 1.0)],
        "t_us bigint, lon_iii double, lat double, lon_ii double")
    path = str(tmp_path / "obs")
    WR.write_observations(WR.measurement_rows(df, {"Observer": "me"}), path)
    back = RD.read_observations(spark, path).collect()
    assert [r.L_III for r in back] == [123.457, 10.0] and back[1].Lat is None and back[1].L_II is None
    assert RD.drift_points(RD.read_observations(spark, path)).count() == 1


def test_semicolon_table_with_commas_and_bad_dates(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text(";".join(RD.OBSERVATION_COLUMNS) + "\nGRS;09.01.2026;15:40;me;;;;77,5;;-19,8;;;;;\nOther;x;;me;;;;1;;;;;;;\n")
    r = RD.read_observations(spark, str(f)).collect()
    assert len(r) == 1 and r[0].L_II == 77.5 and r[0].Lat == -19.8


def test_campaign_cache_last_line_wins(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"idx":1,"ok":false}\nnot json\n{"idx":2,"ok":true}\n{"idx":1,"ok":true}\n')
    r = {x.idx: x.ok for x in RD.read_campaign_cache(spark, str(f), "idx bigint, ok boolean").collect() if x.idx is not None}
    assert r == {1: True, 2: True}


def test_usage_keeps_bad_lines_and_append_adds(spark, tmp_path):
    d = str(tmp_path / "u")
    WR.append_lines(spark.createDataFrame([("a",)], "action string"), d)
    WR.append_lines(spark.createDataFrame([("b",)], "action string"), d)
    (tmp_path / "u" / "x.json").write_text("{oops\n")
    rows = RD.read_usage(spark, d).collect()
    assert sorted(r.action for r in rows if r.action) == ["a", "b"] and [r.raw for r in rows if r.raw] == ["{oops"]


def test_geometric_median_and_border_surface(spark):
    import numpy as np

    t = Tables(spark, "/root/testdata/sf0.001")
    q = PQ.IM.border_quadratic(t.frames.limit(3), 8, 8, PQ.FRAME).toPandas()
    data = {r.frame_idx: np.array(r.data).reshape(8, 8) for r in t.frames.limit(3).collect()}
    for _, r in q.iterrows():
        im = data[r.frame_idx]
        yy, xx = np.mgrid[0:8, 0:8].astype(float)
        b = (yy < 0.4) | (yy > 7.6) | (xx < 0.4) | (xx > 7.6)
        X = np.column_stack([np.ones(b.sum()), xx[b], yy[b], xx[b] ** 2, xx[b] * yy[b], yy[b] ** 2])
        fit = X @ r[["a", "b", "c", "d", "e", "f"]].to_numpy(float)
        assert np.allclose(fit, X @ np.linalg.lstsq(X, im[b], rcond=None)[0], atol=1e-8)


def test_iterated_centres_find_the_dense_group(spark):
    from driftline.operators import images as IM

    data = [1.0] * 64
    for i in (9, 10, 17, 18, 25, 63):  # a dark block around (x 1.5, y 2) and one far pixel
        data[i] = 0.1
    df = spark.createDataFrame([(1, 1, data)], "capture_id int, frame_idx int, data array<double>")
    flat = spark.createDataFrame([(1, 2, [0.0] * 64)], df.schema)
    r, none = IM.iterated_centres(df.union(flat), 8, ["capture_id", "frame_idx"], perc=5.0, shift_perc=5.0, least=(3, 3, 3), part=1).orderBy("frame_idx").collect()
    assert r.n == 6 and abs(r.gx - 1.4) < 0.6 and abs(r.gy - 2.0) < 0.6  # the geometric median resists the far pixel
    assert r.mx < 2.0 and r.my < 3.0  # the mode sits in the block
    assert min(r.k0, r.k1) < 2.5 and r.dx < 2.5 and r.split_ok
    assert none.n == 0 and none.gx is None and none.mx is None and none.dx is None and not none.median_ok


def test_time_comes_from_the_base_name(spark):
    from pyspark.sql import functions as F

    from driftline.functions import parsing

    row = spark.createDataFrame([("/data/2026-01-09-1540/run_20260110T010203.ser",)], "n string").select(parsing.instant_from_name_us("n").alias("t"))
    assert row.select(F.timestamp_micros("t").cast("string")).first()[0] == "2026-01-10 01:02:03"


def test_limit_counts_the_frames_given_out(spark):
    from driftline.sources import readers

    rows = [(1, 300 + i, [1.0, 3.0, 5.0, 7.0] * 2) for i in range(20)]
    frames = spark.createDataFrame(rows, "capture_id long, frame_idx long, data array<double>")
    got = readers.sampled_frames(frames, 3, 4, 2, 2).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == [300, 303, 306, 309] and list(got[0]["data"]) == [4.0, 4.0]


def test_a_spread_on_its_limit_has_one_verdict_however_rows_are_spread(spark):
    """Sample deviations of exactly 0.45 but for the last bit, which follows the order of the rows."""
    lats = [-30.3, -25.8, -24.3, -19.8, -10.8, -9.3, -7.8]
    mean = square = 0.0
    for i, lat in enumerate(lats):
        x = (lat + 19.8) * 0.05
        d = x - mean
        mean += d / (i + 1)
        square += d * (x - mean)
    want = math.sqrt(square / (len(lats) - 1)) <= 0.45
    rows = spark.createDataFrame([(1, i, lat) for i, lat in enumerate(lats)], "k int, ord int, lat double")
    for parts in (1, 3, len(lats)):
        r = RU.spread_flags(rows.orderBy(F.desc("ord")).repartition(parts), ["k"], F.lit(0.1), (F.col("lat") + 19.8) * 0.05, "ord").first()
        assert (r.n, round(r.sigma_lat, 9), r.stable) == (len(lats), 0.45, want)
