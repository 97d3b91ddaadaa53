"""Late rows, files in any order, corrected records, and runs that go on from their checkpoints."""

import math
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.streaming import jobs as J

POINTS = "series_id bigint, t_us bigint, ord bigint, lon double, sigma double"
HOUR = 3_600_000_000


def put(folder, name, rows, columns, **types):
    folder.mkdir(exist_ok=True)
    pd.DataFrame(rows, columns=columns).astype(types).to_parquet(folder / name)
    time.sleep(0.02)  # files are taken in modification order


def test_late_rows_are_dropped(spark, tmp_path):
    d = tmp_path / "in"
    kind = {"ts": "datetime64[us]"}
    put(d, "a.parquet", [("2024-01-01 00:01", "x"), ("2024-01-01 03:00", "x")], ["ts", "action"], **kind)
    folder = str(tmp_path / "job")

    def run():
        s = J.read_stream(spark, str(d), "*.parquet", "ts timestamp, action string", files_per_batch=1)
        w = J.usage_windows(s, "ts", "1 hour", "10 minutes").select(F.hour("w.start").alias("h"), "action", "n")
        return {(r.h, r.n) for r in J.run_available(w, "append", folder).collect()}

    assert run() == {(0, 1)}
    put(d, "b.parquet", [("2024-01-01 00:30", "x"), ("2024-01-01 06:00", "x")], ["ts", "action"], **kind)
    assert run() == {(0, 1), (3, 1)}


def batch_filter(rows):
    out, st = [], {}
    for s, t, o, z, r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if s in st and t <= st[s][0]:
            out.append((s, t, o, "tied", None, None))
            continue
        st[s] = J.filter_step(st.get(s), t, z, r)
        out.append((s, t, o, "applied", st[s][1] % 360.0, st[s][6]))
    return out


def tracked(spark, folder, delay, job=None):
    s = J.read_stream(spark, str(folder), "*.parquet", POINTS, files_per_batch=1)
    return J.run_track(s, delay, job).where("series_id > 0").collect()


def same(got, want):
    got = sorted((r.series_id, r.t_us, r.ord, r.status, r.pos, r.n) for r in got)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want)]
    for a, b in zip(got, sorted(want)):
        assert (a[4] is None and b[4] is None) or (math.isclose(a[4], b[4], abs_tol=1e-9) and a[5] == b[5])


ROWS = [(s, i * HOUR, i, (350.0 + 0.5 * i * s) % 360.0, 0.3) for i in range(100) for s in (1, 2, 3)] + [(1, 5 * HOUR, 1000, 1.0, 0.3), (2, 70 * HOUR, 1001, 9.0, 0.3)]
END = [(-1, 10**15, 0, 0.0, 1.0)]


@pytest.mark.parametrize("order", [[0], [2, 0, 1, 4, 3]])
def test_track_of_files_in_any_order_is_the_batch_filter(spark, tmp_path, order):
    part = lambda r: r[1] // HOUR // 20 if len(order) > 1 else 0
    for n, k in enumerate(order):
        put(tmp_path / "in", f"{n}.parquet", [r for r in ROWS if part(r) == k], POINTS.replace(" bigint", "").replace(" double", "").split(", "))
    put(tmp_path / "in", "9.parquet", END, ["series_id", "t_us", "ord", "lon", "sigma"])
    got = tracked(spark, tmp_path / "in", "45 hours")
    same(got, batch_filter(ROWS))
    rate = next(r.rate for r in got if r.series_id == 1 and r.t_us == 99 * HOUR)
    assert abs(rate - 12.0) < 0.5


def test_late_tied_and_blank_points_are_given_out(spark, tmp_path):
    names = ["series_id", "t_us", "ord", "lon", "sigma"]
    first = [(1, i * HOUR, i, 10.0 + i, 0.3) for i in range(10)]
    put(tmp_path / "in", "0.parquet", first, names)
    put(tmp_path / "in", "1.parquet", [(2, 10 * HOUR, 0, 1.0, 0.3)], names)  # moves the watermark to 9 h
    job = str(tmp_path / "job")
    assert {r.status for r in tracked(spark, tmp_path / "in", "1 hour", job)} == {"applied"}
    # a second run goes on from the checkpoint: 3 h is late, 9 h is tied, 9.5 h is in order although the watermark is near
    late = [(1, 3 * HOUR, 100, 50.0, 0.3), (1, 9 * HOUR, 101, 50.0, 0.3), (1, 9 * HOUR + HOUR // 2, 102, 19.5, 0.3), (1, 11 * HOUR, 103, None, 0.3)]
    put(tmp_path / "in", "2.parquet", late, names)
    put(tmp_path / "in", "3.parquet", END, names)
    got = {r.ord: r for r in tracked(spark, tmp_path / "in", "1 hour", job) if r.series_id == 1}
    assert [got[k].status for k in (100, 101, 102, 103)] == ["late", "tied", "applied", "blank"]
    assert [got[k].status for k in range(10)] == ["applied"] * 10 and got[102].n == 11 and len(got) == 14


RECORDS = "idx bigint, line string, resolution string, quality string, ok boolean, dlon double, dlat double"


def test_progress_follows_corrected_records_batch_by_batch(spark, tmp_path):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    files = [
        [(1, "a1", "low", "q", True, 0.1, 0.1), (2, "a2", "low", "q", False, 0.1, 0.1), (3, "a3", "high", "q", True, 0.7, 0.1)],
        [(2, "b1", "low", "q", True, 0.1, 0.1), (1, "a0", "high", "q", False, 9.0, 9.0)],  # a correction, and an older record
        [(1, "c1", "high", "q", True, 3.0, 0.1), (1, "c1", "high", "q", True, 3.0, 0.1), (4, "c2", "low", "q", True, 0.2, 0.2), (4, "c3", "low", "p", True, 0.2, 0.2)],
    ]
    last, job = {}, str(tmp_path / "job")
    for n, rows in enumerate(files):
        put(tmp_path / "in", f"{n}.parquet", rows, names)
        s = J.read_stream(spark, str(tmp_path / "in"), "*.parquet", RECORDS, files_per_batch=1)
        got = J.latest(J.campaign_stream(s, ["resolution", "quality"], job), ["resolution", "quality"])
        for r in rows:
            last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[1])
        want = {}
        for _, _, res, q, ok, a, b in last.values():
            w = want.setdefault((res, q), [0, 0, 0, 0])
            for k, x in enumerate((True, ok, ok and max(abs(a), abs(b)) <= 0.5, ok and max(abs(a), abs(b)) <= 1.0)):
                w[k] += x
        assert {(r.resolution, r.quality): [r.n, r.n_ok, r.n_05, r.n_10] for r in got.where("n > 0").collect()} == want


def test_a_set_of_many_files_is_one_batch(spark):
    from driftline.plans import stream_queries as SQ

    rows = spark.range(600).repartition(6)
    job = lambda s, folder: J.run_available(s, "append", folder)
    got = SQ.arriving(rows, F.col("id") % 3, [2, 0, 1], job).groupBy("batch_id").agg(F.collect_set(F.col("id") % 3).alias("k"), F.count("*").alias("n"))
    assert sorted((r.batch_id, r.k, r.n) for r in got.collect()) == [(0, [2], 200), (1, [0], 200), (2, [1], 200)]


def test_many_keys_share_few_states(spark, tmp_path, monkeypatch):
    """A key of its own cost milliseconds a batch; null, repeated and corrected keys of one bucket stay apart."""
    monkeypatch.setattr(J, "BUCKETS", 2)
    monkeypatch.setattr(J, "PART", 7)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    big = 1 << 60
    files = [[(big + i, f"a{i:03}", "low", "q", True, 0.1, 0.1) for i in range(50)], [(big + i, f"b{i:03}", "high", "q", i % 2 == 0, 0.1, 0.1) for i in range(0, 50, 5)]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows + [(None, f"{n}", "none", "q", True, 0.1, 0.1)] * 2, RECORDS).select(names).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    s = J.read_stream(spark, f"{tmp_path}/in/*", "*.parquet", RECORDS, files_per_batch=1)
    job = str(tmp_path / "job")
    got = J.latest(J.campaign_stream(s, ["resolution", "quality"], job), ["resolution", "quality"])
    assert {(r.resolution, r.n, r.n_ok) for r in got.collect()} == {("low", 40, 40), ("high", 10, 5), ("none", 1, 1)}
    keys = {r.idx for r in spark.read.parquet(f"{job}/changes").collect()}
    assert keys == {None, *(big + i for i in range(50))}
