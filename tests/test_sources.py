"""Table data sources, the append log and folder readers on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from driftline.sources import append_log as AL
from driftline.sources import readers as RD
from driftline.sources import table_source as TS
from driftline.sources import writers as WR

HEAD = RD.OBSERVATION_COLUMNS


def table(path, sep, rows, head=HEAD, bom=""):
    path.write_text(bom + sep.join(head) + "\n" + "".join(sep.join(r) + "\n" for r in rows), encoding="utf-8")


def observation(date, time="", lon="", lat="", name="GRS", comment=""):
    cells = dict.fromkeys(HEAD, "")
    cells.update(Object=name, Date=date, Time=time, L_II=lon, Lat=lat, Comment=comment)
    return [cells[x] for x in HEAD]


def test_three_separators_in_one_folder(spark, tmp_path):
    table(tmp_path / "a.csv", ",", [observation("2026-01-09", "15:40", '"77,5"', "-19.8", comment='"a ""b"", c"')], bom="﻿")
    table(tmp_path / "b.csv", ";", [observation("09.01.2026", "15:41", "78,5", "x"), observation("??", "15:42", "1")])
    order = [*HEAD[5:], *HEAD[:5]]
    row = dict(zip(HEAD, observation("2026/01/09", "15:43:01", "79")))
    table(tmp_path / "c.txt", "\t", [[row[x] for x in order]], head=[x.upper() for x in order])
    (tmp_path / "_hidden.csv").write_text("nothing")
    (tmp_path / "empty.csv").write_text("")
    got = RD.read_observations(spark, str(tmp_path)).collect()
    assert [(r.L_II, r.Lat) for r in got] == [(77.5, -19.8), (78.5, None), (79.0, None)] and got[0].Comment == 'a "b", c'
    bad = {tuple(r.bad): r.L_II for r in RD.rejected_observations(spark, str(tmp_path)).collect()}
    assert bad == {("Date",): 1.0, ("Lat",): 78.5}
    assert RD.read_observations(spark, str(tmp_path / "*.txt")).count() == 1
    assert TS.listed(str(tmp_path), ["*.tsv"]) == []


def test_rows_of_all_ranges_are_those_of_the_file(spark, tmp_path, monkeypatch):
    rows = [observation(f"2026-01-{1 + i % 28:02}", lon=str(i), comment="é" * (i % 40)) for i in range(300)]
    rows[7] = rows[7][:6]  # short
    rows[8] = [*rows[8], "more", "cells"]  # long
    table(tmp_path / "a.csv", ";", rows)
    data = (tmp_path / "a.csv").read_bytes()
    (tmp_path / "a.csv").write_bytes(data.replace("é".encode() * 5 + b"\n", b"\xff\xfe\n", 1)[:-1])  # not UTF-8; no line end at the end
    TS.register(spark)
    whole = spark.read.format("observation_table").load(str(tmp_path)).orderBy("file", "block", "row").collect()
    assert len(whole) == 300 and [r.L_II for r in whole[:7]] == [str(i) for i in range(7)] and whole[7].L_II is None and whole[8].L_II == "8"
    assert any(r.Comment == "��" for r in whole)
    monkeypatch.setattr(TS, "CHUNK_BYTES", 37)
    want = [(r.Date, r.L_II, r.Comment) for r in whole]
    for split in (1, 50, 333, 100_000):
        reader = TS.TableReader({"path": str(tmp_path), "split_bytes": str(split)}, spark.read.format("observation_table").load(str(tmp_path)).schema, TS.ObservationTable.fields, ["*.csv"])
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        got.sort(key=lambda r: (r["block"], r["row"]))
        assert [(r["Date"], r["L_II"], r["Comment"]) for r in got] == want
    few = spark.read.format("observation_table").schema("L_II string, row int").load(str(tmp_path))
    assert few.columns == ["L_II", "row"] and few.count() == 300


def test_ephemeris_spellings_are_found_in_every_file(spark, tmp_path):
    table(tmp_path / "a.csv", ",", [["2026-01-01 00:00:00", "100.5", "-2.1", "4.5"]], head=["DateTime", "CM_III", "DE", "Delta"])
    table(tmp_path / "b.csv", ";", [["60000", "", "1,5", "7"], ["60001", "2,5", "", ""], ["60002", "", "", ""]], head=["MJD", "CML", "Longitude CM", "North PA"])
    table(tmp_path / "c.csv", "\t", [["2451545.0", "9", "other"]], head=["JD", "cml3", "Observer"])
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"time": "2026-01-02T00:00:00Z", "cm_iii": 12, "np_pa": None}, {"time": "never", "jd": 2451545.0, "cm": 3}]}))
    got = {r.cm: r for r in RD.read_ephemeris(spark, str(tmp_path)).collect()}
    assert set(got) == {100.5, 1.5, 2.5, 9.0, 12.0}  # an unreadable time is no row, whatever else it has
    assert (got[100.5].sub_lat, got[100.5].distance_au, got[1.5].np_pa, got[2.5].np_pa, got[12.0].np_pa) == (-2.1, 4.5, 7.0, 0.0, 0.0)
    assert got[9.0].t_us == 946728000000000 and got[1.5].t_us == (60000 - 40587) * 86400 * 10**6


def written(spark, n, mark):
    return spark.range(n).select(F.concat(F.lit(mark), F.col("id").cast("string")).alias("Comment"), F.lit("a;b").alias("Object"), F.lit(1).alias("other"))


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    WR.write_observations(written(spark, 5, "x"), path, sep=";")
    WR.write_observations(written(spark, 3, "y"), path, sep="\t", mode="append")

    def now():
        return sorted(r.Comment for r in RD.observation_cells(spark, path).collect())

    want = [f"x{i}" for i in range(5)] + [f"y{i}" for i in range(3)]
    assert now() == want
    # the data files are there, the switch never comes
    TS.TableWriter({"path": path}, HEAD, True).write(iter(written(spark, 4, "z").toArrow().to_batches()))
    assert now() == want
    fails = written(spark, 4, "z").withColumn("Comment", F.when(F.col("Comment") == "z3", F.raise_error(F.lit("lost"))).otherwise(F.col("Comment")))
    with pytest.raises(Exception, match="lost"):
        WR.write_observations(fails, path)
    assert now() == want
    WR.write_observations(written(spark, 2, "w"), path)
    assert now() == ["w0", "w1"]
    WR.write_observations(written(spark, 2, "w").where("false"), path)
    assert now() == []


CASE = "idx bigint, ok boolean, n bigint"


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def test_the_last_record_wins_over_three_segments(spark, tmp_path):
    log = AL.AppendLog(spark, str(tmp_path / "log"))
    assert log.latest("idx", CASE).count() == 0
    log.append_lines(lines(spark, '{"idx":1,"n":1}', '{"idx":2,"n":1}', "not json", '{"idx":1,"n":2}'))
    log.append_lines(lines(spark, '{"idx":2,"n":2}', '{"idx":2', '{"n":5}', '{"idx":3,"n":1}', ""))
    log.append(spark.range(1000).select(F.lit(4).alias("idx"), F.col("id").alias("n"), F.lit(True).alias("ok")).repartitionByRange(7, "n").sortWithinPartitions("n"))
    assert {r.idx: r.n for r in log.latest("idx", CASE).collect()} == {1: 2, 2: 2, 3: 1, 4: 999}
    assert sorted(r.value for r in log.bad_lines(CASE).collect()) == ["not json", '{"idx":2']
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert {r.idx: r.n for r in log.latest("idx", CASE).collect()}[4] == 999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    log.compact("idx", CASE)
    assert len(log.segments()) == 1 and {r.idx: r.n for r in log.latest("idx", CASE).collect()} == {1: 2, 2: 2, 3: 1, 4: 999}


def test_a_run_that_dies_before_the_switch_leaves_the_old_state(spark, tmp_path, monkeypatch):
    log = AL.AppendLog(spark, str(tmp_path / "log"))
    one, two = (spark.range(n).select(F.col("id").alias("idx"), F.lit(n).cast("bigint").alias("n")) for n in (3, 5))
    assert log.append(one, token="night 1")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(log, "_switch", dies)
        with pytest.raises(KeyboardInterrupt):
            log.append(two, token="night 2")
    assert log.latest("idx", CASE).count() == 3 and len(os.listdir(tmp_path / "log")) == 3  # two segments, one of them stray
    assert log.append(two, token="night 2") and not log.append(two, token="night 2") and not AL.AppendLog(spark, log.folder).append(one, token="night 1")
    assert sorted((r.idx, r.n) for r in log.latest("idx", CASE).collect()) == [(i, 5) for i in range(5)]
    assert log.vacuum() == 1 and log.latest("idx", CASE).count() == 5


def test_two_writers_cannot_take_one_version(spark, tmp_path, monkeypatch):
    a, b = (AL.AppendLog(spark, str(tmp_path / "log")) for _ in range(2))
    row = spark.range(1).select(F.col("id").alias("idx"))
    a.append(row)
    with pytest.raises(AL.Conflict):
        b._switch(1, [], [])
    state, turns = b.state, []

    def late():  # the other writer commits between the look and the switch
        now = state()
        if len(turns) == 0:
            turns.append(a.append(row))
        return now

    monkeypatch.setattr(b, "state", late)
    assert b.append(row)
    assert [s["n"] for s in a.segments()] == [1, 2, 3] and a.lines().count() == 3


def test_resume_asks_for_missing_failed_and_changed_cases(spark, tmp_path):
    log = AL.AppendLog(spark, str(tmp_path / "log"))
    matrix = spark.range(6).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("n"))
    done = matrix.select("idx", "n", (F.col("idx") != 1).alias("ok")).where("idx < 4").withColumn("n", F.when(F.col("idx") == 2, -1).otherwise(F.col("n")))
    log.append(done)
    todo = AL.resume(matrix, log, CASE, "idx", ["n"])
    assert sorted(r.idx for r in todo.collect()) == [1, 2, 4, 5]
    log.append(todo.withColumn("ok", F.lit(True)))
    assert AL.resume(matrix, log, CASE, "idx", ["n"]).count() == 0


def test_cache_files_go_by_name_and_place(spark, tmp_path):
    (tmp_path / "c1.jsonl").write_text('{"idx":1,"n":1}\n{"idx":2,"n":1}\nbad\n')
    (tmp_path / "c2.jsonl").write_text('{"idx":1,"n":5}\n{"idx":1,"n":4}\n')
    (tmp_path / "c3.jsonl").write_text('{"idx":1,"n":3}\n{"idx":1,"n":2}')
    assert {r.idx: r.n for r in RD.read_campaign_cache(spark, str(tmp_path), CASE).collect()} == {1: 2, 2: 1}


def test_captures_from_folders_globs_and_lists(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.SER", "a.avi", "c.txt", "deep/d.ser"):
        (tmp_path / name).write_text("x")

    def names(*paths, **kw):
        return [r.path.rsplit("/", 1)[1] for r in RD.discover_captures(spark, list(paths), (".ser", "avi"), **kw).collect()]

    root = str(tmp_path)
    assert names(root) == ["a.avi", "b.SER", "d.ser"] and names(root, recursive=False) == ["a.avi", "b.SER"]
    assert names(f"{root}/*.SER", f"{root}/a.avi", f"{root}/a.avi", f"{root}/c.txt") == ["a.avi", "b.SER"]


def test_epoch_documents_of_nested_folders(spark, tmp_path):
    for k, (name, doc) in enumerate({
        "s1/x_research.json": {"publish": {"lon": 10.0, "lat": -20.0}, "headline": {"sigma": 0.5}},
        "s1/x_vlbi.json": {"headline": {"lon": 99.0, "lat": -20.0}},
        "s2/deep/y_vlbi.json": {"result": {"lon_iii_deg": 30.0, "lat_deg": -21.0}},
        "s2/deep/z_vlbi.json": {"headline": {"lon": 1.0}},
        "s3/bad.json": None,
    }.items()):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc, indent=1) if doc else "{oops")
    got = {(r.series_id, r.lon, r.sigma) for r in RD.read_epochs(spark, str(tmp_path)).collect()}
    assert got == {("s1", 10.0, 0.5), ("deep", 30.0, 0.2)}


def test_package_times_and_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in [
        {"time_utc": "2026-01-09 15:40:00", "lon_iii_deg": 1.23456, "lat_deg": -19.5, "method": "M"}, {"utc_iso": "2026-01-09T15:41:00Z", "lon_iii_deg": 2.0, "length_deg": 15.0}, {"lon_iii_deg": 3.0},
    ]))
    WR.export_packages(RD.read_packages(spark, str(tmp_path / "p.json")), str(tmp_path / "out"), {"Observer": "me"})
    got = RD.read_observations(spark, str(tmp_path / "out")).collect()
    assert [(r.Time, r.L_III, r.Lat, r.Length, r.Method, r.Observer) for r in got] == [("15:40:00", 1.235, -19.5, None, "M", "me"), ("15:41:00", 2.0, None, 15.0, "GS-ORANGE", "me")]


def test_the_last_of_more_than_a_thousand_files_of_one_task_wins(spark, tmp_path):
    log = AL.AppendLog(spark, str(tmp_path / "log"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        log.append(spark.range(1003, numPartitions=1).selectExpr("7 AS idx", "id AS n"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [tuple(r) for r in log.latest("idx", "idx bigint, n bigint").collect()] == [(7, 1002)]
