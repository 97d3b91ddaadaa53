"""Streaming jobs. Results go to files per batch; a replayed batch overwrites its own folder, so retries are safe."""

from __future__ import annotations

import io
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

c = F.col


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the session's shared checkpoint folder; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="driftline-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, fmt: str = "parquet", files_per_batch: int | None = None):
    r = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder)


def run_available(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Process everything available and return what was emitted, with the batch number of each row."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    q.awaitTermination()
    return spark.read.schema(f"{stream_schema(stream)}, batch_id bigint").option("basePath", out).parquet(out)


def stream_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted version per key of an update-mode job."""
    rest = [x for x in rows.columns if x not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def usage_windows(events: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Counts by action per tumbling window; a window is final once the watermark has passed its end."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))


def last_seen(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s"), F.count(F.lit(1)).alias("n"))


def last_case_state(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("s"))


def campaign_progress(cases: DataFrame, cell: list[str]) -> DataFrame:
    """Running counts and pass rates per cell over the last state of every case."""
    both = lambda x: (F.abs("dlon") <= x) & (F.abs("dlat") <= x) & c("ok")
    return cases.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(both(0.5)).alias("n_05"), F.count_if(both(1.0)).alias("n_10"))


def stack_accumulators(px: DataFrame) -> DataFrame:
    return px.groupBy("capture_id", "y", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s1"), F.sum(c("v") * c("v")).alias("s2"), F.sum("w").alias("sw"),
        F.sum(c("w") * c("v")).alias("swv"))


def stack_from_accumulators(acc: DataFrame) -> DataFrame:
    mean = c("s1") / c("n")
    return acc.select(
        "capture_id", "y", "x", "n", mean.alias("mean"), (c("swv") / c("sw")).alias("weighted"),
        F.greatest(c("s2") / c("n") - mean * mean, F.lit(0.0)).alias("var"))


RECORD = "resolution string, quality string, ok boolean, dlon double, dlat double"


LAST_FIELDS = ["resolution", "quality", "ok", "dlon", "dlat"]
CHANGES = f"idx bigint, sign int, {RECORD}"

#: Keys share their Python state by the hash of the key, since each call and each look into the state costs milliseconds, whatever it holds.
#: Checkpoints depend on it. At most `PART` rows are one value of a state.
BUCKETS, PART = 1024, 50_000


def bucket(key: str) -> Column:
    """The bucket of a key. Null has its own, as pandas turns integers among nulls into doubles."""
    return F.when(c(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS))).alias("bucket")


def held_rows(state) -> pd.DataFrame | None:
    """The rows that a list state holds, as Arrow files in parts."""
    parts = [pd.read_feather(io.BytesIO(x[0])) for x in state.get()]
    return pd.concat(parts, ignore_index=True) if parts else None


def as_parts(rows: pd.DataFrame) -> list[tuple[bytes]]:
    out = []
    for i in range(0, len(rows), PART):
        file = io.BytesIO()
        rows.iloc[i : i + PART].reset_index(drop=True).to_feather(file, compression="lz4")
        out.append((file.getvalue(),))
    return out


class LastRecord(StatefulProcessor):
    """Keeps the last record of each case and says what changed: the old record goes out (sign -1), the new one comes in (+1).

    A record counts if its order text is greater than that of the one held; equal or smaller ones change nothing, so files may come
    in any order and more than once. One state holds the cases of a bucket.
    """

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["idx", "line", *LAST_FIELDS]
        best = None
        for f in rows:
            f = f[names].dropna(subset=["line"])
            f = f if best is None else pd.concat([best, f], ignore_index=True)
            best = f.sort_values("line", kind="stable").drop_duplicates("idx", keep="last")
        if best is None or not len(best):
            return
        old = held_rows(self.held)
        if old is None:
            gone, new, kept = best.iloc[:0], best, best
        else:
            at = pd.Index(old["idx"]).get_indexer(best["idx"])
            known = at >= 0
            ahead = ~known
            ahead[known] = best["line"].to_numpy()[known] > old["line"].to_numpy()[at[known]]
            if not ahead.any():
                return
            out = at[ahead & known]
            gone, new = old.iloc[out], best[ahead]
            kept = pd.concat([old.drop(index=out), new], ignore_index=True)
        self.held.put(as_parts(kept))
        yield pd.concat([new.assign(sign=1), gone.assign(sign=-1)], ignore_index=True)[["idx", "sign", *LAST_FIELDS]]

    def close(self) -> None:
        pass


def record_changes(rows: DataFrame) -> DataFrame:
    """Signed changes of the last record per idx; columns idx, line (text that sorts as the records do) and the record's fields."""
    return rows.withColumn("bucket", bucket("idx")).groupBy("bucket").transformWithStateInPandas(LastRecord(), CHANGES, "append", "none")


def progress_of_changes(changes: DataFrame, cell: list[str]) -> DataFrame:
    """Running counts and pass rates per cell; what goes out is taken off, so a corrected record counts once, where it is now."""
    one = lambda x: F.sum(F.when(x, c("sign")).otherwise(0))
    both = lambda x: (F.abs("dlon") <= x) & (F.abs("dlat") <= x) & c("ok")
    return changes.groupBy(*cell).agg(F.sum("sign").alias("n"), one(c("ok")).alias("n_ok"), one(both(0.5)).alias("n_05"), one(both(1.0)).alias("n_10"))


def campaign_stream(rows: DataFrame, cell: list[str], folder: str | None = None) -> DataFrame:
    """Progress per cell after each batch: one job appends the changes of every batch to a folder, a second one sums them as they come.

    Both resume from their checkpoints in `folder`; Spark's file sink takes a batch of changes once.
    """
    spark = rows.sparkSession
    folder = folder or work_folder(spark)
    with rocksdb(spark):
        q = record_changes(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/changes-cp").trigger(availableNow=True).start(f"{folder}/changes")
        q.awaitTermination()
    changes = spark.readStream.schema(CHANGES).parquet(f"{folder}/changes")
    return run_available(progress_of_changes(changes, cell), "update", f"{folder}/progress")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that arbitrary state needs, for queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


FILTER = "series_id bigint, t_us bigint, x double, v double, p00 double, p01 double, p11 double, n bigint"
WAITING = "series_id bigint, t_us bigint, ord bigint, lon double, sigma double"
TRACKED = "series_id bigint, t_us bigint, ord bigint, status string, pos double, rate double, sigma double, n bigint"


def filter_step(st: tuple | None, t_us: int, z: float, r: float) -> tuple:
    """Position and rate after one more point; the state is (t_us, x, v, p00, p01, p11, n)."""
    s = max(float(r), 1e-6)
    if st is None:
        x, v, a, b, d, n = float(z), 0.0, s * s + 0.1, 0.0, 1.0, 0
    else:
        t0, x, v, a, b, d, n = st
        h, q = max((t_us - t0) / 86400e6, 1e-9), 1e-6 * max(float(r), 0.05) ** 2
        x = x + h * v
        a, b, d = a + 2 * h * b + h * h * d + q * h**3 / 3, b + h * d + q * h * h / 2, d + q * h
    e = (float(z) - x + 180.0) % 360.0 - 180.0
    g = a + s * s
    k0, k1 = a / g, b / g
    return t_us, x + k0 * e, v + k1 * e, (1 - k0) * a, (1 - k0) * b, d - k1 * b, n + 1


class OnlineTrack(StatefulProcessor):
    """Forward position/rate filter in event time.

    Points wait until the watermark has passed them and are then applied in the order of (t_us, ord). A timer stands at the earliest
    point that waits. No point vanishes: one before the last applied is given out as `late`, one at the same time as `tied`,
    one without a position or sigma as `blank`; they leave the state alone. One state holds the series of a bucket.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state, self.waiting = handle.getListState("filter", "rows binary"), handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            bare = f[["t_us", "lon", "sigma"]].isna().any(axis=1)
            if bare.any():
                yield tracked(f.loc[bare, ["series_id", "t_us", "ord"]].assign(status="blank"))
            new = f.loc[~bare, [x.split()[0] for x in WAITING.split(", ")]]
            if len(new):
                self.waiting.appendList(as_parts(new.astype({"series_id": "Int64", "t_us": "int64", "ord": "int64"})))
        yield from self._advance(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues)

    def _advance(self, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = held_rows(self.waiting)
        if rows is None:
            return
        due = rows["t_us"] <= mark
        ready, rest = rows[due].sort_values(["series_id", "t_us", "ord", "lon", "sigma"]), rows[~due]
        if len(ready):
            old = held_rows(self.state)
            names = [x.split()[0] for x in FILTER.split(", ")]
            states = {} if old is None else dict(zip(old["series_id"].astype(object), zip(*(old[n].tolist() for n in names[1:]))))
            out = []
            for s, t, z, r in zip(ready["series_id"].astype(object), ready["t_us"].tolist(), ready["lon"].tolist(), ready["sigma"].tolist()):
                st = states.get(s)
                if st is not None and t <= st[0]:
                    out.append(("tied" if t == st[0] else "late", None, None, None, None))
                    continue
                states[s] = st = filter_step(st, t, z, r)
                out.append(("applied", st[1] % 360.0, st[2], math.sqrt(max(st[3], 0.0)), st[6]))
            new = pd.DataFrame([(s, *st) for s, st in states.items()], columns=names).astype({"series_id": "Int64"})
            self.state.put(as_parts(new))
            if len(rest):
                self.waiting.put(as_parts(rest))
            else:
                self.waiting.clear()
            said = pd.DataFrame(out, columns=["status", "pos", "rate", "sigma", "n"], index=ready.index)
            yield tracked(ready[["series_id", "t_us", "ord"]].join(said))
        if len(rest):
            self.handle.registerTimer(-(-int(rest["t_us"].min()) // 1000))

    def close(self) -> None:
        pass


def tracked(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in the form that goes out."""
    names = [x.split()[0] for x in TRACKED.split(", ")]
    whole = {"series_id": "Int64", "t_us": "Int64", "ord": "Int64", "n": "Int64"}
    return rows.reindex(columns=names).astype({**whole, "pos": "float64", "rate": "float64", "sigma": "float64"})


def online_track(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tracked points per series; columns series_id, t_us, ord, lon, sigma. `delay` is how late a point may come and still be applied."""
    marked = points.withColumn("_at", F.timestamp_micros("t_us")).withWatermark("_at", delay)
    # the time column itself stays behind: late rows have to reach the processor, which gives them out
    rows = marked.select("series_id", "t_us", "ord", "lon", "sigma", bucket("series_id"))
    return rows.groupBy("bucket").transformWithStateInPandas(OnlineTrack(), TRACKED, "append", "eventTime")


def run_track(points: DataFrame, delay: str, folder: str | None = None) -> DataFrame:
    with rocksdb(points.sparkSession):
        return run_available(online_track(points, delay), "append", folder)
