"""An ordered append log of JSON lines: numbered segments, and a numbered manifest that names them.

    log = AppendLog(spark, folder)
    log.append(rows, token="night-12")        # exactly once for a token, however often it is retried
    log.latest("idx", schema)                 # the last record of every case

An append first lets Spark write the rows as files of a new segment that nobody sees, then writes the next manifest under a draft name and renames it to its
number. The rename is the commit, and it fails if the number is taken, so of two writers one has to look again. A run that dies
before it leaves the old state; a retry with the same token goes on, and once a token is listed its append does nothing.

Records are ordered by segment, file of the segment and place in the file. A place is Spark's own file split and the row's number within it, so files are
split and read in parallel and the order still holds; nothing depends on how rows are dealt to tasks. Lines that aren't JSON objects of
the schema are skipped, and `bad_lines` returns them.

Folders are reached through Spark's own file systems. Superseded manifests stay (they are small) up to `KEPT`; segments of failed appends are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 20
PLACE = ["_segment", "_part", "_file", "_block", "_row"]


class Conflict(RuntimeError):
    """Another writer took the manifest number."""


class AppendLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # -- manifest ---------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.folder}/_manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def state(self) -> dict:
        """The manifest in force: version, segments (n, folder) in order, tokens."""
        version = max(self.versions(), default=0)
        return self._read(version) if version else {"version": 0, "segments": [], "tokens": []}

    def segments(self) -> list[dict]:
        return self.state()["segments"]

    def _read(self, version: int) -> dict:
        f = self._fs.open(self._path(f"{self.folder}/_manifest/{version:010}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _switch(self, version: int, segments: list[dict], tokens: list[str]) -> None:
        """The commit: one rename that does not replace."""
        draft = self._path(f"{self.folder}/_manifest/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps({"version": version, "segments": segments, "tokens": tokens}).encode())
        out.close()
        try:
            self._files.rename(draft, self._path(f"{self.folder}/_manifest/{version:010}.json"), self._once)
        except Exception as e:  # the gateway wraps what Java throws
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.folder}: version {version} is taken") from e
            raise
        for old in self.versions()[:-KEPT]:
            self._fs.delete(self._path(f"{self.folder}/_manifest/{old:010}.json"), False)

    # -- writing ----------------------------------------------------------------------------------

    def append(self, rows: DataFrame, token: str | None = None) -> bool:
        """Append rows as one segment, in their partition order. False: the token was appended before."""
        return self._add(token, lambda folder: rows.write.json(folder))

    def append_lines(self, lines: DataFrame, token: str | None = None) -> bool:
        """Append text lines (one string column) as they are."""
        return self._add(token, lambda folder: lines.write.text(folder))

    def _add(self, token: str | None, write) -> bool:
        if token is not None and token in self.state()["tokens"]:
            return False
        folder = f"segment-{uuid.uuid4().hex}"
        write(f"{self.folder}/{folder}")
        while True:
            now = self.state()
            if token is not None and token in now["tokens"]:
                return False  # a twin of this run was faster
            n = max((s["n"] for s in now["segments"]), default=0) + 1
            try:
                self._switch(now["version"] + 1, [*now["segments"], {"n": n, "folder": folder}], now["tokens"] + ([] if token is None else [token]))
                return True
            except Conflict:
                continue

    def vacuum(self) -> int:
        """Remove segment folders that no manifest names; not while another writer is at work."""
        named = {s["folder"] for v in self.versions() for s in self._read(v)["segments"]}
        stray = [n for n in self._names(self.folder) if n.startswith("segment-") and n not in named]
        for n in stray:
            self._fs.delete(self._path(f"{self.folder}/{n}"), True)
        return len(stray)

    # -- reading ----------------------------------------------------------------------------------

    def lines(self) -> DataFrame:
        """Every line with its place."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], "value string, _part bigint, _file string, _block bigint, _row bigint, _segment int")
        text = placed(self.spark.read.text([f"{self.folder}/{s['folder']}" for s in segments]))
        # one entry a segment: merge the log into one segment before there are very many
        number = F.create_map(*[F.lit(x) for s in segments for x in (s["folder"], s["n"])])
        return text.withColumn("_segment", number[F.regexp_extract("_file", r"(segment-[0-9a-f]+)/[^/]*$", 1)])

    def records(self, schema: str) -> DataFrame:
        """Readable records with their place."""
        return readable(self.lines(), schema)

    def bad_lines(self, schema: str) -> DataFrame:
        return unreadable(self.lines(), schema)

    def latest(self, key: str, schema: str) -> DataFrame:
        # Spark wrote every file: its part and its count in the task place it, and rows need not carry a path through the sort
        lines = self.lines().withColumn("_file", F.coalesce(F.try_to_number(F.regexp_extract("_file", r"-c(\d+)[^/]*$", 1), F.lit("999999999")), F.lit(0)).cast("int"))
        return last_records(readable(lines, schema), key)

    def compact(self, key: str, schema: str) -> None:
        """Replace all segments by one with the last record of every case; readers see the old or the new state."""
        now = self.state()
        if not now["segments"]:
            return
        folder = f"segment-{uuid.uuid4().hex}"
        self.latest(key, schema).write.json(f"{self.folder}/{folder}")
        self._switch(now["version"] + 1, [{"n": max(s["n"] for s in now["segments"]), "folder": folder}], now["tokens"])


def placed(rows: DataFrame) -> DataFrame:
    """A file scan with `_part` (the number in Spark's file names, else 0), `_file`, `_block` and `_row`. Within one split, ids of the scan rise in file order."""
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1)
    return rows.select(
        "*", F.when(number != "", number.cast("bigint")).otherwise(0).alias("_part"), path.alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _json(schema: str) -> Column:
    return F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def readable(lines: DataFrame, schema: str) -> DataFrame:
    at = [x for x in lines.columns if x != "value"]
    return lines.withColumn("_r", _json(schema)).where("_r is not null and _r._bad is null and trim(value) <> ''").select("_r.*", *at).drop("_bad")


def unreadable(lines: DataFrame, schema: str) -> DataFrame:
    return lines.withColumn("_r", _json(schema)).where("trim(value) <> '' and (_r is null or _r._bad is not null)").drop("_r")


def last_records(rows: DataFrame, key: str) -> DataFrame:
    """The last record of each key by place; a max_by, so a key repeated very often is reduced before the shuffle. A record without key is no case."""
    place = [x for x in PLACE if x in rows.columns]
    rest = [x for x in rows.columns if x not in (key, *place)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("_r")).select(key, "_r.*")


def resume(matrix: DataFrame, log: AppendLog, schema: str, key: str, spec: list[str], close: list[str] = ()) -> DataFrame:
    """Cases of the matrix that the log has no good record for, or one made with another specification."""
    from driftline.operators.campaign import stale_cases

    return stale_cases(matrix, log.latest(key, schema), key, spec, close)
