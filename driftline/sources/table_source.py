"""Delimited tables as Spark data sources: `observation_table` and `ephemeris_table`.

    spark.dataSource.register(ObservationTable)
    spark.read.format("observation_table").load(folder)
    rows.write.format("observation_table").option("sep", ";").mode("append").save(folder)

Reading. Every file finds its own separator (`,`, `;` or tab, the one that gives the most known columns in its first line) and maps its own header
spellings to fields. Files are cut into byte ranges (`split_bytes`), one partition each; a line belongs to the range that its first byte
is in. Cells are trimmed text, blank ones NULL; of several columns with one field the last non-blank cell counts. Short and long rows are kept: what
is missing is NULL, what is too much is dropped. `file`, `block` and `row` give the place: ordered by them, rows are in file order.
A schema given to the reader selects columns, and only those are built; `pathGlobFilter` selects files before any is opened.

Writing. Tasks write files that nobody sees yet; the driver then lists them in a new manifest, which replaces the old one in one rename. A reader takes
the files the manifest names, so a failed or repeated task, or a driver lost before the rename, changes nothing. Appending keeps the
listed files, overwriting drops them after the switch. A folder without a manifest is read whole. One writer at a time.

Paths are those that pyarrow opens (local, hdfs, s3, gs). A row is a line: quoted line breaks aren't supported. A `.json` ephemeris is one document (a list
of rows, or an object with `rows`) and one partition.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyarrow import fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
HEADER_BYTES = 1 << 20
MANIFEST = "_manifest.json"
PLACE = "file string, block bigint, row int"

# The fifteen observation columns in order.
OBSERVATION_COLUMNS = [
    "Object", "Date", "Time", "Observer", "Instrument", "Seeing", "L_I", "L_II", "L_III", "Lat", "Length", "Width",
    "Method", "Ref", "Comment",
]

# Header spellings per ephemeris field.
EPHEMERIS_ALIASES = {
    "time": ["time", "date", "datetime", "epoch"],
    "jd": ["jd"],
    "mjd": ["mjd"],
    "cm_iii": ["cm_iii", "cml_iii", "cml3", "cmiii", "cml", "cm", "longitude_cm"],
    "sub_lat": ["sub_lat", "sublat", "de"],
    "np_pa": ["np_pa", "pa", "p", "north_pa"],
    "distance_au": ["distance_au", "delta"],
}


def opened(uri: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(uri)


def listed(uri: str, patterns: list[str]) -> list[tuple[str, int]]:
    """Paths and sizes: those of the manifest, or all files of a folder, or the files a glob in the last part names, or the one file."""
    fs, path = opened(uri)
    folder, _, last = path.rstrip("/").rpartition("/")
    if any(x in last for x in "*?["):
        found = fs.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, last))
    info = fs.get_file_info(path)
    if info.is_file:
        return [(path, info.size)]
    if info.type == pa_fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    names = manifest_files(fs, path)
    if names is not None:
        return sorted((f.path, f.size) for f in fs.get_file_info([f"{path}/{n}" for n in names]))
    found = fs.get_file_info(pa_fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and any(fnmatch.fnmatch(f.base_name.lower(), p) for p in patterns))


def manifest_files(fs: pa_fs.FileSystem, folder: str) -> list[str] | None:
    if not fs.get_file_info(f"{folder}/{MANIFEST}").is_file:
        return None
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def normal(name: str) -> str:
    return name.strip().strip('"').lower().replace(" ", "_")


def header_of(line: str, aliases: dict[str, list[str]]) -> tuple[str, list[str | None]]:
    """The separator and the field of each column."""
    field = {a: f for f, names in aliases.items() for a in names}
    best: tuple[int, int, str, list[str | None]] | None = None
    for sep in (",", ";", "\t"):
        names = next(csv.reader([line], delimiter=sep), [])
        fields = [field.get(normal(n)) for n in names]
        rank = (sum(f is not None for f in fields), len(names))
        if best is None or rank > best[:2]:
            best = (*rank, sep, fields)
    return best[2], best[3]


def lines_between(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, whole lines) of about CHUNK_BYTES, of all lines whose first byte is in [start, end)."""
    f.seek(start)
    if start:
        f.seek(start - 1)
        head = f.read(1)
        while head and not head.endswith(b"\n"):  # the line that began before this range belongs to the one before
            head = f.read(CHUNK_BYTES)
            if b"\n" in head:
                f.seek(f.tell() - len(head) + head.index(b"\n") + 1)
                break
    at, rest = f.tell(), b""
    while at < end:
        data = f.read(CHUNK_BYTES)
        buffer = rest + data
        last = len(buffer) if not data else buffer.rfind(b"\n") + 1
        if at + last > end:  # stop behind the line in which the range ends
            cut = buffer.find(b"\n", end - at - 1) + 1
            last = cut or (len(buffer) if not data else 0)
        if last:
            yield at, buffer[:last]
        rest, at = buffer[last:], at + last
        if not data:
            return


def parsed(chunk: bytes, sep: str, width: int) -> list[pa.Array]:
    """The chunk's cells by column, `width` columns."""
    try:
        chunk.decode()
    except UnicodeDecodeError:
        chunk = chunk.decode("utf-8", "replace").encode()
    names, odd = [str(i) for i in range(width)], []
    try:
        table = pa_csv.read_csv(
            pa.BufferReader(chunk), pa_csv.ReadOptions(column_names=names, use_threads=False, block_size=len(chunk) + 1),
            pa_csv.ParseOptions(delimiter=sep, invalid_row_handler=lambda row: odd.append(row) or "skip"),
            pa_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        odd.append(chunk)
    if not odd:
        return [c.combine_chunks() for c in table.columns]
    rows = [r for r in csv.reader(io.StringIO(chunk.decode(), newline=""), delimiter=sep) if r]
    return [pa.array([r[i] if i < len(r) else "" for r in rows], pa.string()) for i in range(width)]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, aliases: dict[str, list[str]], patterns: list[str]):
        self.uri, self.aliases, self.patterns = options["path"], aliases, patterns
        self.glob = options.get("pathGlobFilter", "*")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.uri, self.patterns):
            if not fnmatch.fnmatch(path.rpartition("/")[2], self.glob):
                continue
            step = max(size, 1) if path.lower().endswith(".json") else self.split
            out += [Range(path, a, min(a + step, size)) for a in range(0, size, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        fs, _ = opened(self.uri)
        with fs.open_input_file(part.path) as f:
            if part.path.lower().endswith(".json"):
                doc = json.loads(f.read().decode("utf-8-sig", "replace"))
                rows = [{normal(k): v for k, v in r.items()} for r in (doc.get("rows", []) if isinstance(doc, dict) else doc)]
                cells = {}
                for field, names in self.aliases.items():
                    texts = [[r.get(n) for n in names] for r in rows]
                    cells[field] = pa.array([next((str(x) for x in t if x is not None and str(x) != ""), None) for t in texts], pa.string())
                yield self.batch(part.path, 0, len(rows), cells)
                return
            first = f.read(HEADER_BYTES)
            size = first.find(b"\n") + 1 or len(first)
            line = first[:size].decode("utf-8-sig", "replace").rstrip("\r\n")
            sep, fields = header_of(line, self.aliases)
            for at, chunk in lines_between(f, max(part.start, size), max(part.end, size)):
                columns, cells = parsed(chunk, sep, len(fields)), {}
                for field, column in zip(fields, columns):
                    if field is None or all(name != field for name, _ in self.columns):
                        continue
                    text = pc.utf8_trim_whitespace(column)
                    text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
                    cells[field] = pc.coalesce(text, cells[field]) if field in cells else text
                if columns and len(columns[0]):
                    yield self.batch(part.path, at, len(columns[0]), cells)

    def batch(self, path: str, at: int, n: int, cells: dict[str, pa.Array]) -> pa.RecordBatch:
        place = {"file": lambda: pa.array([path] * n, pa.string()), "block": lambda: pa.array([at] * n, pa.int64()), "row": lambda: pa.array(range(n), pa.int32())}
        made = [place[c]() if c in place else cells.get(c, pa.nulls(n, pa.string())) for c, _ in self.columns]
        return pa.RecordBatch.from_arrays(made, names=[c for c, _ in self.columns])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class TableWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.uri, self.sep, self.columns, self.overwrite = options["path"], options.get("sep", ","), columns, overwrite
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.uri)
        fs.create_dir(folder)
        name, rows, out = f"part-{self.write_id}-{uuid.uuid4().hex[:12]}.csv", 0, None
        try:
            for b in iterator:
                if not len(b):
                    continue
                table = pa.Table.from_batches([b])
                missing = pa.array([""] * len(b), pa.string())
                cells = [pc.fill_null(table[c].combine_chunks().cast(pa.string()), "") if c in table.column_names else missing for c in self.columns]
                if out is None:
                    out = fs.open_output_stream(f"{folder}/{name}")
                options = pa_csv.WriteOptions(include_header=rows == 0, delimiter=self.sep, quoting_style="needed")
                pa_csv.write_csv(pa.Table.from_arrays(cells, names=self.columns), out, options)
                rows += len(b)
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """The switch: until the rename, readers see the old list, from then on the new one."""
        fs, folder = opened(self.uri)
        fs.create_dir(folder)
        old = manifest_files(fs, folder) or []
        new = sorted(m.name for m in messages if m is not None and m.name)
        draft = f"{folder}/_draft-{self.write_id}.json"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": new if self.overwrite else old + new}).encode())
        fs.move(draft, f"{folder}/{MANIFEST}")
        for name in old if self.overwrite else []:
            fs.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.uri)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{folder}/{m.name}").is_file:
                fs.delete_file(f"{folder}/{m.name}")


class ObservationTable(DataSource):
    fields = {c: [c.lower()] for c in OBSERVATION_COLUMNS}
    patterns = ["*.csv", "*.txt", "*.tsv"]

    @classmethod
    def name(cls) -> str:
        return "observation_table"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in self.fields) + ", " + PLACE

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(self.options, schema, self.fields, self.patterns)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TableWriter(self.options, list(self.fields), overwrite)


class EphemerisTable(ObservationTable):
    fields = EPHEMERIS_ALIASES
    patterns = ["*.csv", "*.txt", "*.tsv", "*.json"]

    @classmethod
    def name(cls) -> str:
        return "ephemeris_table"


def register(spark) -> None:
    """Once a session."""
    if spark.conf.get("driftline.sources", "") != "registered":
        for source in (ObservationTable, EphemerisTable):
            spark.dataSource.register(source)
        spark.conf.set("driftline.sources", "registered")
