"""Gridded files of the classic NetCDF layout as a Spark source and sink, without a library for them.

A row is a time step: path, n (its place in the file), ts, values (the grid, row by row). Reading makes one partition per file and chunk of times; filters on ts reach the source, which leaves out chunks whose
times lie outside. Writing streams records into a hidden file per task and path; the driver moves them to their names once all tasks are done. Files are opened by URI through Arrow's file systems,
so a shared folder or an object store serves all executors.

Packed variables (scale_factor, add_offset) are unpacked; fill values are NaN. Times rise within a file and are numbers since a moment that their units tell.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "path string, n int, ts timestamp_ntz, values array<double>"
#: The layout's tags and types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
STREAMING = 0xFFFFFFFF
#: Seconds of the units of time.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
TIMES_PER_CHUNK = 24


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    begin: int
    count: int = 0

    def record_bytes(self) -> int:
        """Bytes of one record, filled up to four."""
        size = self.count * np.dtype(self.kind).itemsize
        return size + -size % 4


@dataclass
class Header:
    sizes: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    stride: int = 0


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


class Reading:
    """Big-endian numbers and names off a file, in their order."""

    def __init__(self, file) -> None:
        self.file = file

    def take(self, n: int) -> bytes:
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("the header ends too early")
        return bytes(got)

    def number(self, kind: str = ">I") -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def name(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode()

    def many(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (tag, 0) or (found == 0 and n):
            raise ValueError(f"tag {found} where {tag} was due")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.many(ATTRIBUTE):
            name, kind, n = self.name(), TYPES[self.number()], self.number()
            size = n * np.dtype(kind).itemsize
            data = self.take(size + -size % 4)[:size]
            out[name] = data.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(data, kind).tolist()
        return out


def header(file, size: int) -> Header:
    """What a file says of itself. The number of records is taken from its size where the writer left it open."""
    r, out = Reading(file), Header()
    magic = r.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("no classic NetCDF file")
    out.records = r.number()
    for _ in r.many(DIMENSION):
        out.names.append(r.name())
        out.sizes.append(r.number())
    r.attributes()
    for _ in r.many(VARIABLE):
        name, dims = r.name(), [r.number() for _ in range(r.number())]
        attributes, kind = r.attributes(), TYPES[r.number()]
        r.number()
        begin = r.number(">Q" if magic[3] == 2 else ">I")
        is_record = dims[:1] and out.sizes[dims[0]] == 0
        inner = dims[1:] if is_record else dims
        out.variables[name] = Variable(name, dims, attributes, kind, begin, int(np.prod([out.sizes[d] for d in inner], dtype=np.int64)))
    held = [v for v in out.variables.values() if v.dims and out.sizes[v.dims[0]] == 0]
    # a single record variable is not filled up between records
    out.stride = held[0].count * np.dtype(held[0].kind).itemsize if len(held) == 1 else sum(v.record_bytes() for v in held)
    if out.records == STREAMING:
        out.records = max(0, size - min((v.begin for v in held), default=size)) // max(out.stride, 1)
    return out


def moment(units: str) -> tuple[dt.datetime, int]:
    found = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*(?:Z|UTC)?\s*", units)
    if not found or found[1] + "s" not in UNITS:
        raise ValueError(f"unknown units of time: {units}")
    return dt.datetime(*[int(x or 0) for x in found.groups()[1:]]), UNITS[found[1] + "s"]


def times(file, head: Header, name: str, first: int, last: int) -> list[dt.datetime]:
    """The times of some records."""
    v = head.variables[name]
    start, unit = moment(v.attributes["units"])
    wide, out = np.dtype(v.kind).itemsize, []
    for n in range(first, last):
        file.seek(v.begin + n * head.stride)
        out.append(start + dt.timedelta(seconds=float(np.frombuffer(file.read(wide), v.kind)[0]) * unit))
    return out


def grid(file, head: Header, v: Variable, n: int) -> np.ndarray:
    """The values of one record."""
    file.seek(v.begin + n * head.stride)
    raw = np.frombuffer(file.read(v.count * np.dtype(v.kind).itemsize), v.kind)
    out = raw.astype(float)
    for c in ("_FillValue", "missing_value"):
        if c in v.attributes:
            out[raw == np.dtype(v.kind).type(v.attributes[c][0])] = np.nan
    return out * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]


@dataclass
class Chunk(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int) -> None:
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class GriddedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.low, self.high = dt.datetime.min, dt.datetime.max

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on ts choose the chunks; Spark applies every filter to the rows all the same."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), dt.datetime):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high, f.value)
            yield f

    def files(self) -> list[str]:
        import pyarrow.fs as fs

        store, path = opened(self.options["path"])
        if store.get_file_info(path).type == fs.FileType.File:
            return [path]
        found = [x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.base_name.endswith(".nc") and not x.base_name.startswith(".")]
        if not found:
            raise ValueError(f"no .nc files below {path}")
        return sorted(found)

    def partitions(self) -> list[Chunk]:
        store, _ = opened(self.options["path"])
        step, out = int(self.options.get("timesperchunk", TIMES_PER_CHUNK)), []
        for path in self.files():
            with store.open_input_file(path) as file:
                head = header(file, file.size())
                for first in range(0, head.records, step):
                    last = min(first + step, head.records)
                    a, b = (times(file, head, self.options.get("time", "time"), n, n + 1)[0] for n in (first, last - 1))
                    if a <= self.high and b >= self.low:
                        out.append(Chunk(path, first, last))
        return out or [Chunk("", 0, 0)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["path"])
        if not chunk.path:
            return
        with store.open_input_file(chunk.path) as file:
            head = header(file, file.size())
            v, at = head.variables[self.options["variable"]], times(file, head, self.options.get("time", "time"), chunk.first, chunk.last)
            if any(b <= a for a, b in zip(at, at[1:])):
                raise ValueError(f"times do not rise in {chunk.path}")
            for n, ts in zip(range(chunk.first, chunk.last), at):
                if self.low <= ts <= self.high:
                    values = pa.ListArray.from_arrays([0, v.count], grid(file, head, v, n))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.path]), pa.array([n], pa.int32()), pa.array([ts], pa.timestamp("us")), values], names=["path", "n", "ts", "values"])


def written_header(variable: str, lat: np.ndarray, lon: np.ndarray, units: str) -> bytes:
    """The start of a file of one variable over time, latitude and longitude, its axes included."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, s: name(k) + struct.pack(">II", 2, len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    fill = name("_FillValue") + struct.pack(">IId", 6, 1, float("nan"))
    none = struct.pack(">II", 0, 0)
    dims = struct.pack(">II", DIMENSION, 3) + name("time") + struct.pack(">I", 0) + name("lat") + struct.pack(">I", len(lat)) + name("lon") + struct.pack(">I", len(lon))
    listed = lambda found: struct.pack(">II", ATTRIBUTE, len(found)) + b"".join(found)
    about = [("lat", [1], none, 8 * len(lat)), ("lon", [2], none, 8 * len(lon)), ("time", [0], listed([text("units", units)]), 8), (variable, [0, 1, 2], listed([fill]), 8 * len(lat) * len(lon))]

    def build(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", STREAMING) + dims + none + struct.pack(">II", VARIABLE, len(about))
        for (n, ids, attributes, size), begin in zip(about, begins):
            out += name(n) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + attributes + struct.pack(">IIQ", 6, min(size, STREAMING - 1), begin)
        return out

    start = len(build([0] * 4))
    axes = lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes()
    begins = [start, start + 8 * len(lat), start + len(axes), start + len(axes) + 8]
    return build(begins) + axes


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class GriddedWriter(DataSourceWriter):
    """Rows are dealt and sorted by path and ts beforehand; a path lies in one partition."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.options["path"])
        store.create_dir(root, recursive=True)
        lat, lon = (np.array([float(x) for x in self.options[a].split(",")]) for a in ("lat", "lon"))
        units = self.options.get("units", "hours since 1970-01-01")
        start, unit = moment(units)
        moves, out, name, attempt, last = [], None, None, uuid.uuid4().hex, None
        try:
            for row in rows:
                if row.path != name:
                    if out:
                        out.close()
                    name, last = row.path, None
                    if any(name == done for _, done in moves):
                        raise ValueError(f"rows of {name} do not follow each other")
                    moves.append((f"{root}/.{attempt}-{name}", name))
                    out = store.open_output_stream(moves[-1][0])
                    out.write(written_header(self.options["variable"], lat, lon, units))
                values = np.array([np.nan if x is None else x for x in row["values"]], ">f8")
                if len(values) != len(lat) * len(lon) or (last is not None and row.ts <= last):
                    raise ValueError(f"{name}: a grid of another size, or times that do not rise")
                last = row.ts
                out.write(np.array([(row.ts - start).total_seconds() / unit], ">f8").tobytes() + values.tobytes())
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.options["path"])
        for source, name in (m for x in messages if x for m in x.moves):
            store.move(source, f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.options["path"])
        for source, _ in (m for x in messages if x for m in x.moves):
            store.delete_file(source)


class Gridded(DataSource):
    """spark.read.format("gridded") with path, variable and, if wished, time and timesPerChunk; the same name writes, with lat and lon as lists of numbers."""

    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GriddedReader:
        return GriddedReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> GriddedWriter:
        return GriddedWriter({k.lower(): v for k, v in self.options.items()})


def read_gridded(spark: SparkSession, path: str, variable: str, times_per_chunk: int = TIMES_PER_CHUNK) -> DataFrame:
    spark.dataSource.register(Gridded)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gridded").option("variable", variable).option("timesPerChunk", times_per_chunk).load(path)


def write_gridded(frames: DataFrame, path: str, variable: str, lat: list[float], lon: list[float]) -> None:
    """Write frames (path, ts, values) as files below a folder, one for each path."""
    frames.sparkSession.dataSource.register(Gridded)
    dealt = frames.select("path", F.lit(0).alias("n"), "ts", "values").repartition("path").sortWithinPartitions("path", "ts")
    axis = lambda a: ",".join(map(repr, map(float, a)))
    dealt.write.format("gridded").mode("append").option("variable", variable).option("lat", axis(lat)).option("lon", axis(lon)).save(path)


def frames_of(cells: DataFrame, n_cells: int) -> DataFrame:
    """ts, values: one frame of n_cells values (NaN where there is none) for each ts of cells (cell_id from 0, ts, x)."""

    def laid(key, table):
        values = np.full(n_cells, np.nan)
        values[table["cell_id"].to_numpy()] = table["x"].to_numpy(zero_copy_only=False)
        return pa.table({"ts": pa.array([key[0].as_py()], pa.timestamp("us")), "values": pa.ListArray.from_arrays([0, n_cells], values)})

    return cells.where("cell_id IS NOT NULL").groupBy("ts").applyInArrow(laid, "ts timestamp_ntz, values array<double>")


def cells_of(frames: DataFrame) -> DataFrame:
    """cell_id, ts, x of the values in frames that are there."""
    rows = frames.select("ts", F.posexplode("values").alias("cell_id", "x"))
    return rows.where(~F.isnan("x")).select(F.col("cell_id").cast("long").alias("cell_id"), "ts", "x")
