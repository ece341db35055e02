"""Growing text files as a stream: an offset per file, from which only new bytes are read.

The stream's offset maps each file to the place after its last whole line. A batch opens a file at its old place, so what was read before is not read again; a file that has become shorter is read from its
start. Long news are cut into ranges of bytes, one task each, at whole lines; no file is ever one row. Files are opened by URI through Arrow's file systems. Offsets live in the
query's checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.running import ordinals
from ..sources.tables import small

SCHEMA = "path string, at long, line string"
#: Bytes that one task reads, and that are looked at in one go for the last line's end.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 16


class Range(InputPartition):
    """The lines of a file that begin from start on and before stop; low is where the news begin."""

    def __init__(self, path: str, low: int, start: int, stop: int) -> None:
        super().__init__((path, low, start, stop))
        self.path, self.low, self.start, self.stop = path, low, start, stop


def last_line_end(file, size: int, low: int) -> int:
    """The place after the last line end before size, or low if there is none after it."""
    stop = size
    while stop > low:
        start = max(low, stop - BLOCK_BYTES)
        file.seek(start)
        if (at := bytes(file.read(stop - start)).rfind(b"\n")) >= 0:
            return start + at + 1
        stop = start
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        # where to begin without a checkpoint: keys are paths as the file system gives them
        self.first: dict[str, int] = json.loads(options.get("offsets", "{}"))
        self.known = dict(self.first)

    def store(self) -> tuple[pa.fs.FileSystem, str]:
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(self.options["path"])

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        import pyarrow.fs as fs

        store, root = self.store()
        name = re.compile(self.options.get("pattern", r".*\.log"))
        found = {}
        for x in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if x.type == fs.FileType.File and name.fullmatch(x.base_name) and not x.base_name.startswith((".", "_")):
                low = self.known.get(x.path, 0)
                with store.open_input_file(x.path) as file:
                    found[x.path] = last_line_end(file, x.size, low if low <= x.size else 0)
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        step, out = int(self.options.get("rangebytes", RANGE_BYTES)), []
        for path, stop in sorted(end.items()):
            # shorter than before: another file by the same name
            low = start.get(path, 0) if start.get(path, 0) <= stop else 0
            out += [Range(path, low, a, min(a + step, stop)) for a in range(low, stop, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        if not part.path:
            return
        store, _ = self.store()
        with store.open_input_file(part.path) as file:
            # a line that begins before this range belongs to the one before it
            at = max(part.low, part.start - 1)
            file.seek(at)
            held, size = b"", file.size()
            skip = part.start > part.low
            while at < part.stop or (held and not skip):
                more = bytes(file.read(min(BLOCK_BYTES, size - at - len(held)))) if at + len(held) < size else b""
                if not more:
                    break
                *lines, held = (held + more).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < part.stop:
                        yield part.path, at, line.decode("utf-8", "replace")
                    at += len(line) + 1
                    if at >= part.stop and not skip:
                        return


class Tail(DataSource):
    """spark.readStream.format("tail") with path (a folder's URI) and, if wished, pattern, rangeBytes and offsets (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, folder: str, pattern: str = r".*\.log", range_bytes: int = RANGE_BYTES, offsets: dict[str, int] | None = None) -> DataFrame:
    """path, at (the byte at which it begins) and line of the whole lines that files below a folder gain. offsets say by file (URI or path) where a query
    that has no checkpoint yet begins: after a whole line; files that are not named are read from their start."""
    spark.dataSource.register(Tail)
    first = {plain(path): n for path, n in (offsets or {}).items()}
    return spark.readStream.format("tail").option("path", folder).option("pattern", pattern).option("rangeBytes", range_bytes).option("offsets", json.dumps(first)).load()


def plain(path: str) -> str:
    """A file's path as its file system gives it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))[1]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (path, at, line) with n, their numbers within the file from 1. They are numbered by ranges of path and place, so a long file is no single task."""
    placed = ordinals(lines, ["path", "at"], "_n")
    first = placed.groupBy("path").agg(F.min("_n").alias("_first"))
    return placed.join(small(first), "path").withColumn("n", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")
