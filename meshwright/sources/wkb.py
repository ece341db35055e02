"""Well-known binary geometries to parts and back, batch by batch.

parts are an array of (kind, polygons), as polygons.py takes them: collections, however deep they are nested, give the parts of all that they hold, in order. Both byte orders are read, and points with
a third or fourth number, whose extra numbers are dropped. Geometries that are no polygons are kept by their kind, without polygons.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The format's kinds.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {name: code for code, name in KINDS.items()}
PARTS = "array<struct<kind string, polygons array<array<array<struct<x double, y double>>>>>>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("polygons", pa.list_(pa.list_(pa.list_(POINT))))]))


class Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, order: str, kind: str = "I") -> int:
        (value,) = struct.unpack_from(order + kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return value

    def points(self, order: str, wide: int, n: int | None = None) -> list[dict]:
        n = self.number(order) if n is None else n
        if self.at + 8 * wide * n > len(self.data):
            raise ValueError("a geometry ends too early")
        found = np.frombuffer(self.data, f"{order}f8", n * wide, self.at).reshape(n, wide)
        self.at += 8 * wide * n
        return [{"x": x, "y": y} for x, y in found[:, :2].tolist()]


def geometry(cursor: Cursor) -> list[dict]:
    """The parts of the geometry at the cursor, which moves past it. Nesting goes by a stack of what is left to read, so its depth has no bound."""
    parts: list[dict] = []
    left = [1]
    inside: list[dict | None] = [None]
    while left:
        if not left[-1]:
            left.pop()
            inside.pop()
            continue
        left[-1] -= 1
        order = "<" if cursor.number("<", "B") else ">"
        code = cursor.number(order)
        # a third and fourth number are told by flags or by thousands
        wide = 2 + (code >> 31 & 1) + (code >> 30 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}.get((code & 0xFFFF) // 1000, 0)
        if code >> 29 & 1:
            cursor.number(order)
        kind = KINDS.get((code & 0xFFFF) % 1000)
        if kind is None:
            raise ValueError(f"unknown kind of geometry: {code}")
        holder = inside[-1]
        if kind == "Polygon":
            rings = [cursor.points(order, wide) for _ in range(cursor.number(order))]
            if holder is None:
                parts.append({"kind": kind, "polygons": [rings] if rings else []})
            else:
                holder["polygons"] += [rings] if rings else []
        elif kind in ("Point", "LineString"):
            cursor.points(order, wide, 1 if kind == "Point" else None)
            if holder is None:
                parts.append({"kind": kind, "polygons": []})
        else:
            made = None
            if kind != "GeometryCollection":
                made = {"kind": kind, "polygons": []}
                parts.append(made)
            left.append(cursor.number(order))
            inside.append(made)
    return parts


def written(parts: list[dict], depth: int = 0) -> bytes:
    """Parts as one collection, within so many further ones; a ring is closed."""

    def ring(points: list[dict]) -> bytes:
        xy = [(p["x"], p["y"]) for p in points]
        xy += xy[:1] if xy and xy[0] != xy[-1] else []
        return struct.pack("<I", len(xy)) + np.array(xy, "<f8").tobytes()

    polygon = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(ring, rings))
    line = lambda rings: struct.pack("<BI", 1, 2) + ring(rings[0]) if rings else struct.pack("<BII", 1, 2, 0)
    out = []
    for part in parts:
        held = part["polygons"] or []
        if part["kind"] == "Polygon":
            out.append(polygon(held[0]) if held else struct.pack("<BII", 1, 3, 0))
        elif part["kind"] == "MultiPolygon":
            out.append(struct.pack("<BII", 1, 6, len(held)) + b"".join(map(polygon, held)))
        else:
            out.append(line(held[0] if held else []))
    blob = struct.pack("<BII", 1, 7, len(out)) + b"".join(out)
    for _ in range(depth):
        blob = struct.pack("<BII", 1, 7, 1) + blob
    return blob


def with_parts(shapes: DataFrame, blob: str = "wkb", parts: str = "parts") -> DataFrame:
    """shapes with their geometries' parts; a null blob has null parts, one that is no geometry is an error that says why."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else geometry(Cursor(x)) for x in batch.column(blob).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, ARROW)], names=[*batch.schema.names, parts])

    return shapes.mapInArrow(parse, ", ".join([*[f"`{n}` {k}" for n, k in shapes.dtypes], f"`{parts}` {PARTS}"]))


def with_blobs(shapes: DataFrame, parts: str = "parts", blob: str = "wkb", depth: int = 0) -> DataFrame:
    """shapes with their parts as one blob in place of them."""
    others = [n for n in shapes.columns if n != parts]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else written(x, depth) for x in batch.column(parts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], pa.array(made, pa.binary())], names=[*others, blob])

    return shapes.select(*others, F.col(parts)).mapInArrow(write, ", ".join([*[f"`{n}` {dict(shapes.dtypes)[n]}" for n in others], f"`{blob}` binary"]))
