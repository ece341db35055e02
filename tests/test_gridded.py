"""The classic layout: what is written is read, other writers' files too, and chunks outside a filter stay closed."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.sources import gridded as G

LAT, LON = [10.0, 10.25], [100.0, 100.25, 100.5]
SCHEMA = "path string, ts timestamp_ntz, values array<double>"


def frames(spark, days=3):
    rows = [(f"d{d}.nc", dt.datetime(2020, 1, 1 + d, h), [d + h / 24, float("nan"), None, 1.0, 2.0, 3.0]) for d in range(days) for h in range(24)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_round_trip_and_pruned_chunks(spark, tmp_path):
    G.write_gridded(frames(spark), f"file://{tmp_path}/out", "x", LAT, LON)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0.nc", "d1.nc", "d2.nc"]
    back = G.read_gridded(spark, f"file://{tmp_path}/out", "x", times_per_chunk=6)
    assert back.rdd.getNumPartitions() == 12
    got = {(r.path.rsplit("/")[-1], r.n, r.ts): r["values"] for r in back.collect()}
    assert len(got) == 72 and got["d1.nc", 3, dt.datetime(2020, 1, 2, 3)][0] == 1 + 3 / 24
    assert all(math.isnan(v[1]) and math.isnan(v[2]) and v[3:] == [1.0, 2.0, 3.0] for v in got.values())
    # bounds that end within a chunk
    some = back.where((F.col("ts") >= dt.datetime(2020, 1, 1, 20)) & (F.col("ts") < dt.datetime(2020, 1, 2, 3)))
    assert some.count() == 7 and some.rdd.getNumPartitions() == 2
    assert back.where(F.col("ts") == dt.datetime(2019, 1, 1)).count() == 0
    cells = G.cells_of(back.where("n = 0"))
    assert cells.count() == 12 and sorted(r.cell_id for r in cells.where("x = 3.0").collect()) == [5, 5, 5]


def test_a_packed_file_of_another_writer(spark, tmp_path):
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, s: name(k) + struct.pack(">II", 2, len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda k, kind, code, v: name(k) + struct.pack(">II", code, 1) + (struct.pack(kind, v) + b"\0\0")[: 8 if code == 6 else 4]
    units = struct.pack(">II", 12, 1) + text("units", "days since 1999-12-31 12:00:00")
    packed = struct.pack(">II", 12, 3) + number("scale_factor", ">d", 6, 0.5) + number("add_offset", ">d", 6, 100.0) + number("_FillValue", ">h", 3, -1)
    note = struct.pack(">II", 12, 1) + text("title", "odd")

    def build(a, b):
        dims = struct.pack(">II", 10, 2) + name("t") + struct.pack(">I", 0) + name("cell") + struct.pack(">I", 3)
        first = name("t") + struct.pack(">II", 1, 0) + units + struct.pack(">III", 4, 4, a)
        second = name("v") + struct.pack(">III", 2, 0, 1) + packed + struct.pack(">III", 3, 8, b)
        return b"CDF\x01" + struct.pack(">I", 2) + dims + note + struct.pack(">II", 11, 2) + first + second

    n = len(build(0, 0))
    # three shorts are filled up to eight bytes
    body = b"".join(struct.pack(">i", t) + struct.pack(">4h", *v, 0) for t, v in ((1, (0, -1, 4)), (3, (2, 2, -2))))
    (tmp_path / "a.nc").write_bytes(build(n, n + 4) + body)
    spark.dataSource.register(G.Gridded)
    rows = spark.read.format("gridded").option("variable", "v").option("time", "t").load(f"file://{tmp_path}/a.nc").collect()
    assert [(r.n, r.ts) for r in rows] == [(0, dt.datetime(2000, 1, 1, 12)), (1, dt.datetime(2000, 1, 3, 12))]
    assert rows[1]["values"] == [101.0, 101.0, 99.0] and rows[0]["values"][0] == 100.0 and math.isnan(rows[0]["values"][1])


def test_what_is_no_such_file_is_told(spark, tmp_path):
    spark.dataSource.register(G.Gridded)
    (tmp_path / "b.nc").write_bytes(b"no such file")
    with pytest.raises(Exception, match="no classic NetCDF file"):
        G.read_gridded(spark, f"file://{tmp_path}", "x").collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no .nc files"):
        G.read_gridded(spark, f"file://{tmp_path}/empty", "x").collect()
    bad = spark.createDataFrame([("a.nc", dt.datetime(2020, 1, 1), [1.0])], SCHEMA)
    with pytest.raises(Exception, match="a grid of another size"):
        G.write_gridded(bad, f"file://{tmp_path}/bad", "x", LAT, LON)
    assert not [p for p in (tmp_path / "bad").iterdir() if not p.name.startswith(".")]


def test_frames_of_cells(spark):
    cells = spark.createDataFrame([(0, dt.datetime(2020, 1, 1), 1.5), (3, dt.datetime(2020, 1, 1), 2.5), (1, dt.datetime(2020, 1, 2), None)], "cell_id long, ts timestamp_ntz, x double")
    found = {r.ts.day: np.array(r["values"], float) for r in G.frames_of(cells, 4).collect()}
    assert found[1][[0, 3]].tolist() == [1.5, 2.5] and np.isnan(found[1][[1, 2]]).all() and np.isnan(found[2]).all()
