import struct

import pytest

from meshwright.operators import polygons as P
from meshwright.sources import wkb as W
from test_polygons import CONCAVE, HOLE, SQUARE, frame

BIG = struct.pack(">BI", 0, 3 | 1 << 31) + struct.pack(">II", 1, 4) + b"".join(struct.pack(">3d", x, y, 9.0) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0)))


def deep(blob, n):
    for _ in range(n):
        blob = struct.pack("<BII", 1, 7, 1) + blob
    return blob


def test_round_trip_nested_two_deep(spark):
    shapes = frame(spark, [(1, "home", [("Polygon", [[SQUARE, [*HOLE, HOLE[0]]]])]), (2, "home", [("MultiPolygon", [[SQUARE], [[*CONCAVE, CONCAVE[0]]]]), ("LineString", []), ("Polygon", [[SQUARE]])]), (3, "home", [])])
    back = W.with_parts(W.with_blobs(shapes, depth=2)).select("city_id", "parts")
    assert sorted(map(str, back.collect())) == sorted(map(str, shapes.select("city_id", "parts").collect()))
    area = lambda s: {r.city_id: (r.status, r.city_area_m2) for r in P.assess(s)[1].collect()}
    assert area(W.with_parts(W.with_blobs(shapes, depth=1))) == area(shapes)


def test_byte_orders_heights_and_depth():
    (part,) = W.geometry(W.Cursor(BIG))
    assert part["kind"] == "Polygon" and part["polygons"][0][0][2] == {"x": 1.0, "y": 1.0}
    both = struct.pack("<BII", 1, 7, 3) + BIG + struct.pack("<BI2d", 1, 1, 5.0, 6.0) + struct.pack("<BII", 1, 6, 1) + BIG
    assert [(p["kind"], len(p["polygons"])) for p in W.geometry(W.Cursor(deep(both, 5000)))] == [("Polygon", 1), ("Point", 0), ("MultiPolygon", 1)]


def test_nulls_and_what_is_no_geometry(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(BIG))], "city_id int, wkb binary")
    assert [r.parts is None for r in W.with_parts(rows).orderBy("city_id").collect()] == [True, False]
    for bad, why in ((BIG[:-1], "ends too early"), (struct.pack("<BI", 1, 99), "unknown kind")):
        with pytest.raises(Exception, match=why):
            W.with_parts(spark.createDataFrame([(1, bytearray(bad))], "city_id int, wkb binary")).collect()
