"""Polygons against a plain calculation."""

import math

import numpy as np
from pyspark.sql import functions as F

from meshwright.operators import grid as G
from meshwright.operators import polygons as P

SQUARE = [(100.0, 30.0), (101.0, 30.0), (101.0, 31.0), (100.0, 31.0), (100.0, 30.0)]
HOLE = [(100.4, 30.4), (100.6, 30.4), (100.6, 30.6), (100.4, 30.6)]
CONCAVE = [(103.1, 30.05), (104.4, 30.3), (103.9, 30.5), (104.2, 31.2), (103.6, 30.7)]
KIND = "city_id int, city_name string, country string, parts array<struct<kind string, polygons array<array<array<struct<x double, y double>>>>>>"


def height(lat):
    s, e2 = math.sin(math.radians(lat)), G.ECCENTRICITY2
    e = math.sqrt(e2)
    return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def fine_area(ring, steps=400):
    """Square metres by many short trapezoids."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        t = np.linspace(0, 1, steps + 1)
        h = np.array([height(y1 + k * (y2 - y1)) for k in t])
        total += math.radians(x2 - x1) * float(((h[1:] + h[:-1]) / 2).mean())
    return abs(total) * G.AXIS**2 / 2


def frame(spark, rows):
    return spark.createDataFrame([(i, f"c{i}", country, [(kind, polygons) for kind, polygons in parts]) for i, country, parts in rows], KIND)


def rows():
    bow = [(100.0, 30.0), (100.0, 30.0), (100.5, 30.0)]
    return [
        (1, "home", [("Polygon", [[SQUARE, HOLE]])]),
        (2, "home", [("Polygon", [[CONCAVE]]), ("Point", [])]),
        (3, "home", [("LineString", [[bow]])]),
        (4, "home", [("Polygon", [[bow]])]),
        (5, "abroad", [("Polygon", [[SQUARE]])]),
        (6, "home", [("MultiPolygon", [[SQUARE], [[(x + 5, y) for x, y in CONCAVE]]])]),
        (7, "home", None and []),
        (8, "home", [("Polygon", [[[(10.0, 10.0), (11.0, 10.0), (11.0, 11.0)]]])]),
    ]


def test_weights_of_irregular_polygons(spark):
    data = [r for r in rows() if r[2] is not None]
    weights, told = P.build_weights(frame(spark, data), "home", 20.0, 90.0, 80, 160)
    status = {r.city_id: r for r in told.collect()}
    assert {k: r.status for k, r in status.items()} == {1: "valid", 2: "repaired", 3: "skipped", 4: "skipped", 6: "valid", 8: "valid"}
    area = {1: fine_area(SQUARE[:-1]) - fine_area(HOLE), 2: fine_area(CONCAVE), 6: fine_area(SQUARE[:-1]) + fine_area([(x + 5, y) for x, y in CONCAVE])}
    held = {r.city_id: r.s for r in weights.groupBy("city_id").agg(F.sum("area_m2").alias("s")).collect()}
    for k, a in area.items():
        assert math.isclose(status[k].city_area_m2, a, rel_tol=1e-6) and math.isclose(held[k], a, rel_tol=1e-6)
        assert math.isclose(status[k].grid_coverage_fraction, 1.0, rel_tol=1e-6)
    # outside the grid: kept, without cells
    assert (status[8].grid_overlap_count, status[8].grid_coverage_fraction) == (0, 0.0) and status[8].city_area_m2 > 0
    # cells inside the hole have the square's weight less the hole's
    assert status[1].grid_overlap_count == 25 and status[3].city_area_m2 is None


def test_cells_equal_a_plain_clip(spark):
    def clip(ring, axis, bound, above):
        out = []
        for p, q in zip(ring[-1:] + ring[:-1], ring):
            a, b = ((p[axis] >= bound) == above or p[axis] == bound), ((q[axis] >= bound) == above or q[axis] == bound)
            if a != b:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if b:
                out.append(q)
        return out

    weights, _ = P.build_weights(frame(spark, [(2, "home", [("Polygon", [[CONCAVE]])])]), "home", 20.0, 90.0, 80, 160)
    got = {r.cell_id: r.area_m2 for r in weights.collect()}
    want = {}
    for iy in range(80):
        for ix in range(160):
            lat, lon, ring = 20 + iy / 4, 90 + ix / 4, CONCAVE
            for axis, bound, above in ((0, lon - 0.125, True), (0, lon + 0.125, False), (1, lat - 0.125, True), (1, lat + 0.125, False)):
                ring = clip(ring, axis, bound, above) if ring else ring
            if len(ring) > 2 and (a := fine_area(ring, 60)) > 1:
                want[iy * 160 + ix] = a
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-4, abs_tol=10) for k in want)
