"""Edges of polygons: what crosses, lies upon itself, overlaps or has holes."""

import math

from pyspark.sql import functions as F
from test_polygons import HOLE, SQUARE, fine_area, frame

from meshwright.operators import outlines as O
from meshwright.operators import polygons as P

BOW = [(100.0, 30.0), (101.0, 31.0), (101.0, 30.0), (100.0, 31.0)]
SPIKE = [(100.0, 30.0), (101.0, 30.0), (101.0, 31.0), (102.5, 32.0), (101.0, 31.0), (100.0, 31.0)]
LEAVING = [(100.0, 30.0), (101.0, 30.0), (101.0, 31.0), (100.0, 31.0), (100.0, 30.5), (99.0, 30.5), (100.0, 30.5)]
C = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 4.0), (0.0, 4.0)]


def shapes(spark, *polygons):
    return frame(spark, [(i, "home", [("Polygon", [p])]) for i, p in enumerate(polygons)])


def areas(outlines):
    return {r.city_id: r.area_m2 for r in O.area(outlines, "city_id").collect()}


def test_crossing_and_folded_rings_are_repaired(spark):
    other = [(x + 0.5, y) for x, y in SQUARE]
    data = shapes(spark, [SQUARE], [BOW], [SPIKE], [LEAVING], [SQUARE, other], [SQUARE, HOLE], [[(float("nan"), 1.0), *SQUARE]])
    outlines, told = P.assess(data)
    status = {r.city_id: r for r in told.collect()}
    assert {k: r.status for k, r in status.items()} == {0: "valid", 1: "repaired", 2: "repaired", 3: "repaired", 4: "repaired", 5: "valid", 6: "skipped"}
    square, half = fine_area(SQUARE[:-1]), [fine_area([(100.0, 30.0), (100.5, 30.5), (100.0, 31.0)]), fine_area([(101.0, 30.0), (101.0, 31.0), (100.5, 30.5)])]
    # a hole that leaves its outline: what an odd number of rings surrounds
    odd = fine_area([(100.0, 30.0), (100.5, 30.0), (100.5, 31.0), (100.0, 31.0)]) * 2
    want = {0: square, 1: sum(half), 2: square, 3: square, 4: odd, 5: square - fine_area(HOLE)}
    assert all(math.isclose(status[k].city_area_m2, a, rel_tol=1e-7) for k, a in want.items()) and status[6].city_area_m2 is None
    held = O.cells(outlines, 20.0, 90.0, 80, 160, "city_id").groupBy("city_id").agg(F.sum("area_m2").alias("s"))
    assert all(math.isclose(r.s, want[r.city_id], rel_tol=1e-7) for r in held.collect())


def test_shared_ground_counts_once(spark):
    inside, apart, beside = [(100.2, 30.2), (100.8, 30.2), (100.8, 30.8), (100.2, 30.8)], [(110.0, 30.0), (111.0, 30.0), (110.0, 31.0)], [(100.5, 30.5), (101.5, 30.5), (101.5, 31.5), (100.5, 31.5)]
    united = P.united(O.edges(P.repaired(shapes(spark, [SQUARE], [SQUARE], [inside], [apart], [beside])), "city_id").withColumn("all", F.lit(1)), "all")
    want = fine_area(SQUARE[:-1]) + fine_area(apart) + fine_area(beside) - fine_area([(100.5, 30.5), (101.0, 30.5), (101.0, 31.0), (100.5, 31.0)])
    assert math.isclose(O.area(united, "all").first().area_m2, want, rel_tol=1e-7)
    # what is united can be cut to cells
    assert math.isclose(O.cells(united, 20.0, 90.0, 80, 160, "all").agg(F.sum("area_m2")).first()[0], want, rel_tol=1e-7)


def test_inner_points_lie_inside(spark):
    outlines = O.edges(P.repaired(shapes(spark, [C], [SQUARE, HOLE], [BOW])), "city_id")
    tangled = O.crossings(outlines, "city_id")
    assert {r.city_id for r in tangled.collect()} == {2}
    got = {r.city_id: (r.lon, r.lat) for r in O.inner_points(outlines, "city_id").collect()}
    assert got[0] == (0.5, 2.0)
    lon, lat = got[1]
    assert 100 < lon < 100.4 or 100.6 < lon < 101 or not 30.4 < lat < 30.6
    clean = O.slabs(outlines.where("city_id = 2"), tangled, "city_id")
    lon, lat = O.inner_points(clean, "city_id").first()[1:]
    assert abs(lat - 30.5) < abs(lon - 100.5) < 0.5


def test_projected_area_equals_the_authalic_one(spark):
    outlines = O.edges(P.repaired(shapes(spark, [SQUARE, HOLE], [[(100.0, 60.0), (102.0, 60.5), (101.0, 61.0)]])), "city_id")
    plain = areas(outlines)
    for r in O.projected_area(outlines, O.inner_points(outlines, "city_id"), "city_id").collect():
        assert math.isclose(r.area_m2, plain[r.city_id], rel_tol=1e-6)


def test_an_outline_beyond_the_grid_covers_what_lies_in_it(spark):
    wide = [(80.0, 15.0), (140.0, 15.0), (140.0, 45.0), (80.0, 45.0)]
    outlines = O.edges(P.repaired(shapes(spark, [wide])), "city_id")
    cells = O.cells(outlines, 20.0, 90.0, 80, 160, "city_id")
    assert cells.count() == 80 * 160
    assert math.isclose(cells.agg(F.sum("area_m2")).first()[0], fine_area([(89.875, 19.875), (129.875, 19.875), (129.875, 39.875), (89.875, 39.875)]), rel_tol=1e-6)
