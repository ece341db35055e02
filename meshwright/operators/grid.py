"""Tiles, cells and areas on a regular grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLUMNS, SIZE, FINE = 18, 36, 10, 0.1
HALF = 0.125
STEP = 0.25
#: WGS84: semi-major axis in metres and squared eccentricity.
AXIS, ECCENTRICITY2 = 6378137.0, 0.0066943799901413165


def tiles(spark: SparkSession) -> DataFrame:
    """The 648 tiles of ten degrees, row by row from the north west; each request leaves out its south and east edge, but the south pole's."""
    cells = spark.range(ROWS * COLUMNS).select((F.col("id") / COLUMNS).cast("int").alias("row"), (F.col("id") % COLUMNS).cast("int").alias("col"), F.col("id"))
    north, west = 90 - F.col("row") * SIZE, F.col("col") * SIZE - 180
    south, east = north - SIZE, west + SIZE
    return cells.select(
        F.format_string("G%04d", F.col("id") + 1).alias("grid_id"),
        "row",
        "col",
        north.alias("north"),
        south.alias("south"),
        west.alias("west"),
        east.alias("east"),
        north.cast("double").alias("request_north"),
        F.when(F.col("row") == ROWS - 1, south.cast("double")).otherwise(F.round(south + FINE, 1)).alias("request_south"),
        west.cast("double").alias("request_west"),
        F.round(east - FINE, 1).alias("request_east"),
    )


def tile_of(lat: Column, lon: Column) -> Column:
    """grid_id of the tile that holds a point."""
    row = F.least(F.lit(ROWS - 1), F.greatest(F.lit(0), F.floor((F.lit(90.0) - lat) / SIZE)))
    col = F.floor(F.pmod(lon + 180, F.lit(360.0)) / SIZE)
    return F.format_string("G%04d", (row * COLUMNS + col + 1).cast("long"))


def flat_id(iy: Column, ix: Column, n_lon: int) -> Column:
    return iy * n_lon + ix


def cells_by_predicate(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells (lat, lon) whose quarter degree strictly overlaps a box (xmin, ymin, xmax, ymax), as a join on the predicate: the plain statement that
    cells_by_arithmetic() is tested against, for grids of up to a million cells."""
    if cells.count() > 1_000_000:
        raise ValueError("too many cells for a join on a predicate; use cells_by_arithmetic()")
    hit = (F.col("lat") + HALF > F.col("ymin")) & (F.col("lat") - HALF < F.col("ymax")) & (F.col("lon") + HALF > F.col("xmin")) & (F.col("lon") - HALF < F.col("xmax"))
    return boxes.join(F.broadcast(cells), hit)


def cells_by_arithmetic(boxes: DataFrame, south: float, west: float, n_lat: int, n_lon: int) -> DataFrame:
    """The same without a join: the range of rows and columns follows from the box, and the strict predicate trims it."""

    def span(low: str, high: str, origin: float, n: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(low) - origin) / STEP) - 1).cast("int")
        last = F.least(F.lit(n - 1), F.ceil((F.col(high) - origin) / STEP) + 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    rows = boxes.withColumn("iy", F.explode(span("ymin", "ymax", south, n_lat)))
    both = rows.withColumn("ix", F.explode(span("xmin", "xmax", west, n_lon)))
    placed = both.withColumns({"lat": south + F.col("iy") * STEP, "lon": west + F.col("ix") * STEP})
    hit = (F.col("lat") + HALF > F.col("ymin")) & (F.col("lat") - HALF < F.col("ymax")) & (F.col("lon") + HALF > F.col("xmin")) & (F.col("lon") - HALF < F.col("xmax"))
    return placed.where(hit)


def authalic(lat: Column) -> Column:
    """Snyder's q: the area north of the equator per radian of longitude, in units of half the squared axis."""
    s, e = F.sin(F.radians(lat)), math.sqrt(ECCENTRICITY2)
    return (1 - ECCENTRICITY2) * (s / (1 - ECCENTRICITY2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))


def rectangle_area(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Square metres of a rectangle of latitudes and longitudes on the ellipsoid; 0 where it is empty."""
    area = AXIS**2 / 2 * F.radians(east - west) * (authalic(north) - authalic(south))
    return F.when((north > south) & (east > west), area).otherwise(0.0)


def cell_overlaps(cells: DataFrame) -> DataFrame:
    """Area in square metres of each cell's overlap with its box, the empty ones dropped."""
    area = rectangle_area(F.greatest(F.col("ymin"), F.col("lat") - HALF), F.least(F.col("ymax"), F.col("lat") + HALF), F.greatest(F.col("xmin"), F.col("lon") - HALF), F.least(F.col("xmax"), F.col("lon") + HALF))
    return cells.withColumn("area_m2", area).where("area_m2 > 0")


def clip_ring(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """A ring (array of struct x, y; not closed) cut to one side of a line, by Sutherland and Hodgman."""
    inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)

    def cross(p: Column, q: Column) -> Column:
        t = (bound - p[axis]) / (q[axis] - p[axis])
        return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

    def step(p: Column, i: Column) -> Column:
        before = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
        return F.when(inside(p) & ~inside(before), F.array(cross(before, p), p)).when(inside(p), F.array(p)).when(inside(before), F.array(cross(before, p))).otherwise(F.filter(F.array(p), lambda _: F.lit(False)))

    return F.flatten(F.transform(ring, step))


def ring_area(ring: Column) -> Column:
    """Square metres of a ring by the shoelace rule on longitude and authalic height, an equal-area map."""
    parts = F.transform(ring, lambda p, i: F.radians(p["x"]) * authalic(F.element_at(ring, F.when(i + 1 == F.size(ring), 1).otherwise(i + 2))["y"]) - F.radians(F.element_at(ring, F.when(i + 1 == F.size(ring), 1).otherwise(i + 2))["x"]) * authalic(p["y"]))
    return F.when(F.size(ring) >= 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)) / 2 * AXIS**2 / 2).otherwise(0.0)


def clip_to_cell(rings: DataFrame, ring: str = "ring", area=None) -> DataFrame:
    """rings with the columns lat and lon of a cell: the area of the ring within it, line by line."""
    out = rings.withColumn("_r", F.col(ring))
    for axis, bound, above in (("x", F.col("lon") - HALF, True), ("x", F.col("lon") + HALF, False), ("y", F.col("lat") - HALF, True), ("y", F.col("lat") + HALF, False)):
        out = out.withColumn("_r", clip_ring(F.col("_r"), axis, bound, above))
    return out.withColumn("area_m2", (area or ring_area)(F.col("_r"))).drop("_r")
