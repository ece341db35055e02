"""Polygons as directed edges, one row each: cover of grid cells, crossings, repair, union, inner points and areas.

An edge (x1, y1) to (x2, y2) has a side, so that the sum of side times the area east of its edges is the area inside: a polygon's cuts with cells, holes and several parts are then sums, and
no polygon has to stay together. Work is dealt by edge, so one outline with most of the points is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import grid as G

#: Nodes and weights of Gauss and Legendre's rule of three points on [0, 1].
NODES = ((0.1127016653792583, 5 / 18), (0.5, 8 / 18), (0.8872983346207417, 5 / 18))
#: Square metres below which a cell's share is rounding.
TINY = 1e-3
#: Degrees at which edges are made denser before they are projected.
DENSE = 0.01
ENDS = ("x1", "y1", "x2", "y2")


def clean_ring(ring: Column) -> Column:
    """The ring without points that repeat the one before, and without the closing point."""
    once = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return F.when((F.size(once) > 1) & (F.element_at(once, 1) == F.element_at(once, -1)), F.slice(once, 1, F.size(once) - 1)).otherwise(once)


def edges(shapes: DataFrame, *keys: str, polygons: str = "polygons") -> DataFrame:
    """keys, polygon, hole, place (in the ring), last (the ring's last place), x1, y1, x2, y2, side: each vertex of each ring once. Rings may be closed or not."""
    rings = shapes.select(*keys, F.posexplode(polygons).alias("polygon", "rings")).select(*keys, "polygon", F.posexplode("rings").alias("hole", "ring")).withColumn("ring", clean_ring(F.col("ring")))
    paired = rings.withColumn("pairs", F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("q"))).where(F.size("ring") > 0)
    origin = F.element_at("ring", 1)
    turn = F.aggregate("pairs", F.lit(0.0), lambda a, e: a + (e["p"]["x"] - origin["x"]) * (e["q"]["y"] - origin["y"]) - (e["q"]["x"] - origin["x"]) * (e["p"]["y"] - origin["y"]))
    signed = paired.select(*keys, "polygon", "hole", "pairs", (F.size("pairs") - 1).alias("last"), (F.signum(turn) * F.when(F.col("hole") == 0, -1.0).otherwise(1.0)).alias("side"))
    rows = signed.select(*keys, "polygon", "hole", "last", "side", F.posexplode("pairs").alias("place", "e"))
    ends = [F.col(f"e.{p}.{a}").alias(f"{a}{i}") for i, p in ((1, "p"), (2, "q")) for a in "xy"]
    return rows.select(*keys, "polygon", "hole", "place", "last", *ends, "side").repartition(*ENDS)


def slope(lat: Column) -> Column:
    """How fast the authalic height grows with latitude, per degree."""
    e2, s = G.ECCENTRICITY2, F.sin(F.radians(lat))
    return math.radians(2 * (1 - e2)) * F.cos(F.radians(lat)) / F.pow(1 - e2 * s * s, 2)


SCALE = G.AXIS**2 / 2 * math.pi / 180


def area(outlines: DataFrame, *keys: str) -> DataFrame:
    """keys and area_m2 inside the edges, on the ellipsoid."""
    x = lambda t: F.col("x1") + t * (F.col("x2") - F.col("x1"))
    east = sum((w * x(t) * slope(F.col("y1") + t * (F.col("y2") - F.col("y1"))) for t, w in NODES), F.lit(0.0))
    return outlines.groupBy(*keys).agg((F.sum(F.col("side") * (F.col("y1") - F.col("y2")) * east) * SCALE).alias("area_m2"))


def between(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def cut(rows: DataFrame, axis: str, other: str, low: Column, high: Column) -> DataFrame:
    """The part of each edge between two lines across an axis; ends that lie between them are kept as they are."""
    a1, a2, b1, b2 = (F.col(c) for c in (f"{axis}1", f"{axis}2", f"{other}1", f"{other}2"))
    rows = rows.withColumns({"_1": between(a1, low, high), "_2": between(a2, low, high)})
    along = lambda a: b1 + (a - a1) / (a2 - a1) * (b2 - b1)
    ends = {f"{axis}1": F.col("_1"), f"{axis}2": F.col("_2"), f"{other}1": F.when(F.col("_1") == a1, b1).otherwise(along(F.col("_1"))), f"{other}2": F.when(F.col("_2") == a2, b2).otherwise(along(F.col("_2")))}
    return rows.withColumns(ends).drop("_1", "_2")


def span(low: str, high: str, origin: float, least: int, most: int) -> Column:
    """The numbers of the cells along an axis that the interval between two columns enters."""
    number = lambda c: (c - origin + G.HALF) / G.STEP
    first = F.greatest(F.lit(least), F.floor(number(F.least(low, high))))
    last = F.least(F.lit(most), F.greatest(first, F.ceil(number(F.greatest(low, high))) - 1))
    return F.when(first <= last, F.sequence(first, last))


def cells(outlines: DataFrame, south: float, west: float, n_lat: int, n_lon: int, *keys: str) -> DataFrame:
    """keys, iy, ix, area_m2 of each cell that the outlines cover a part of. Edges are cut once per band of latitude, then once per column. Each piece gives the
    area east of it in its own cell, and what it adds to every cell further east; one running sum along a row's cells then tells all of them, and
    those between two that edges enter are filled from it without a cut."""
    rows = outlines.where("y1 <> y2").withColumn("iy", F.explode(span("y1", "y2", south, 0, n_lat - 1)))
    line = lambda n, origin: origin + n * G.STEP - G.HALF
    rows = cut(rows, "y", "x", line(F.col("iy"), south), line(F.col("iy") + 1, south)).where("y1 <> y2")
    # what lies west of the grid counts for the cells east of it, as column -1
    rows = rows.withColumn("ix", F.explode(span("x1", "x2", west, -1, n_lon - 1)))
    low = F.when(F.col("ix") < 0, F.lit(float("-inf"))).otherwise(line(F.col("ix"), west))
    rows = cut(rows, "x", "y", low, line(F.col("ix") + 1, west))
    rise, east = F.col("y2") - F.col("y1"), line(F.col("ix") + 1, west)
    steep = [(t, w * slope(F.col("y1") + t * rise)) for t, w in NODES]
    rows = rows.withColumns({"beyond": F.col("side") * rise * sum((s for _, s in steep), F.lit(0.0)), "own": F.col("side") * rise * sum(((east - F.col("x1") - t * (F.col("x2") - F.col("x1"))) * s for t, s in steep), F.lit(0.0))})
    summed = rows.groupBy(*keys, "iy", "ix").agg(F.sum("own").alias("own"), F.sum("beyond").alias("beyond"))
    row = Window.partitionBy(*keys, "iy").orderBy("ix")
    ahead = F.coalesce(F.sum("beyond").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ran = summed.withColumns({"ahead": ahead, "stop": F.lead("ix", 1, n_lon).over(row)})
    full = G.authalic(line(F.col("iy") + 1, south)) - G.authalic(line(F.col("iy"), south))
    # between two cells that edges enter, the cover is the same for each: none, but for rounding, or all of the band, or what a level edge leaves of it
    after = F.col("ahead") + F.col("beyond")
    ran = ran.withColumn("inside", F.when(F.abs(after) > 1e-9 * full, after).otherwise(0.0))
    until = F.when(F.col("inside") != 0, F.col("stop") - 1).otherwise(F.col("ix"))
    told = ran.withColumn("cell", F.explode(F.sequence(F.col("ix"), until))).where("cell >= 0")
    held = F.when(F.col("cell") == F.col("ix"), F.col("own") + F.col("ahead") * G.STEP).otherwise(F.col("inside") * G.STEP) * SCALE
    return told.select(*keys, F.col("iy").cast("int").alias("iy"), F.col("cell").cast("int").alias("ix"), held.alias("area_m2")).where(F.col("area_m2") > TINY)


def bands(outlines: DataFrame, *keys: str) -> DataFrame:
    """outlines with the bands of their key that they enter, exploded: band, its lower and upper line. A key has as many bands as edges."""
    sizes = outlines.groupBy(*keys).agg(F.min(F.least("y1", "y2")).alias("base"), F.max(F.greatest("y1", "y2")).alias("top"), F.count("*").alias("n"))
    sized = outlines.join(sizes.where("top > base"), list(keys)).withColumn("tall", (F.col("top") - F.col("base")) / F.col("n"))
    number = lambda y: F.least(F.floor((y - F.col("base")) / F.col("tall")), F.col("n") - 1)
    spread = sized.withColumn("band", F.explode(F.sequence(number(F.least("y1", "y2")), number(F.greatest("y1", "y2")))))
    upper = F.when(F.col("band") + 1 == F.col("n"), F.col("top")).otherwise(F.col("base") + (F.col("band") + 1) * F.col("tall"))
    return spread.withColumns({"lower": F.col("base") + F.col("band") * F.col("tall"), "upper": upper}).drop("base", "top", "tall", "n")


def crossings(outlines: DataFrame, *keys: str) -> DataFrame:
    """keys, band and y of the places where two edges of a key meet as they should not: they cross, or lie upon each other, or two edges of a ring that are no neighbours touch.
    Pairs meet in the bands that both enter, in each with the height nearest to theirs."""
    held = bands(outlines, *keys).withColumn("id", F.struct("polygon", "hole", "place"))
    a = held.select(*keys, "band", "lower", "upper", "id", "last", *ENDS)
    b = held.select(*keys, "band", *[F.col(c).alias(f"b_{c}") for c in ("id", *ENDS)])
    apart = F.col("id") < F.col("b_id")
    near = (F.least("x1", "x2") <= F.greatest("b_x1", "b_x2")) & (F.least("b_x1", "b_x2") <= F.greatest("x1", "x2")) & (F.least("y1", "y2") <= F.greatest("b_y1", "b_y2")) & (F.least("b_y1", "b_y2") <= F.greatest("y1", "y2"))
    pairs = a.join(b, [*keys, "band"]).where(apart & near)
    c = {k: F.col(k) for k in (*ENDS, *(f"b_{x}" for x in ENDS))}

    def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    line, other = (c["x1"], c["y1"], c["x2"], c["y2"]), (c["b_x1"], c["b_y1"], c["b_x2"], c["b_y2"])
    pairs = pairs.withColumns({"s1": turn(*line, *other[:2]), "s2": turn(*line, *other[2:]), "s3": turn(*other, *line[:2]), "s4": turn(*other, *line[2:])})
    across = (F.col("s1") * F.col("s2") < 0) & (F.col("s3") * F.col("s4") < 0)
    meet = (F.col("s1") * F.col("s2") <= 0) & (F.col("s3") * F.col("s4") <= 0)
    flat = (F.col("s1") == 0) & (F.col("s2") == 0)
    same = (F.col("id.polygon") == F.col("b_id.polygon")) & (F.col("id.hole") == F.col("b_id.hole"))
    gap = F.col("b_id.place") - F.col("id.place")
    next_to = same & ((gap == 1) | (gap == F.col("last")))
    # on one line, the boxes overlap by more than a point
    upon = flat & ((F.least(F.greatest("x1", "x2"), F.greatest("b_x1", "b_x2")) > F.greatest(F.least("x1", "x2"), F.least("b_x1", "b_x2"))) | (F.least(F.greatest("y1", "y2"), F.greatest("b_y1", "b_y2")) > F.greatest(F.least("y1", "y2"), F.least("b_y1", "b_y2"))))
    touch = meet & same & ~next_to
    at = c["y1"] + F.col("s3") / (F.col("s3") - F.col("s4")) * (c["y2"] - c["y1"])
    return pairs.where(across | upon | touch).select(*keys, "band", between(F.when(across, at).otherwise(c["y1"]), F.col("lower"), F.col("upper")).alias("y"))


def slabs(outlines: DataFrame, found: DataFrame, *keys: str, rule: str = "parity") -> DataFrame:
    """The edges that bound what the outlines cover: by parity, where an odd number of rings is around a point, or by cover, where at least one polygon is.
    Between two heights at which edges end or cross, edges keep their order from west to east, so a running count tells where the inside begins and ends."""
    held = bands(outlines, *keys)
    inside = lambda y: between(y, F.col("lower"), F.col("upper"))
    ends = held.select(*keys, "band", "lower", "upper", F.explode(F.array(inside(F.col("y1")), inside(F.col("y2")), "lower", "upper")).alias("y"))
    heights = ends.unionByName(found.select(*keys, "band", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), "y"))
    above = F.lead("y").over(Window.partitionBy(*keys, "band").orderBy("y"))
    strips = heights.select(*keys, "band", "y").distinct().withColumn("high", above).where("high > y").withColumnRenamed("y", "low")
    pieces = held.where("y1 <> y2").join(strips, [*keys, "band"]).where((F.least("y1", "y2") < (F.col("low") + F.col("high")) / 2) & (F.greatest("y1", "y2") > (F.col("low") + F.col("high")) / 2))
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    pieces = pieces.select(*keys, "low", "high", x_at(F.col("low")).alias("a"), x_at(F.col("high")).alias("b"), (F.col("side") * F.signum(F.col("y2") - F.col("y1"))).alias("enter"))
    order = Window.partitionBy(*keys, "low").orderBy(F.col("a") + F.col("b"), "a")
    if rule == "cover":
        # edges upon each other open and close together
        pieces = pieces.groupBy(*keys, "low", "high", "a", "b").agg(F.sum("enter").alias("enter"))
        run = F.sum("enter").over(order.rowsBetween(Window.unboundedPreceding, 0))
        turned = pieces.withColumn("run", run).withColumn("opens", F.col("run") - F.col("enter") < 0.5)
        bounds = turned.where((F.col("run") > 0.5) == F.col("opens"))
    else:
        bounds = pieces.withColumn("opens", F.row_number().over(order) % 2 == 1)
    paired = bounds.withColumns({"a2": F.lead("a").over(order), "b2": F.lead("b").over(order)}).where("opens AND a2 IS NOT NULL")
    corners = [("a", "low"), ("a2", "low"), ("b2", "high"), ("b", "high")]
    around = [F.struct(*[F.col(c).alias(n) for n, c in zip(ENDS, (*p, *q))]) for p, q in zip(corners, corners[1:] + corners[:1])]
    none = lambda n: F.lit(0).alias(n)
    return paired.select(*keys, F.xxhash64("low").alias("polygon"), none("hole"), F.posexplode(F.array(*around)).alias("place", "e")).select(*keys, "polygon", "hole", "place", F.lit(3).alias("last"), "e.*", F.lit(-1.0).alias("side"))


def inner_points(outlines: DataFrame, *keys: str) -> DataFrame:
    """keys, lon, lat of a point inside: the middle of the widest chord on a line of latitude through each polygon, midway between the vertices next to its centre."""
    each = [*keys, "polygon"]
    centre = outlines.groupBy(*each).agg(((F.min("y1") + F.max("y1")) / 2).alias("centre"), ((F.min("y2") + F.max("y2")) / 2).alias("other"), F.min(F.least("y1", "y2")).alias("lowest"), F.max(F.greatest("y1", "y2")).alias("highest"))
    centre = centre.select(*each, ((F.col("lowest") + F.col("highest")) / 2).alias("centre"))
    placed = outlines.join(centre, each)
    ends = placed.select(*each, "centre", F.explode(F.array("y1", "y2")).alias("y"))
    lines = ends.groupBy(*each).agg(((F.max(F.when(F.col("y") <= F.col("centre"), F.col("y"))) + F.min(F.when(F.col("y") > F.col("centre"), F.col("y")))) / 2).alias("lat")).where("lat IS NOT NULL")
    met = outlines.join(lines, each).where((F.least("y1", "y2") <= F.col("lat")) & (F.greatest("y1", "y2") > F.col("lat")))
    met = met.withColumn("x", F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    line = Window.partitionBy(*each).orderBy("x")
    chords = met.select(*each, "lat", "x", F.lead("x").over(line).alias("east"), F.row_number().over(line).alias("k")).where("k % 2 = 1 AND east IS NOT NULL")
    # of chords that are as wide but for rounding, the western one
    width = F.round(F.col("east") - F.col("x"), 9)
    widest = F.min(F.struct((-width).alias("narrow"), "x", ((F.col("east") + F.col("x")) / 2).alias("lon"), "lat"))
    return chords.groupBy(*keys).agg(widest.alias("c")).select(*keys, "c.lon", "c.lat")


def projected_area(outlines: DataFrame, points: DataFrame, *keys: str) -> DataFrame:
    """keys, area_m2 in an ellipsoidal azimuthal equal-area projection about each key's point (lon, lat), edges made denser to DENSE degrees."""
    e2 = G.ECCENTRICITY2
    pole = (1 - e2) * (1 / (1 - e2) - math.log((1 - math.sqrt(e2)) / (1 + math.sqrt(e2))) / (2 * math.sqrt(e2)))
    radius = G.AXIS * math.sqrt(pole / 2)
    beta = lambda lat: F.asin(G.authalic(lat) / pole)
    s = F.sin(F.radians("lat"))
    about = points.withColumn("beta0", beta(F.col("lat"))).withColumn("d", G.AXIS * F.cos(F.radians("lat")) / F.sqrt(1 - e2 * s * s) / (radius * F.cos("beta0"))).withColumnRenamed("lon", "lon0").drop("lat")
    placed = outlines.join(about, list(keys))
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) / DENSE))
    dense = placed.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    for i, k in ((1, F.col("k")), (2, F.col("k") + 1)):
        t = k / F.col("parts")
        dense = dense.withColumns({f"lam{i}": F.radians(F.col("x1") + t * (F.col("x2") - F.col("x1")) - F.col("lon0")), f"beta{i}": beta(F.col("y1") + t * (F.col("y2") - F.col("y1")))})
    for i in (1, 2):
        lam, b, b0 = F.col(f"lam{i}"), F.col(f"beta{i}"), F.col("beta0")
        dense = dense.withColumn(f"near{i}", radius * F.sqrt(2 / (1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(lam))))
        dense = dense.withColumns({f"px{i}": F.col(f"near{i}") * F.col("d") * F.cos(b) * F.sin(lam), f"py{i}": F.col(f"near{i}") / F.col("d") * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(lam))})
    # the side of an edge counts the area east of it; a ring that turns left has side -1
    twice = F.col("side") * (F.col("px2") * F.col("py1") - F.col("px1") * F.col("py2"))
    return dense.groupBy(*keys).agg((F.sum(twice) / 2).alias("area_m2"))
