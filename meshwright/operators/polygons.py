"""Regions as polygons, from their parts to the weights of the grid cells that they cover.

A geometry is an array of parts (kind, polygons); a polygon is an array of rings, the first its outline, the others its holes; a ring is an
array of points (x, y), closed or not. Edges are straight in longitude and latitude. Whole geometries are only cleaned; all else is done on their edges (outlines). All of it is Column expressions: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import write_table
from . import grid as G
from . import outlines as O

POLYGONAL = ("Polygon", "MultiPolygon")
VALID, REPAIRED, SKIPPED = "valid", "repaired", "skipped"


def polygonal_parts(parts: Column) -> Column:
    """The polygons of the parts that are polygonal, in one array; null where there are none."""
    kept = F.flatten(F.transform(F.filter(parts, lambda p: p["kind"].isin(*POLYGONAL)), lambda p: p["polygons"]))
    return F.when(F.size(kept) > 0, kept)


def ring_has_area(ring: Column) -> Column:
    """Whether a ring's points, as (x, y), do not all lie on one line back and forth."""
    origin = F.element_at(ring, 1)
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    size = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + F.abs((e["p"]["x"] - origin["x"]) * (e["q"]["y"] - origin["y"]) - (e["q"]["x"] - origin["x"]) * (e["p"]["y"] - origin["y"])))
    return (F.size(ring) >= 3) & (size > 0)


def repaired(cities: DataFrame, parts: str = "parts") -> DataFrame:
    """cities with polygons and status: valid; repaired, where parts, repeated points or rings without an area had to go; skipped, where no polygon
    with an area is left, or a coordinate is no number (polygons is null then). Rings that cross themselves are untangled as edges, by assess()."""
    first = cities.withColumn("_all", polygonal_parts(F.col(parts)))
    opened = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    staged = first.withColumns({"_open": F.transform("_all", lambda p: F.transform(p, opened)), "_clean": F.transform("_all", lambda p: F.transform(p, O.clean_ring))})
    finite = lambda v: F.abs(v) < float("inf")
    number = F.forall(F.flatten(F.flatten("_clean")), lambda p: finite(p["x"]) & finite(p["y"]) & p["x"].isNotNull() & p["y"].isNotNull())
    good = F.filter("_clean", lambda p: (F.size(p) > 0) & ring_has_area(F.get(p, F.lit(0))))
    staged = staged.withColumn("_kept", F.when(number, F.transform(good, lambda p: F.filter(p, ring_has_area))))
    found = staged.withColumn("polygons", F.when(F.size("_kept") > 0, F.col("_kept")))
    as_given = (F.size(F.filter(parts, lambda p: p["kind"].isin(*POLYGONAL))) == F.size(parts)) & (F.col("_open") == F.col("_kept"))
    status = F.when(F.col("polygons").isNull(), SKIPPED).when(as_given, VALID).otherwise(REPAIRED)
    return found.withColumn("status", status).drop("_all", "_open", "_clean", "_kept")


def assess(cities: DataFrame, parts: str = "parts") -> tuple[DataFrame, DataFrame]:
    """From city_id, city_name, parts: the edges of the valid or repaired cities, and for every city city_id, city_name, status, city_area_m2 (null if
    skipped). Edges that cross or lie upon each other are replaced by the outline of what an odd number of rings surrounds."""
    named = write_table(repaired(cities, parts).select("city_id", "city_name", "status", "polygons"), "repaired")
    given = write_table(O.edges(named.where("polygons IS NOT NULL"), "city_id"), "edges")
    found = write_table(O.crossings(given, "city_id"), "crossings")
    tangled = found.select("city_id").distinct()
    outlines = given.join(tangled, "city_id", "left_anti").unionByName(O.slabs(given.join(tangled, "city_id", "left_semi"), found, "city_id"))
    outlines = write_table(outlines, "outlines")
    told = named.drop("polygons").join(O.area(outlines, "city_id"), "city_id", "left").join(tangled.withColumn("tangled", F.lit(True)), "city_id", "left")
    sound = (F.col("area_m2") > 0) & (F.col("area_m2") < float("inf"))
    status = F.when(~F.coalesce(sound, F.lit(False)), SKIPPED).when(F.col("tangled"), REPAIRED).otherwise(F.col("status"))
    return outlines, told.select("city_id", "city_name", status.alias("status"), F.when(sound, F.col("area_m2")).alias("city_area_m2"))


def with_bounds(cities: DataFrame) -> DataFrame:
    """cities with xmin, ymin, xmax, ymax of their polygons."""
    points = F.flatten(F.flatten("polygons"))
    least = lambda axis, f: f(F.transform(points, lambda p: p[axis]))
    return cities.withColumns({"xmin": least("x", F.array_min), "ymin": least("y", F.array_min), "xmax": least("x", F.array_max), "ymax": least("y", F.array_max)})


def with_centres(cities: DataFrame) -> DataFrame:
    """cities (with bounds) with the middle of their bounds."""
    return cities.withColumns({"centre_lon": (F.col("xmin") + F.col("xmax")) / 2, "centre_lat": (F.col("ymin") + F.col("ymax")) / 2})


def united(outlines: DataFrame, *keys: str) -> DataFrame:
    """The edges around all polygons of a key; ground that several cover counts once."""
    mine = outlines.withColumn("polygon", F.xxhash64("city_id", "polygon")) if "city_id" in outlines.columns and "city_id" not in keys else outlines
    mine = write_table(mine, "edges")
    return O.slabs(mine, write_table(O.crossings(mine, *keys), "crossings"), *keys, rule="cover")


def build_weights(cities: DataFrame, country: str, south: float, west: float, n_lat: int, n_lon: int) -> tuple[DataFrame, DataFrame]:
    """The whole way from city_id, city_name, country, parts: weights (city_id, cell_id, area_m2), written once, and for every city of the country city_id,
    city_name, status, city_area_m2 (null if skipped), grid_overlap_count, grid_coverage_fraction."""
    outlines, told = assess(cities.where(F.col("country") == country))
    kept = told.where(F.col("status") != SKIPPED).select("city_id")
    cells = O.cells(outlines.join(kept, "city_id", "left_semi"), south, west, n_lat, n_lon, "city_id")
    weights = write_table(cells.select("city_id", G.flat_id(F.col("iy"), F.col("ix"), n_lon).cast("long").alias("cell_id"), "area_m2"), "weights")
    held = weights.groupBy("city_id").agg(F.count("*").alias("n"), F.sum("area_m2").alias("held"))
    return weights, told.join(held, "city_id", "left").select(
        "city_id",
        "city_name",
        "status",
        "city_area_m2",
        F.coalesce("n", F.lit(0)).alias("grid_overlap_count"),
        F.coalesce(F.col("held") / F.col("city_area_m2"), F.lit(0.0)).alias("grid_coverage_fraction"),
    )


def geometry_report(told: DataFrame) -> DataFrame:
    """One row: a JSON document of how many cities there are, were processed, repaired and skipped, and which. At most one entry per city is listed."""
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("city_id", "city_name"))))
    counts = told.agg(
        F.count("*").alias("city_count"),
        F.count_if(F.col("status") != SKIPPED).alias("processed_city_count"),
        F.count_if(F.col("status") == REPAIRED).alias("repaired_city_count"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped_city_count"),
        listed(REPAIRED).alias("repaired_cities"),
        listed(SKIPPED).alias("skipped_cities"),
    )
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("report"))
