"""Queries over polygons: regions that are derived from the customers of each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import outlines as O
from ..operators import polygons as P
from ..sources import tables as T
from ..sources import wkb as B
from .registry import query, rounded

#: The grid: a quarter of a degree, from 20 N 90 E on.
SOUTH, WEST, N_LAT, N_LON = 20.0, 90.0, 80, 160
CORNERS = 8
#: The eight corners of a region lie about its centre at distances that its customers decide; every third has a hole, those of odd numbers also a
#: line, number 24 nothing but a line; number 7's outline repeats its first corners.
CORNER_SQL = f"""SELECT n_nationkey AS city_id, k, 100 + n_nationkey % 5 * 4 AS cx, 25 + n_nationkey // 5 * 3 AS cy,
  0.3 + coalesce(sum(c_custkey % 97), 0) % 60 / 50.0::DOUBLE AS r
FROM nation CROSS JOIN range({CORNERS}) t(k) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % {CORNERS} = k GROUP BY ALL"""


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_id, city_name, k, cx, cy (the centre), radius, angle."""
    customers = T.read_table(spark, sf_dir, "customer")
    sums = customers.groupBy(F.col("c_nationkey").alias("city_id"), (F.col("c_custkey") % CORNERS).alias("k")).agg(F.sum(F.col("c_custkey") % 97).alias("s"))
    every = T.cities(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CORNERS - 1).cast("long"))))
    radius = F.lit(0.3) + F.coalesce("s", F.lit(0)) % 60 / F.lit(50.0)
    angle = F.col("k") * F.lit(2.0) * F.pi() / CORNERS
    cx, cy = 100 + F.col("city_id") % 5 * 4, 25 + F.floor(F.col("city_id") / 5) * 3
    return every.join(sums, ["city_id", "k"], "left").select("city_id", "city_name", "k", cx.alias("cx"), cy.alias("cy"), radius.alias("radius"), angle.alias("angle"))


def point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_id, city_name, country, parts."""
    cx, cy = 100 + F.col("city_id") % 5 * 4, 25 + F.floor(F.col("city_id") / 5) * 3
    at = point(F.col("cx") + F.col("radius") * F.cos("angle"), F.col("cy") + F.col("radius") * F.sin("angle"))
    placed = corners(spark, sf_dir).select("city_id", "city_name", "k", at.alias("p"))
    rings = placed.groupBy("city_id", "city_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("ring"))
    centre = lambda dx, dy: point(cx + F.lit(dx), cy + F.lit(dy))
    hole = F.array(centre(0.1, 0.0), centre(0.0, 0.1), centre(-0.1, 0.0), centre(0.0, -0.1))
    outline = F.when(F.col("city_id") == 7, F.concat(F.slice("ring", 1, 1), "ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    area = F.struct(F.lit("Polygon").alias("kind"), F.array(F.when(F.col("city_id") % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline))).alias("polygons"))
    line = F.struct(F.lit("LineString").alias("kind"), F.array(F.array(F.slice("ring", 1, 2))).alias("polygons"))
    parts = F.when(F.col("city_id") == 24, F.array(line)).when(F.col("city_id") % 2 == 1, F.array(area, line)).otherwise(F.array(area))
    country = F.when(F.col("city_id") == 23, "abroad").otherwise("home")
    return rings.select("city_id", "city_name", country.alias("country"), parts.alias("parts"))


E2 = G.ECCENTRICITY2
HEIGHT_SQL = lambda a: f"({1 - E2} * (sin(radians({a})) / (1 - {E2} * sin(radians({a})) ** 2) - ln((1 - sqrt({E2}) * sin(radians({a}))) / (1 + sqrt({E2}) * sin(radians({a})))) / (2 * sqrt({E2}))))"
EDGE_SQL = "radians(x2 - x1) * (" + " + ".join(f"{w} * {HEIGHT_SQL(f'(y1 + {t} * (y2 - y1))')}" for t, w in O.NODES) + ")"
AREA_SQL = f"""corners AS ({CORNER_SQL}),
points AS (SELECT city_id, 0 AS ring, k, cx + r * cos(k * 2.0 * pi() / {CORNERS}) AS x, cy + r * sin(k * 2.0 * pi() / {CORNERS}) AS y FROM corners
  UNION ALL SELECT DISTINCT city_id, 1, h.k, cx + h.dx, cy + h.dy FROM corners CROSS JOIN (VALUES (0, 0.1, 0.0), (1, 0.0, 0.1), (2, -0.1, 0.0), (3, 0.0, -0.1)) h(k, dx, dy) WHERE city_id % 3 = 0),
edges AS (SELECT city_id, ring, k, x::DOUBLE AS x1, y::DOUBLE AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w)::DOUBLE AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w)::DOUBLE AS y2
  FROM points WINDOW w AS (PARTITION BY city_id, ring ORDER BY k)),
rings AS (SELECT city_id, ring, abs(sum({EDGE_SQL})) * {G.AXIS}::DOUBLE ** 2 / 2 AS area FROM edges GROUP BY 1, 2),
areas AS (SELECT city_id, sum(CASE ring WHEN 0 THEN area ELSE -area END) AS area FROM rings WHERE city_id <> 24 GROUP BY 1)"""
STATUS_SQL = "CASE WHEN n_nationkey = 24 THEN 'skipped' WHEN n_nationkey % 2 = 1 OR n_nationkey = 7 THEN 'repaired' ELSE 'valid' END"


@query(f"""WITH {AREA_SQL} SELECT n_nationkey AS city_id, {STATUS_SQL} AS status, round(area / 1e6, 3) AS city_area_km2, round(area / 1e6, 3) AS cell_area_km2,
  CASE WHEN area IS NULL THEN 0.0 ELSE 1.0 END AS grid_coverage_fraction FROM nation LEFT JOIN areas ON n_nationkey = city_id WHERE n_nationkey <> 23""")
def region_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons to weights, written and read back: the cells' shares of a region add up to it."""
    weights, told = P.build_weights(regions(spark, sf_dir), "home", SOUTH, WEST, N_LAT, N_LON)
    held = weights.groupBy("city_id").agg(F.sum("area_m2").alias("held"))
    found = told.join(held, "city_id", "left").select("city_id", "status", (F.col("city_area_m2") / 1e6).alias("city_area_km2"), (F.col("held") / 1e6).alias("cell_area_km2"), "grid_coverage_fraction")
    return rounded(rounded(found, "city_area_km2", "cell_area_km2", places=3), "grid_coverage_fraction")


#: How fast the authalic height grows, per degree; then the area east of a piece of an edge, up to the line e.
SLOPE_SQL = lambda a: f"({1 - E2} * 2 * radians(cos(radians({a}))) / (1 - {E2} * sin(radians({a})) ** 2) ** 2)"
#: Every edge against every cell of the rows that it passes: in up to three pieces it lies west of the cell, in it and east of it.
CELL_SQL = f"""WITH {AREA_SQL},
turned AS (SELECT city_id, ring, CASE ring WHEN 0 THEN -1 ELSE 1 END * sign(sum(x1 * y2 - x2 * y1)) AS side FROM edges GROUP BY 1, 2),
rowed AS (SELECT city_id, side, x1, y1, x2, y2, iy, {SOUTH} + iy * {G.STEP} - {G.HALF} AS lo, {SOUTH} + (iy + 1) * {G.STEP} - {G.HALF} AS hi
  FROM edges JOIN turned USING (city_id, ring) CROSS JOIN range({N_LAT}) r(iy) WHERE y1 <> y2 AND city_id NOT IN (23, 24)),
cut AS (SELECT *, (greatest(lo, least(hi, y1)) - y1) / (y2 - y1) AS ta, (greatest(lo, least(hi, y2)) - y1) / (y2 - y1) AS tb FROM rowed WHERE least(y1, y2) < hi AND greatest(y1, y2) > lo),
held AS (SELECT *, {WEST} + ix * {G.STEP} - {G.HALF} AS w, {WEST} + (ix + 1) * {G.STEP} - {G.HALF} AS e FROM cut CROSS JOIN range({N_LON}) c(ix)),
parts AS (SELECT *, CASE WHEN x1 = x2 THEN ta ELSE greatest(ta, least(tb, least((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)))) END AS t1,
  CASE WHEN x1 = x2 THEN ta ELSE greatest(ta, least(tb, greatest((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)))) END AS t2 FROM held),
pieces AS (SELECT city_id, side, x1, y1, x2, y2, iy, ix, w, e, unnest([ta, t1, t2]) AS a, unnest([t1, t2, tb]) AS b FROM parts),
sums AS (SELECT city_id, iy, ix, sum(side * (b - a) * (y2 - y1) * ({" + ".join(f"{w} * {SLOPE_SQL(f'(y1 + (a + {t} * (b - a)) * (y2 - y1))')} * least(greatest(e - x1 - (a + {t} * (b - a)) * (x2 - x1), 0), {G.STEP})" for t, w in O.NODES)})) * {O.SCALE} AS area_m2
  FROM pieces WHERE b > a GROUP BY 1, 2, 3)
SELECT city_id, iy * {N_LON} + ix AS cell_id, round(area_m2 / 1e6, 5) AS area_km2 FROM sums WHERE area_m2 > 10"""


@query(CELL_SQL)
def region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's share of every region, but for slivers."""
    weights, _ = P.build_weights(regions(spark, sf_dir), "home", SOUTH, WEST, N_LAT, N_LON)
    return weights.where("area_m2 > 10").select("city_id", "cell_id", F.round(F.col("area_m2") / 1e6, 5).alias("area_km2"))


@query(f"""WITH p AS (SELECT city_id, cx + r * cos(k * 2.0 * pi() / {CORNERS}) AS x, cy + r * sin(k * 2.0 * pi() / {CORNERS}) AS y FROM ({CORNER_SQL}) WHERE city_id <> 24)
SELECT city_id, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax, round((min(x) + max(x)) / 2, 6) AS centre_lon, round((min(y) + max(y)) / 2, 6) AS centre_lat FROM p GROUP BY 1""")
def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = P.repaired(regions(spark, sf_dir)).where("polygons IS NOT NULL")
    found = P.with_centres(P.with_bounds(kept))
    return rounded(found.select("city_id", "xmin", "ymin", "xmax", "ymax", "centre_lon", "centre_lat"), "xmin", "ymin", "xmax", "ymax", "centre_lon", "centre_lat")


@query(f"WITH {AREA_SQL} SELECT n_regionkey AS region_id, count(*) AS n_polygons, round(sum(area) / 1e6, 3) AS area_km2 FROM areas JOIN nation ON n_nationkey = city_id GROUP BY 1")
def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that do not overlap, united by continent."""
    kept = P.repaired(regions(spark, sf_dir)).where("polygons IS NOT NULL")
    sizes = by_continent(spark, sf_dir, kept).groupBy("region_id").agg(F.sum(F.size("polygons")).alias("n_polygons"))
    areas = O.area(P.united(by_continent(spark, sf_dir, O.edges(kept, "city_id")), "region_id"), "region_id")
    return sizes.join(areas, "region_id").select("region_id", "n_polygons", F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"))


def by_continent(spark: SparkSession, sf_dir: str, some: DataFrame) -> DataFrame:
    nations = T.read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_regionkey").alias("region_id"))
    return some.join(T.small(nations), "city_id")


#: Shapes over the same corners, as (corner, share of its distance). By city_id % 3: a star whose edges cross, a bow-tie, an outline with a spike.
TANGLED = ([(3 * p % CORNERS, 1.0) for p in range(CORNERS)], [(k, 1.0) for k in (0, 2, 1, 3, 4, 5, 6, 7)], [*[(k, 1.0) for k in range(CORNERS)], (7, 2.0), (7, 1.0)])
#: By city_id % 3: open rings like a C, three and a half times as large for some, and the plain outline.
OPEN = ([*[(k, 1.0) for k in range(CORNERS - 1)], *[(k, 0.5) for k in reversed(range(CORNERS - 1))]], [(k, 3.5) for k in range(CORNERS)], [(k, 3.0) for k in range(CORNERS)])


def shaped(spark: SparkSession, sf_dir: str, shapes) -> DataFrame:
    """city_id, city_name, parts: one polygon over the corners of each region, without a hole."""
    steps = [F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).cast("long").alias("k"), F.lit(f).alias("f")) for i, (k, f) in enumerate(shape)]) for shape in shapes]
    kind = F.col("city_id") % 3
    order = T.cities(spark, sf_dir).where("city_id <> 24").select("city_id", F.explode(F.when(kind == 0, steps[0]).when(kind == 1, steps[1]).otherwise(steps[2])).alias("e")).select("city_id", "e.*")
    far = F.col("f") * F.col("radius")
    placed = corners(spark, sf_dir).join(order, ["city_id", "k"]).select("city_id", "city_name", "at", point(F.col("cx") + far * F.cos("angle"), F.col("cy") + far * F.sin("angle")).alias("p"))
    rings = placed.groupBy("city_id", "city_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("ring"))
    return rings.select("city_id", "city_name", F.array(F.struct(F.lit("Polygon").alias("kind"), F.array(F.array("ring")).alias("polygons"))).alias("parts"))


def shape_sql(shapes) -> str:
    """edges (city_id, k, x1, y1, x2, y2) of shaped()."""
    rows = ", ".join(f"({m}, {i}, {k}, {f}::DOUBLE)" for m, shape in enumerate(shapes) for i, (k, f) in enumerate(shape))
    return f"""shape(m, ord, k, f) AS (VALUES {rows}), corners AS ({CORNER_SQL}),
points AS (SELECT city_id, ord, cx + f * r * cos(corners.k * 2.0 * pi() / {CORNERS}) AS x, cy + f * r * sin(corners.k * 2.0 * pi() / {CORNERS}) AS y
  FROM corners JOIN shape ON m = city_id % 3 AND shape.k = corners.k WHERE city_id <> 24),
edges AS (SELECT city_id, ord AS k, x::DOUBLE AS x1, y::DOUBLE AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w)::DOUBLE AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w)::DOUBLE AS y2
  FROM points WINDOW w AS (PARTITION BY city_id ORDER BY ord))"""


#: From lines (g, id, x1, y1, x2, y2, turn) slabs between all heights at which lines end or any two cross; per slab the lines from west to east.
SLAB_SQL = """crossed AS (SELECT g, y1 + u / (u - v) * (y2 - y1) AS y FROM (
    SELECT a.g, a.y1, a.y2, (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS u, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS v,
      (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS s, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS t
    FROM lines a JOIN lines b ON a.g = b.g AND a.id < b.id) WHERE u * v < 0 AND s * t < 0),
heights AS (SELECT g, y1 AS y FROM lines UNION SELECT g, y2 FROM lines UNION SELECT g, y FROM crossed),
strips AS (SELECT g, y AS lo, lead(y) OVER (PARTITION BY g ORDER BY y) AS hi FROM heights),
cuts AS (SELECT g, lo, hi, turn, x1 + (lo - y1) / (y2 - y1) * (x2 - x1) AS xa, x1 + (hi - y1) / (y2 - y1) * (x2 - x1) AS xb
  FROM strips JOIN lines USING (g) WHERE y1 <> y2 AND hi > lo AND least(y1, y2) < (lo + hi) / 2 AND greatest(y1, y2) > (lo + hi) / 2),
walked AS (SELECT *, row_number() OVER w AS n, sum(turn) OVER w AS cover FROM cuts WINDOW w AS (PARTITION BY g, lo ORDER BY xa + xb, xa ROWS UNBOUNDED PRECEDING))"""
PIECE_SQL = "(lo - hi) * (" + " + ".join(f"{w} * (xa + {t} * (xb - xa)) * {SLOPE_SQL(f'(lo + {t} * (hi - lo))')}" for t, w in O.NODES) + f") * {O.SCALE}"


@query(f"""WITH {shape_sql(TANGLED)}, lines AS (SELECT city_id AS g, k AS id, x1, y1, x2, y2, 1 AS turn FROM edges), {SLAB_SQL}
SELECT g AS city_id, CASE WHEN g % 3 = 2 OR g IN (SELECT g FROM crossed) THEN 'repaired' ELSE 'valid' END AS status, round(sum(CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END * {PIECE_SQL}) / 1e6, 3) AS city_area_km2 FROM walked GROUP BY 1""")
def tangled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves, or have spikes, are repaired: inside is what an odd number of turns surrounds."""
    _, told = P.assess(shaped(spark, sf_dir, TANGLED))
    return told.select("city_id", "status", F.round(F.col("city_area_m2") / 1e6, 3).alias("city_area_km2"))


@query(f"""WITH {shape_sql(OPEN)}, turned AS (SELECT city_id, -sign(sum(x1 * y2 - x2 * y1)) AS side FROM edges GROUP BY 1),
lines AS (SELECT n_regionkey AS g, city_id * 100 + k AS id, x1, y1, x2, y2, side * sign(y2 - y1) AS turn FROM edges JOIN turned USING (city_id) JOIN nation ON n_nationkey = city_id), {SLAB_SQL}
SELECT g AS region_id, round(sum(CASE WHEN cover > 0.5 AND cover - turn < 0.5 THEN 1 WHEN cover < 0.5 AND cover - turn > 0.5 THEN -1 ELSE 0 END * {PIECE_SQL}) / 1e6, 3) AS area_km2 FROM walked GROUP BY 1""")
def overlapping_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that overlap, united by continent: shared ground counts once."""
    kept = P.repaired(shaped(spark, sf_dir, OPEN))
    united = P.united(by_continent(spark, sf_dir, O.edges(kept, "city_id")), "region_id")
    return O.area(united, "region_id").select("region_id", F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"))


INNER_SQL = """middle AS (SELECT city_id, (min(y1) + max(y1)) / 2 AS c FROM edges GROUP BY 1),
line AS (SELECT city_id, (max(y1) FILTER (WHERE y1 <= c) + min(y1) FILTER (WHERE y1 > c)) / 2 AS lat FROM edges JOIN middle USING (city_id) GROUP BY 1),
met AS (SELECT city_id, lat, x1 + (lat - y1) / (y2 - y1) * (x2 - x1) AS x FROM edges JOIN line USING (city_id) WHERE least(y1, y2) <= lat AND greatest(y1, y2) > lat),
chords AS (SELECT city_id, lat, x, lead(x) OVER w AS e, row_number() OVER w AS n FROM met WINDOW w AS (PARTITION BY city_id ORDER BY x)),
inner_point AS (SELECT city_id, (x + e) / 2 AS lon, lat FROM chords WHERE n % 2 = 1 AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY round(e - x, 9) DESC, x) = 1)"""


@query(f"WITH {shape_sql(OPEN)}, {INNER_SQL} SELECT city_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM inner_point")
def inner_points_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside each region; those that are open like a C do not hold the centre of their bounds."""
    outlines = T.write_table(O.edges(P.repaired(shaped(spark, sf_dir, OPEN)), "city_id"), "edges")
    return rounded(O.inner_points(outlines, "city_id"), "lon", "lat")


@query(f"WITH {AREA_SQL.replace('edges AS', 'all_edges AS').replace('FROM edges', 'FROM all_edges')}, edges AS (SELECT * FROM all_edges WHERE city_id <> 24), {INNER_SQL} SELECT city_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM inner_point")
def inner_points_holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside each region, none in a hole about the centre."""
    outlines = T.write_table(O.edges(P.repaired(regions(spark, sf_dir)).where("polygons IS NOT NULL"), "city_id"), "edges")
    return rounded(O.inner_points(outlines, "city_id"), "lon", "lat")


QP = f"{HEIGHT_SQL('90.0')}"
LAEA_SQL = f"""base AS (SELECT city_id, lon, asin({HEIGHT_SQL('lat')} / {QP}) AS b0, {G.AXIS}::DOUBLE * sqrt({QP} / 2) AS rq, cos(radians(lat)) / sqrt(1 - {E2} * sin(radians(lat)) ** 2) AS m FROM inner_point),
dense AS (SELECT *, unnest(range(ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / {O.DENSE})::BIGINT)) AS i, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / {O.DENSE}) AS n FROM edges),
stepped AS (SELECT city_id, ring, k, i, x1 + i / n * (x2 - x1) AS x, y1 + i / n * (y2 - y1) AS y FROM dense),
polar AS (SELECT city_id, ring, k, i, b0, rq, {G.AXIS}::DOUBLE * m / (rq * cos(b0)) AS d, radians(x - lon) AS lam, asin({HEIGHT_SQL('y')} / {QP}) AS b FROM stepped JOIN base USING (city_id)),
flat AS (SELECT city_id, ring, k, i, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(lam))) AS s, d, b, b0, lam FROM polar),
xy AS (SELECT city_id, ring, k, i, s * d * cos(b) * sin(lam) AS x, s / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(lam)) AS y FROM flat),
closed AS (SELECT city_id, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn FROM xy WINDOW w AS (PARTITION BY city_id, ring ORDER BY k, i)),
flats AS (SELECT city_id, ring, abs(sum(x * yn - xn * y)) / 2 AS area FROM closed GROUP BY 1, 2)"""


@query(f"WITH {AREA_SQL.replace('edges AS', 'all_edges AS').replace('FROM edges', 'FROM all_edges')}, edges AS (SELECT * FROM all_edges WHERE city_id <> 24), {INNER_SQL}, {LAEA_SQL} SELECT city_id, round(sum(CASE ring WHEN 0 THEN area ELSE -area END) / 1e6, 3) AS area_km2 FROM flats GROUP BY 1")
def projected_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in an equal-area projection about each region's inner point, with denser edges."""
    outlines = T.write_table(O.edges(P.repaired(regions(spark, sf_dir)).where("polygons IS NOT NULL"), "city_id"), "edges")
    found = O.projected_area(outlines, O.inner_points(outlines, "city_id"), "city_id")
    return found.select("city_id", F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"))


@query(f"""WITH q AS (SELECT n_nationkey AS city_id, n_name AS city_name, {STATUS_SQL} AS status FROM nation WHERE n_nationkey <> 23)
SELECT to_json({{'city_count': count(*), 'processed_city_count': count(*) FILTER (WHERE status <> 'skipped'), 'repaired_city_count': count(*) FILTER (WHERE status = 'repaired'),
  'skipped_city_count': count(*) FILTER (WHERE status = 'skipped'),
  'repaired_cities': coalesce(list({{'city_id': city_id, 'city_name': city_name}} ORDER BY city_id) FILTER (WHERE status = 'repaired'), []),
  'skipped_cities': coalesce(list({{'city_id': city_id, 'city_name': city_name}} ORDER BY city_id) FILTER (WHERE status = 'skipped'), [])}})::VARCHAR AS report FROM q""")
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, told = P.assess(regions(spark, sf_dir).where("country = 'home'"))
    return P.geometry_report(told)


@query(f"WITH {AREA_SQL} SELECT city_id, n_parts, round(area / 1e6, 3) AS area_km2 FROM areas JOIN (SELECT n_nationkey AS city_id, 1 + n_nationkey % 2 AS n_parts FROM nation) USING (city_id)")
def nested_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as well-known binary, each in a collection within a collection, parsed again."""
    blobs = T.write_table(B.with_blobs(regions(spark, sf_dir), depth=1), "blobs")
    parsed = B.with_parts(blobs)
    _, told = P.assess(parsed)
    parts = parsed.select("city_id", F.size("parts").cast("long").alias("n_parts"))
    return parts.join(told.where("city_area_m2 IS NOT NULL"), "city_id").select("city_id", "n_parts", F.round(F.col("city_area_m2") / 1e6, 3).alias("area_km2"))
