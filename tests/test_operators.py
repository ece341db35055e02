"""Small cases worked out by hand, and properties."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwright.functions import values as V
from meshwright.operators import grid as G
from meshwright.operators import ledger as L
from meshwright.operators import resample as R
from meshwright.operators import weighted as W
from meshwright.sources import sinks as S
from meshwright.streaming import logs

NAN, INF = float("nan"), float("inf")
CASES = [
    ([10, 20, 30, 40], [1, 1, 1, 1], (25, 40, 10, 10, 30, 1)),
    ([10, 20, 30], [1, 2, 5], (25, 30, 10, 20, 30, 1)),
    ([5, 5, 9], [1, 1, 2], (7, 9, 5, 5, 9, 1)),
    ([10, NAN, 30], [1, 2, 1], (20, 30, 10, 10, 30, 0.5)),
    ([10, INF, -INF], [1, 1, 2], (10, 10, 10, 10, 10, 0.25)),
    ([10, 20, 30], [0, -1, 4], (30, 30, 30, 30, 30, 1)),
    ([NAN, NAN], [1, 1], (None, None, None, None, None, 0)),
    ([7], [3], (7, 7, 7, 7, 7, 1)),
]


def test_weighted_statistics_golden_cases(spark):
    rows = [(k, float(x), float(w)) for k, (xs, ws, _) in enumerate(CASES) for x, w in zip(xs, ws)]
    found = W.statistics(spark.createDataFrame(rows, "k int, x double, w double"), ["k"], "x", "w")
    got = {r.k: tuple(r)[1:-1] for r in found.collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-9, 9), st.integers(1, 9)), min_size=1, max_size=40))
def test_quantile_strategies_agree_with_numpy(spark, rows):
    df = spark.createDataFrame([(k, float(x), float(w)) for k, x, w in rows], "k int, x double, w double")
    window = {r.k: (r.p25, r.p75) for r in W.statistics(df, ["k"], "x", "w").collect()}
    array = {r.k: (r.p25, r.p75) for r in W.quantiles_by_array(df, ["k"], "x", "w").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        x, w = np.array(sorted((x, w) for g, x, w in rows if g == k)).T
        run = np.cumsum(w) / w.sum()
        want[k] = tuple(float(x[min(np.searchsorted(run, p), len(x) - 1)]) for p in (0.25, 0.75))
    assert window == array == want


def test_quantile_arrays_are_bounded(spark):
    from pyspark.sql import functions as F

    # a hot key of few values, one of many values, a null key
    hot = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") % 11 / 100).alias("x"), (F.col("id") % 50 + 1.0).alias("w"))
    wide = spark.range(3_000).select(F.lit(2).alias("k"), (F.col("id") * 37 % 3000).cast("double").alias("x"), F.lit(1.0).alias("w"))
    none = spark.range(40).select(F.lit(None).cast("int").alias("k"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    df = hot.unionByName(wide).unionByName(none)
    want = {r.k: (r.p25, r.p75) for r in W.statistics(df, ["k"], "x", "w").collect()}
    for most in (5, 100, 10_000):
        found = W.quantiles_by_array(df, ["k"], "x", "w", most)
        assert {r.k: (r.p25, r.p75) for r in found.collect()} == want
    # the rows of a key are summed by value before they are listed
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "sum(w" in plan.split("collect_list", 1)[1]


def test_strict_days(spark):
    hours = [(1, dt.datetime(2024, 1, 1, h), 1.0 + h) for h in range(24)] + [(2, dt.datetime(2024, 1, 1, h), NAN if h == 5 else 1.0) for h in range(24)] + [(3, dt.datetime(2024, 1, 1, h), 1.0) for h in range(23)]
    field = spark.createDataFrame(hours, "cell_id int, ts timestamp_ntz, x double")
    got = {r.cell_id: r.x_mean for r in R.daily(field, hours=24).collect()}
    assert got == {1: 12.5, 2: None, 3: None}


def test_longitudes_units_and_hours(spark):
    one = spark.range(1)
    lons = one.select(*[V.wrap_longitude(F.lit(x)).alias(str(i)) for i, x in enumerate((359.75, 180.0, -180.0, 0.0))]).first()
    assert tuple(lons) == (-0.25, -180.0, -180.0, 0.0)
    assert one.select(V.to_celsius(F.lit(273.15), F.lit(" K "))).first()[0] == 0.0
    with pytest.raises(Exception, match="unknown unit"):
        one.select(V.to_celsius(F.lit(1.0), F.lit("F"))).collect()
    assert tuple(one.select(V.hours_in_year(F.lit(2023)), V.hours_in_year(F.lit(2024))).first()) == (8760, 8784)


def test_tiles(spark):
    tiles = {r.grid_id: r for r in G.tiles(spark).collect()}
    assert len(tiles) == 648
    first, last = tiles["G0001"], tiles["G0648"]
    assert (first.north, first.south, first.west, first.east, first.request_south, first.request_east) == (90, 80, -180, -170, 80.1, -170.1)
    assert (last.north, last.south, last.west, last.east, last.request_south, last.request_east) == (-80, -90, 170, 180, -90.0, 179.9)


def test_cell_area_and_partition_of_a_polygon(spark):
    one = spark.range(1)
    area = one.select(G.rectangle_area(F.lit(31.0), F.lit(31.25), F.lit(121.0), F.lit(121.25))).first()[0]
    assert math.isclose(area, 660_929_132, rel_tol=1e-7)
    corners = ((100.1, 30.05), (101.4, 30.3), (100.9, 31.2), (100.6, 30.5))
    ring = "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in corners) + ")"
    box = spark.sql(f"SELECT {ring} AS ring, 100.1D AS xmin, 101.4D AS xmax, 30.05D AS ymin, 31.2D AS ymax")
    parts = G.clip_to_cell(G.cells_by_arithmetic(box, 20.0, 90.0, 80, 120)).agg(F.sum("area_m2")).first()[0]
    whole = box.select(G.ring_area(F.col("ring"))).first()[0]
    assert math.isclose(parts, whole, rel_tol=2e-3)  # long edges are straight on the map, not in degrees


def test_touching_cells_have_no_weight(spark):
    box = spark.sql("SELECT 100.125D AS xmin, 100.375D AS xmax, 30.125D AS ymin, 30.375D AS ymax")
    cells = G.cells_by_arithmetic(box, 20.0, 90.0, 80, 120)
    assert [(r.lat, r.lon) for r in cells.collect()] == [(30.25, 100.25)]
    assert G.cell_overlaps(cells).count() == 1


def test_reconcile_truth_table(spark):
    tasks = [("a", 1998, "doing"), ("b", 2001, "doing"), ("c", 2001, "pending"), ("d", 2000, "failed"), ("e", 2000, "completed"), ("f", 2002, "completed"), ("g", 2000, "pending")]
    files = [("a", 5, dt.date(1998, 3, 1)), ("b", 5, dt.date(2001, 6, 1)), ("c", 5, dt.date(2001, 12, 31)), ("f", 9, dt.date(2002, 1, 1)), ("g", 1, dt.date(2000, 1, 1))]
    found = L.reconcile(spark.createDataFrame(tasks, "k string, year int, status string"), spark.createDataFrame(files, "k string, n int, last_seen date"), "k", 2001, least_rows=2)
    assert {r.k: (r.status, r.error) for r in found.collect()} == {
        "a": ("completed", None), "b": ("partial", None), "c": ("completed", None), "d": ("failed", None), "e": ("pending", "file is missing"), "f": ("pending", "file is missing"), "g": ("pending", "file is not whole"),
    }


def test_first_year_lacks_an_hour(spark):
    got = spark.range(1).select(L.expected_hours(F.lit(1950), F.lit(dt.date(1950, 12, 31))), L.expected_hours(F.lit(1952), F.lit(dt.date(1952, 12, 31)))).first()
    assert tuple(got) == (8759, 8784)
    assert [r[0] for r in spark.range(6).select(L.backoff_seconds(F.col("id"))).collect()] == [5, 10, 20, 40, 60, 60]


def test_alert_pattern(spark):
    lines = ["ok", "2024 ERROR y", "ValueError: x", "Traceback (most recent call last)", "terror", "noerror", "noerror: x"]
    got = {r.line for r in logs.alerts(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {lines[1], lines[2], lines[3], lines[6]}


def test_csv_bytes(spark, tmp_path):
    S.write_csv(spark.createDataFrame([("é", None), ("b", 1.5)], "name string, x double").coalesce(1), f"file://{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes() == "﻿name,x\r\né,nan\r\nb,1.5\r\n".encode()


def test_a_year_run_tells_data_faults_and_raises_others(spark):
    import datetime as dt

    from meshwright.operators import runs as U

    hours = spark.sql("SELECT 1L AS cell_id, CAST(h AS timestamp_ntz) AS ts, CAST(hour(h) AS double) AS x FROM (SELECT explode(sequence(TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2022-12-31 23:00:00', INTERVAL 1 HOUR)) AS h)")
    field = hours.where(F.col("ts") != dt.datetime(2021, 5, 5, 5)).unionByName(spark.createDataFrame([(1, dt.datetime(2022, 2, 2, 2, 30), 0.0)], "cell_id long, ts timestamp_ntz, x double"))
    weights = spark.createDataFrame([(1, 1, 2.0)], "city_id int, cell_id long, area double")
    cities = spark.createDataFrame([(1, "one", 4.0)], "city_id int, city_name string, city_area double")
    made, log = U.city_years(field, weights, cities, 2019, 2022)
    assert [(r.year, r.rows, r.error) for r in log.orderBy("year").collect()] == [(2019, 0, "0 hours of 8760"), (2020, 366, None), (2021, 0, "8759 hours of 8760"), (2022, 0, "1 times between hours")]
    (row,) = made.select("grid_coverage_fraction", "x_mean_mean", "x_max_max", "x_min_p25").distinct().collect()
    assert tuple(row) == (0.5, 11.5, 23.0, 0.0)
    with pytest.raises(AttributeError):
        U.years_one_by_one(spark, 2020, 2020, lambda year: None.nothing)


@pytest.mark.parametrize("block", [4, 5, 7, 4096])
def test_context_reaches_over_blocks(spark, block):
    rows = [(log, n, "ERROR: x" if n in (0, 7, 8, 30, 59) else "fine") for log in ("a", "b") for n in range(60 if log == "a" else 9)]
    got = logs.alerts_with_context(spark.createDataFrame(rows, "log string, n int, line string"), 4, "log", block).collect()
    want = [(log, n, line, line != "fine") for log, n, line in rows if any(x == log and abs(m - n) <= 4 and other != "fine" for x, m, other in rows)]
    assert sorted(map(tuple, got)) == want
