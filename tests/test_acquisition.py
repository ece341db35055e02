"""Files, ledger, series, runs and streams in small cases."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from meshwright.operators import ledger as L
from meshwright.operators import quality as Q
from meshwright.operators import runs as R
from meshwright.operators import series
from meshwright.operators.running import ordinals, running_total
from meshwright.sources import files as X
from meshwright.sources import sinks as S
from meshwright.sources import tables as T
from meshwright.streaming import logs


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for n in names:
            archive.writestr(n, n.upper())
    return out.getvalue()


def test_archives_hold_one_member(spark):
    good = spark.createDataFrame([("a.zip", zipped("x.NC", "readme.txt"))], "path string, content binary")
    assert [tuple(r) for r in X.single_members(good).collect()] == [("a.zip", "x.NC", b"X.NC")]
    for names in (("a.nc", "b.nc"), ("a.txt",)):
        with pytest.raises(Exception, match="members like"):
            X.single_members(spark.createDataFrame([("b.zip", zipped(*names))], "path string, content binary")).collect()


def test_discovery_and_inventory(spark, tmp_path):
    with pytest.raises(Exception, match=r"no files like|PATH_NOT_FOUND"):
        X.discover(spark, f"file://{tmp_path}", "*.parquet")
    rows = [(i, dt.datetime(2000 + i, 1, 3 - i)) for i in range(3)]
    spark.createDataFrame(rows, "k int, ts timestamp_ntz").coalesce(1).write.parquet(f"file://{tmp_path}/deep/er")
    assert X.discover(spark, f"file://{tmp_path}", "*.parquet").count() == 1
    (told,) = X.inventory(spark.read.parquet(f"file://{tmp_path}/deep/er"), "ts").collect()
    assert (told.n_times, told.first_ts, told.last_ts) == (3, dt.datetime(2000, 1, 3), dt.datetime(2002, 1, 1)) and told.length > 0


def test_retries_wait_but_not_after_the_last_attempt(spark):
    tries = [("won", 1, False), ("won", 2, False), ("won", 3, True), ("won", 4, True), ("lost", 1, False), ("lost", 2, False), ("lost", 3, False), ("lost", 4, True), ("open", 1, False), ("open", 2, None), ("first", 1, True)]
    got = {r.k: tuple(r)[1:] for r in L.retry_plan(spark.createDataFrame(tries, "k string, attempt int, ok boolean"), "k", most=3).collect()}
    assert got == {"won": (3, "completed", 2, 15), "lost": (3, "failed", 2, 15), "open": (2, "waiting", 2, 15), "first": (1, "completed", 0, 0)}


def test_inspection_of_all_kinds(spark):
    df = spark.createDataFrame([(1, "b", None, True), (3, None, dt.datetime(2000, 1, 2, 3), None), (None, "a", dt.datetime(1999, 1, 1), False)], "`x.y` int, t string, at timestamp_ntz, flag boolean")
    got = {r.column: tuple(r)[1:] for r in S.inspect(df).collect()}
    assert got["x.y"] == ("number", 2, 1, 1.0, 3.0, 2.0, None, None) and got["t"] == ("text", 2, 1, None, None, None, "a", "b")
    assert got["at"] == ("time", 2, 1, None, None, None, "1999-01-01 00:00:00.000000", "2000-01-02 03:00:00.000000") and got["flag"] == ("other", 2, 1, None, None, None, None, None)
    assert all(r.n == 0 and r.mean is None for r in S.inspect(df.limit(0)).collect())


def test_the_first_valid_file(spark):
    files = spark.createDataFrame([(3, True), (2, True), (1, False), (0, None)], "year int, ok boolean")
    assert [r.year for r in X.first_valid(files, "ok", "year").collect()] == [2] and X.first_valid(files.where("NOT ok"), "ok", "year").isEmpty()


def test_running_totals_over_ranges(spark):
    rows = [(i * 7 % 101, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r.k: r.t for r in running_total(df, ["k"], F.col("v"), "t").collect()}
    total = 0.0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v
    assert sorted((r.n, r.k) for r in ordinals(df, ["k"], "n").collect()) == [(i, i) for i in range(101)]
    assert running_total(df.limit(0), ["k"], F.col("v"), "t").collect() == []


def test_context_crosses_ranges_and_stays_in_its_log(spark):
    lines = [(d, n, "ERROR x" if (d, n) in {(1, 50), (2, 0), (2, 99)} else "ok") for d in (1, 2) for n in range(100)]
    found = logs.alerts_with_context(spark.createDataFrame(lines, "day int, n int, line string").repartition(7))
    want = {(1, n) for n in range(46, 55)} | {(2, n) for n in range(5)} | {(2, n) for n in range(95, 100)}
    assert {(r.day, r.n) for r in found.collect()} == want


def test_state_machine(spark):
    now = dt.date(2001, 11, 20)
    whole = 366 * 24
    tasks = spark.createDataFrame([("done", 2000), ("short", 2000), ("second", 2000), ("failed", 2000), ("future", 2002), ("now", 2001), ("untried", 2000)], "task_id string, year int")
    files = spark.createDataFrame([("done", whole, dt.date(2000, 12, 31)), ("short", whole - 1, dt.date(2000, 12, 31)), ("now", 9999, dt.date(2001, 11, 1))], "task_id string, n int, last_seen date")
    end = dt.date(2000, 12, 31)
    tries = [("short", 1, whole, end, None), ("second", 1, 0, None, "refused"), ("second", 2, whole, end, None), ("now", 1, 9999, dt.date(2001, 11, 15), None)]
    tries += [("failed", i, whole - 1, end, None if i < 3 else "e" * 3000) for i in (1, 2, 3)] + [("failed", 4, whole, end, None), ("done", 1, 0, None, "never tried")]
    found = L.transitions(tasks, files, spark.createDataFrame(tries, "task_id string, attempt int, n int, last_seen date, error string"), now, 5)
    assert {r.task_id: (r.outcome, r.status, r.attempts, r.last_error) for r in found.collect()} == {
        "done": ("already_complete", "completed", 0, None), "short": ("completed", "completed", 1, None), "second": ("completed", "completed", 2, None),
        "failed": ("failed", "failed", 3, "e" * 2000), "future": ("future", "pending", 0, None), "now": ("partial", "partial", 1, None), "untried": ("doing", "doing", 0, None),
    }


def test_ledger_has_its_columns_and_names(spark):
    from meshwright.operators import grid as G

    tasks = G.tiles(spark).where("grid_id = 'G0648'").withColumn("year", F.lit(1950))
    (row,) = L.new_ledger(tasks).collect()
    assert len(row) == 24 and row.task_id == "1950_G0648" and row.output_file == "1950/field_1950_G0648_S80_S90_E170_E180.nc"
    (asked,) = tasks.select(L.request("v", F.col("year"), F.lit(2), F.lit(28)).alias("r")).collect()
    assert asked.r.area == [-80.0, 170.0, -90.0, 179.9] and asked.r.day[-1] == "28" and asked.r.time[-1] == "23:00" and asked.r.month == ["02"]
    kept = L.pending_chunks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "t int, chunk string"), spark.createDataFrame([(1, "a", 5), (2, "a", 0)], "t int, chunk string, n int"), ["t", "chunk"])
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "b"), (2, "a")]


def test_series_take_one_form(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1), 1.0, 2.0, 3.0, 0)], "valid_time timestamp_ntz, lat double, lon double, t double, number int")
    found = series.normalised(df, "s", "t")
    assert found.columns == ["time", "latitude", "longitude", "x"] and found.schema["x"].metadata["long_name"] == "s"
    with pytest.raises(ValueError, match="there are"):
        series.normalised(df, "u")
    with pytest.raises(ValueError, match="missing columns: latitude"):
        series.normalised(df.drop("lat"), "t")
    with pytest.raises(ValueError, match="more than one value of number"):
        series.normalised(df.unionByName(df.withColumn("number", F.lit(1))), "t")
    assert series.renamed(df.withColumn("time", F.col("valid_time"))).columns.count("time") == 1
    with pytest.raises(ValueError, match="missing columns: a, b"):
        T.ensure_columns(df, "a", "b", "t")


def test_exact_hours_and_faults(spark):
    start = dt.datetime(2023, 1, 1)
    whole = [("a", i, start + dt.timedelta(hours=i)) for i in range(8760)]
    gap = [("b", i, start + dt.timedelta(hours=i + (i > 99))) for i in range(8759)]
    df = spark.createDataFrame(whole + gap, "f string, p int, ts timestamp_ntz")
    assert {r.f: (r.exact, r.first_wrong) for r in Q.exact_hours(df, "f").collect()} == {"a": (True, None), "b": (False, 100)}
    odd = spark.createDataFrame([("c", 0, start), ("c", 1, start), ("c", 2, None), ("c", 3, start - dt.timedelta(hours=1))], "f string, p int, ts timestamp_ntz")
    assert [tuple(r) for r in Q.series_faults(odd, "f", "p", "ts").collect()] == [("c", 4, 1, 1, 0)]
    with pytest.raises(ValueError, match="after the end year"):
        Q.check_run(2001, 2000)
    with pytest.raises(ValueError, match="chunks"):
        Q.check_run(2000, 2001, chunk_hours=0)


def test_grids_are_compared_place_by_place(spark):
    grids = {1: [0.0, 0.25, 0.5], 2: [0.5, 0.25, 0.0], 3: [0.0, 0.25, 0.5], 4: [0.0, 0.25], 5: [0.0, 0.25, 0.5, 0.5]}
    df = spark.createDataFrame([(f, i, x) for f, xs in grids.items() for i, x in enumerate(xs)], "f int, i int, x double")
    assert {r.f: r.same_as_reference for r in Q.grids_that_differ(df, "f", "i", "x").collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_a_failed_year_does_not_stop_the_run(spark):
    def work(year):
        if year == 2001:
            raise ValueError("bad " + "x" * 3000)
        return spark.range(year - 1999)

    done, log = R.years_one_by_one(spark, 2000, 2002, work)
    assert [d.count() for d in done] == [1, 3]
    assert [(r.year, r.rows, r.error and len(r.error)) for r in log.collect()] == [(2000, 1, None), (2001, 0, 2000), (2002, 3, None)]
    assert tuple(R.run_summary(log).first()) == (3, 2, 1, 4)


def test_yearly_files_are_combined_in_order_and_never_written_over(spark, tmp_path):
    df = spark.createDataFrame([(2001, 3, None), (2000, 2, 1.5), (2000, 1, 2.5)], "year int, k int, x double")
    S.write_csv(df, f"file://{tmp_path}/years", ["k"], by="year")
    assert sorted(p.name for p in (tmp_path / "years").glob("_by=*")) == ["_by=2000", "_by=2001"]
    found = S.combine_csv(df, f"file://{tmp_path}/years", f"file://{tmp_path}/all", ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(2000, 1, 2.5), (2000, 2, 1.5), (2001, 3, None)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_csv(df, f"file://{tmp_path}/all", ["k"])


def test_streams_of_several_batches(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events = lambda day, hours: spark.createDataFrame([(1, dt.datetime(2024, 1, day, h), float(h)) for h in hours], "user_id long, ts timestamp_ntz, value double")
    events(1, range(0, 20)).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: logs.daily_by_event_time(spark.readStream.schema(events(1, [0]).schema).parquet(folder), "user_id", "ts", "value")
    assert logs.drained(stream(), out=out).collect() == []
    events(2, range(0, 5)).coalesce(1).write.mode("append").parquet(folder)
    closed = logs.drained(stream(), out=out)
    assert [(r.day, r.x_min, r.x_max) for r in closed.collect()] == [(dt.date(2024, 1, 1), 0.0, 19.0)]
    # a row of the first day that comes now is too late, and no day is told twice
    events(1, [23]).coalesce(1).write.mode("append").parquet(folder)
    events(3, [9]).coalesce(1).write.mode("append").parquet(folder)
    assert sorted((r.day.day, r.x_max) for r in logs.drained(stream(), out=out).collect()) == [(1, 19.0), (2, 4.0)]


def test_progress_is_told_by_batch(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    told = logs.progress(spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out")
    assert sum(t["rows"] for t in told) == 7
