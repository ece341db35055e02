"""City days from frames against the join of days and weights."""

import datetime as dt
import math
import random

import pytest

from meshwright.operators import frames as FR
from meshwright.operators import resample as R
from meshwright.operators import weighted as W

NAMES = ["x_min", "x_max", "x_mean"]


def tables(spark):
    r = random.Random(4)
    hours = [(c, dt.datetime(2020, 1, d, h), r.choice([1.5, 2.0, -3.0, 7.25, float("nan") if c % 5 == 0 and d == 2 else 4.0])) for c in range(30) for d in (1, 2, 5) for h in range(0, 24, 6) if c != 7 or h]
    field = spark.createDataFrame(hours, "cell_id long, ts timestamp_ntz, x double")
    weights = spark.createDataFrame([(c % 4, c, r.choice([1.0, 2.5, 0.0, -1.0, float("nan")])) for c in range(40)] + [(9, 1, 3.0)], "city_id int, cell_id long, area double")
    cities = spark.createDataFrame([(0, "a", 100.0), (1, "b", None), (2, "c", 50.0), (3, "d", 70.0), (5, "no cells", 10.0)], "city_id int, city_name string, city_area double")
    return field, weights, cities


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize(("strict", "hours", "most"), [(True, None, 10), (False, None, 2_000_000), (True, 4, 2_000_000)])
def test_frames_equal_the_join(spark, strict, hours, most):
    field, weights, cities = tables(spark)
    got = {(r.date_utc, r.city_id): r.asDict() for r in FR.city_daily(field, weights, cities, strict, hours, most_weights=most).collect()}
    want = {(r.date_utc, r.city_id): r.asDict() for r in W.city_daily(R.daily(field, strict, hours), R.calendar(field), weights, cities, NAMES).collect()}
    assert got.keys() == want.keys() and len(got) == 25
    for key, row in want.items():
        assert all(same(got[key][c], v) for c, v in row.items()), (key, got[key], row)


def test_rows_of_day_and_cell_are_not_shuffled(spark):
    field, weights, cities = tables(spark)
    found = FR.city_daily(field, weights, cities)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    executed = found._jdf.queryExecution().executedPlan().toString()
    made = executed.split("Union")[1].split("FlatMapGroupsInArrow")[1]
    # below the frames one exchange, of the hours by day
    assert made.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(day" in made and "Join" not in made, plan


def test_an_empty_field_and_no_cities(spark):
    field, weights, cities = tables(spark)
    assert FR.city_daily(field.limit(0), weights, cities).collect() == []
    assert FR.city_daily(field, weights, cities.limit(0)).collect() == []
    assert FR.city_daily(field, weights.limit(0), cities).where("x_mean_valid_area_fraction = 0").count() == 25
