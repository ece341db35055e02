"""City-day statistics from whole days: a day's cells are one frame of arrays, the weights a compressed sparse matrix, and a city's values are gathered by index.

The field is dealt by day once, hour by hour; daily values, frames and statistics then follow within that partitioning, so rows of day and cell are never shuffled.
A frame is as large as the grid. The weights go to every task if they have at most MOST_WEIGHTS entries (32 MB); beyond that, weighted.city_daily() joins them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from ..functions.values import is_finite
from . import resample as R
from . import weighted as W

MOST_WEIGHTS, MOST_CITIES = 2_000_000, 100_000


class Sparse(NamedTuple):
    """cities and, by city, where its entries begin and end in places and areas; places count the cells that any city has, which are sorted."""

    cities: pa.Table
    starts: np.ndarray
    places: np.ndarray
    areas: np.ndarray
    cells: np.ndarray


def sparse(weights: DataFrame, cities: DataFrame, most_weights: int = MOST_WEIGHTS, most_cities: int = MOST_CITIES) -> Sparse | None:
    """The weights (city_id, cell_id, area; positive and finite ones) of cities (city_id, city_name, city_area), unless they are too many."""
    used = weights.where(is_finite(F.col("area")) & (F.col("area") > 0))
    if used.limit(most_weights + 1).count() > most_weights or cities.limit(most_cities + 1).count() > most_cities:
        return None
    told = cities.select("city_id", "city_name", F.col("city_area").cast("double")).toArrow().sort_by("city_id")
    entries = used.select("city_id", F.col("cell_id").cast("long").alias("cell_id"), F.col("area").cast("double").alias("area")).join(F.broadcast(cities.select("city_id")), "city_id").toArrow().sort_by([("city_id", "ascending"), ("cell_id", "ascending")])
    cells, places = np.unique(entries["cell_id"].to_numpy(), return_inverse=True)
    starts = np.searchsorted(entries["city_id"].to_numpy(), told["city_id"].to_numpy())
    return Sparse(told, np.r_[starts, len(places)], places, entries["area"].to_numpy(), cells)


def by_city(values: np.ndarray, matrix: Sparse) -> dict[str, np.ndarray]:
    """The statistics of each city over one frame: NaN where no cell of it has a value."""
    n = len(matrix.starts) - 1
    city = np.repeat(np.arange(n), np.diff(matrix.starts))
    held = values[matrix.places]
    ok = np.isfinite(held)
    city, held, area = city[ok], held[ok], matrix.areas[ok]
    weight = np.bincount(city, area, n)
    out = {k: np.full(n, np.nan) for k in W.STATISTICS}
    with np.errstate(invalid="ignore", divide="ignore"):
        out["mean"] = np.bincount(city, held * area, n) / weight
        order = np.lexsort((held, city))
        city, held, area = city[order], held[order], area[order]
        some, first = np.unique(city, return_index=True)
        last = np.r_[first[1:], len(city)] - 1
        if len(some):
            out["min"][some], out["max"][some] = held[first], held[last]
            run = np.cumsum(area)
            share = (run - np.repeat(run[first] - area[first], last - first + 1)) / weight[city]
            share[last] = 1.0
            for name, p in W.QUANTILES.items():
                reached = np.flatnonzero(share >= p)
                owners, at = np.unique(city[reached], return_index=True)
                out[name][owners] = held[reached[at]]
        total = np.bincount(np.repeat(np.arange(n), np.diff(matrix.starts)), matrix.areas, n)
        out["valid_area_fraction"] = np.where(weight > 0, weight / total, 0.0)
    return out


def city_daily(field: DataFrame, weights: DataFrame, cities: DataFrame, strict: bool = True, hours: int | None = None, places: int | None = None, most_weights: int = MOST_WEIGHTS) -> DataFrame:
    """What weighted.city_daily() gives for the daily minimum, maximum and mean (rounded, if places says so) of field (cell_id, ts, x): every city on every day from the first
    to the last."""
    mean = (lambda d: d.withColumn("x_mean", F.round("x_mean", places))) if places is not None else (lambda d: d)
    matrix = sparse(weights, cities, most_weights)
    variables = ["x_min", "x_max", "x_mean"]
    if matrix is None:
        return W.city_daily(mean(R.daily(field, strict, hours)), R.calendar(field), weights, cities, variables)
    dealt = field.withColumn("day", F.col("ts").cast("date")).repartition("day")
    daily = mean(dealt.groupBy("cell_id", "day").agg(*R.extremes_and_mean(F.col("x"), strict, hours)))
    plain = [StructField("date_utc", DateType()), *[cities.schema[c] for c in ("city_id", "city_name")], StructField("grid_overlap_count", LongType()), StructField("grid_coverage_fraction", DoubleType())]
    schema = StructType([*plain, *[StructField(f"{v}_{s}", DoubleType()) for v in variables for s in W.STATISTICS]])
    arrow = to_arrow_schema(schema)
    shared = field.sparkSession.sparkContext.broadcast(matrix)

    def rows(day, frame: pa.Table | None) -> pa.Table:
        matrix = shared.value
        n = matrix.cities.num_rows
        counts = np.diff(matrix.starts)
        held = np.bincount(np.repeat(np.arange(n), counts), matrix.areas, n)
        area = matrix.cities["city_area"].to_numpy()
        covered = np.where(np.isfinite(area) & (counts > 0), held / np.where(np.isfinite(area), area, 1.0), 0.0)
        columns = [pa.array([day] * n, pa.date32()), matrix.cities["city_id"], matrix.cities["city_name"], pa.array(counts), pa.array(covered)]
        for v in variables:
            values = np.full(len(matrix.cells) + 1, np.nan)
            if frame is not None and len(matrix.cells):
                ids = frame["cell_id"].to_numpy()
                at = np.minimum(np.searchsorted(matrix.cells, ids), len(matrix.cells) - 1)
                known = matrix.cells[at] == ids
                values[at[known]] = frame[v].to_numpy(zero_copy_only=False)[known]
            found = by_city(values, matrix)
            columns += [pa.array(found[s], from_pandas=True) for s in W.STATISTICS]
        return pa.table(columns, names=arrow.names).cast(arrow)

    made = daily.where("cell_id IS NOT NULL AND day IS NOT NULL").select("day", F.col("cell_id").cast("long").alias("cell_id"), *variables).groupBy("day").applyInArrow(lambda key, frame: rows(key[0].as_py(), frame), schema)
    # days within the span that no row has; a calendar is bounded by its years
    lacking = R.calendar(field).join(field.select(F.col("ts").cast("date").alias("day")).distinct(), "day", "left_anti")
    bare = lacking.groupBy("day").applyInArrow(lambda key, _: rows(key[0].as_py(), None), schema)
    return made.unionByName(bare)
