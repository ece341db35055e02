"""Weighted statistics: mean, extremes, inverse-distribution quantiles, valid share of the area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import is_finite

QUANTILES = {"p25": 0.25, "p75": 0.75}
#: Distinct values of a group up to which they are held in one array.
MOST_VALUES = 10_000
STATISTICS = ("mean", "max", "min", "p25", "p75", "valid_area_fraction")


def valid(x: str, w: str) -> Column:
    return is_finite(F.col(x)) & is_finite(F.col(w)) & (F.col(w) > 0)


def mean(x: str, w: str) -> Column:
    ok = valid(x, w)
    return F.sum(F.when(ok, F.col(x) * F.col(w))) / F.sum(F.when(ok, F.col(w)))


def valid_share(x: str, w: str) -> Column:
    """Weight of the valid values over that of all positive finite weights; 0 where there is none."""
    positive = F.sum(F.when(is_finite(F.col(w)) & (F.col(w) > 0), F.col(w)))
    return F.coalesce(F.sum(F.when(valid(x, w), F.col(w))) / positive, F.lit(0.0))


def statistics(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """keys and the six statistics of x with weights w. The smallest value at which the running weight reaches a share is that quantile;
    ties run together, so their order does not matter. One shuffle serves the window and the aggregate."""
    ok = valid(x, w)
    prepared = df.select(*keys, x, w, F.when(ok, F.col(w)).alias("_w"), F.when(ok, F.col(x)).alias("_x"))
    by = Window.partitionBy(*keys)
    running = F.sum("_w").over(by.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = prepared.withColumn("_share", running / F.sum("_w").over(by))
    quantile = {name: F.min(F.when(F.col("_share") >= p, F.col("_x"))) for name, p in QUANTILES.items()}
    told = [mean(x, w).alias("mean"), F.max("_x").alias("max"), F.min("_x").alias("min"), *[c.alias(n) for n, c in quantile.items()]]
    return ranked.groupBy(*keys).agg(*told, valid_share(x, w).alias("valid_area_fraction"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("valid_weight"))


def quantiles_by_array(df: DataFrame, keys: list[str], x: str, w: str, most: int = MOST_VALUES) -> DataFrame:
    """The quantiles without a window: each group's distinct values with their summed weights in one array. Groups of more distinct values
    than most go to the window form, which can spill."""
    values = df.where(valid(x, w)).groupBy(*keys, x).agg(F.sum(w).alias(w))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    large = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    listed = values.join(large, same, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(w).alias("w")))).alias("v"), F.sum(w).alias("total"))

    def pick(p: float) -> Column:
        start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("found"))
        step = lambda a, v: F.struct((a["run"] + v["w"]).alias("run"), F.when(a["found"].isNull() & ((a["run"] + v["w"]) / F.col("total") >= p), v["x"]).otherwise(a["found"]).alias("found"))
        return F.aggregate("v", start, step)["found"]

    by_window = statistics(values.join(large, same, "left_semi"), keys, x, w).select(*keys, *QUANTILES)
    return listed.select(*keys, *[pick(p).alias(n) for n, p in QUANTILES.items()]).unionByName(by_window)


def statistics_of_many(df: DataFrame, keys: list[str], variables: list[str], w: str, told: tuple[str, ...] = STATISTICS) -> DataFrame:
    """The statistics of several variables: one long form, one window pass, one pivot. Columns are variable_statistic."""
    pairs = ", ".join(f"'{v}', CAST({v} AS DOUBLE)" for v in variables)
    long = df.select(*keys, w, F.expr(f"stack({len(variables)}, {pairs}) AS (variable, x)"))
    found = statistics(long, [*keys, "variable"], "x", w)
    wide = [F.max(F.when(F.col("variable") == v, F.col(s))).alias(f"{v}_{s}") for v in variables for s in told]
    return found.groupBy(*keys).agg(*wide)


def extremes(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """keys, max, min of the values that are valid with their weights."""
    ok = F.when(valid(x, w), F.col(x))
    return df.groupBy(*keys).agg(F.max(ok).alias("max"), F.min(ok).alias("min"))


def coverage(weights: DataFrame, totals: DataFrame) -> DataFrame:
    """city_id, grid_overlap_count, grid_coverage_fraction of every city in totals (city_id, city_area), cells or not."""
    used = weights.where(F.col("area") > 0).groupBy("city_id").agg(F.count("*").alias("n"), F.sum("area").alias("held"))
    return totals.join(used, "city_id", "left").select("city_id", F.coalesce("n", F.lit(0)).alias("grid_overlap_count"), F.coalesce(F.col("held") / F.col("city_area"), F.lit(0.0)).alias("grid_coverage_fraction"))


def city_daily(daily: DataFrame, days: DataFrame, weights: DataFrame, cities: DataFrame, variables: list[str]) -> DataFrame:
    """The city-day output: date_utc, city_id, city_name, grid_overlap_count, grid_coverage_fraction and six statistics of each variable.

    daily has cell_id, day and the variables, days the calendar, weights city_id, cell_id, area, cities city_id, city_name, city_area. Every city
    has a row for every day, those without valid cells too: nulls and a valid share of 0. The share of valid area is that of the cells' area,
    whether a cell has rows on that day or not. One join with the weights, one window pass; days times cities are the only rows made up.
    """
    positive = weights.where(is_finite(F.col("area")) & (F.col("area") > 0))
    used = positive.groupBy("city_id").agg(F.count("*").alias("n"), F.sum("area").alias("held"))
    told = cities.join(used, "city_id", "left")
    found = statistics_of_many(daily.join(positive, "cell_id"), ["day", "city_id"], variables, "area", (*STATISTICS[:-1], "valid_weight"))
    # a calendar: a century has 36,525 days
    every = told.join(F.broadcast(days), how="cross").join(found, ["day", "city_id"], "left")
    share = lambda v: F.coalesce(F.col(f"{v}_valid_weight") / F.col("held"), F.lit(0.0)).alias(f"{v}_valid_area_fraction")
    return every.select(
        F.col("day").alias("date_utc"),
        "city_id",
        "city_name",
        F.coalesce("n", F.lit(0)).alias("grid_overlap_count"),
        F.coalesce(F.col("held") / F.col("city_area"), F.lit(0.0)).alias("grid_coverage_fraction"),
        *[c for v in variables for c in (*[F.col(f"{v}_{s}") for s in STATISTICS[:-1]], share(v))],
    )
