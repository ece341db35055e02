"""Bringing series to one form: names, variable, dimensions, types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ensure_columns

#: Other names of coordinates, first come first.
ALIASES = {"time": ("time", "valid_time"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon")}


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with each coordinate under its own name: the first alias that is a column is renamed, unless the name is there."""
    for name, others in (aliases or ALIASES).items():
        have = next((c for c in others if c in df.columns), None)
        if have and name not in df.columns:
            df = df.withColumnRenamed(have, name)
    return df


def with_variable(df: DataFrame, *names: str) -> DataFrame:
    """df with the first of the variables that it has as x; an error that lists what there is, if none."""
    have = next((n for n in names if n in df.columns), None)
    if have is None:
        raise ValueError(f"none of {', '.join(names)}; there are {', '.join(df.columns)}")
    return df.withColumnRenamed(have, "x")


def without_single(df: DataFrame, *extra: str) -> DataFrame:
    """df without its further dimensions, each of which must have one value at most."""
    if extra:
        many = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in extra]).first()
        if wide := [c for c in extra if not many[c]]:
            raise ValueError(f"more than one value of {', '.join(wide)}")
    return df.drop(*extra)


def normalised(df: DataFrame, *variables: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """time, latitude, longitude, x (a double with its meaning as metadata) of a series under any of its names."""
    named = ensure_columns(with_variable(renamed(df, aliases), *variables), "time", "latitude", "longitude", "x")
    single = without_single(named, *[c for c in named.columns if c not in ("time", "latitude", "longitude", "x")])
    about = {"long_name": variables[0], "missing_values": "null, and NaN on reading"}
    return single.select(F.col("time").cast("timestamp_ntz").alias("time"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), F.col("x").cast("double").alias("x", metadata=about))
