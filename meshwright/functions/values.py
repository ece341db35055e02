"""Column helpers for missing values, units and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_CELSIUS = 273.15
#: How units are spelled.
KELVIN = ("k", "kelvin", "degrees_kelvin", "degree_kelvin")
CELSIUS = ("degc", "c", "celsius", "degree_celsius", "degrees_celsius")


def is_finite(x: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def missing_to_null(x: Column) -> Column:
    """Null for NaN and null alike."""
    return F.when(~F.isnan(x), x)


def date_of(stamp: Column) -> Column:
    """The date that a time stamp's text begins with; null if it is none."""
    return F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")


def shortened(message: Column, most: int = 2000) -> Column:
    return F.substring(message, 1, most)


def to_celsius(x: Column, unit: Column) -> Column:
    """Kelvin or Celsius to Celsius; any other unit is an error."""
    name = F.lower(F.trim(unit))
    return F.when(name.isin(*KELVIN), x - ZERO_CELSIUS).when(name.isin(*CELSIUS), x).otherwise(F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null")))).cast("double"))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def hours_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) * 24
