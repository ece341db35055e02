"""Where queries are registered, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a function under its name, with its SQL. Date columns are given as text (yyyy-MM-dd), which every engine prints alike."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql:
            texts = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
