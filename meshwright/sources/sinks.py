"""Written forms: CSV with a byte-order mark, by year and combined; JSON reports; profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "﻿"


def as_text(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("nan")) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, by: str | None = None) -> None:
    """CSV with a byte-order mark on the first column's name, CRLF line ends and nan for missing numbers: one folder, as many files as partitions,
    or, with `by`, one folder for each of its values. Rows of a file are in order, if one is given. What is there is never written over."""
    first, *rest = df.columns
    text = df.select(as_text(df)[0].alias(MARK + first), *[c.alias(n) for c, n in zip(as_text(df)[1:], rest)], *([F.col(by).alias("_by")] if by else []), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order or [])])
    keys = [f"_order{i}" for i in range(len(order or []))]
    if by:
        text = text.repartitionByRange("_by", *keys)
    if by or order:
        text = text.sortWithinPartitions(*(["_by"] if by else []), *keys)
    writer = text.drop(*keys).write.mode("errorifexists").option("header", True).option("lineSep", "\r\n")
    (writer.partitionBy("_by") if by else writer).csv(path)


def read_csv(like: DataFrame, path: str) -> DataFrame:
    """The rows of such a folder, or of the folders of all years, with the columns and types of like. Each file's mark and header are left out."""
    raw = like.sparkSession.read.option("header", True).option("lineSep", "\r\n").option("recursiveFileLookup", True).schema(", ".join(f"`{c}` string" for c in like.columns)).csv(path)
    return raw.select(*[(F.when(F.col(c) != "nan", F.col(c)).cast(t) if t in ("double", "float") else F.col(c).cast(t)).alias(c) for c, t in like.dtypes])


def combine_csv(like: DataFrame, years: str, path: str, order: list[str]) -> DataFrame:
    """The yearly folders below `years` as one folder at path, its files following each other in order; an error if there are no years."""
    whole = read_csv(like, years)
    if whole.isEmpty():
        raise ValueError(f"no yearly files below {years}")
    write_csv(whole.repartitionByRange(*order), path, order)
    return read_csv(like, path)


def profile(df: DataFrame) -> DataFrame:
    """column, n, n_distinct, least, greatest of each column, in one pass."""
    packed = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.countDistinct(c).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in df.columns]
    return df.agg(F.array(*packed).alias("all")).select(F.explode("all").alias("p")).select("p.*")


def inspect(df: DataFrame) -> DataFrame:
    """column, kind (number, time, text, other), n, n_null, least and greatest as number or as text, mean of every column: one pass with partial sums, nothing is dealt out."""

    def told(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        kind = "number" if dtype.startswith("decimal") or dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") else "time" if dtype in ("date", "timestamp", "timestamp_ntz") else "text" if dtype == "string" else "other"
        number = c.cast("double") if kind == "number" else F.lit(None).cast("double")
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind == "time" else c if kind == "text" else F.lit(None).cast("string")
        parts = {"column": F.lit(name), "kind": F.lit(kind), "n": F.count(c), "n_null": F.count_if(c.isNull()), "least_number": F.min(number), "greatest_number": F.max(number), "mean": F.avg(number), "least_text": F.min(text), "greatest_text": F.max(text)}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    return df.agg(F.array(*[told(*x) for x in df.dtypes]).alias("all")).select(F.explode("all").alias("p")).select("p.*")


def json_report(df: DataFrame, **counts) -> DataFrame:
    """One row: a JSON document of aggregates."""
    return df.agg(F.to_json(F.struct(*[c.alias(n) for n, c in counts.items()])).alias("report"))
