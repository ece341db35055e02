"""Files as rows: discovery, inventory, archives with one member."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length of the files below a folder whose names match. Contents are not read; an empty folder is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    if found.isEmpty():
        raise ValueError(f"no files like {pattern} below {folder}")
    return found


def inventory(rows: DataFrame, ts: str) -> DataFrame:
    """path, length, n_times, first_ts, last_ts of each file that rows are read from; first and last by place in the file, not by value."""
    place = F.col("_metadata.row_index")
    told = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), place.alias("place"), F.col(ts).alias("ts"))
    return told.groupBy("path").agg(F.max("length").alias("length"), F.count("ts").alias("n_times"), F.min_by("ts", "place").alias("first_ts"), F.max_by("ts", "place").alias("last_ts"))


def is_usable(least_bytes: int = 1024, least_times: int = 1) -> Column:
    """Whether a file of the inventory is there (has a length), is large enough and has so many times."""
    return F.coalesce((F.col("length") >= least_bytes) & (F.col("n_times") >= least_times), F.lit(False))


def single_members(archives: DataFrame, suffix: str = ".nc") -> DataFrame:
    """path, member, content of ZIP archives (path, content), of which each must have exactly one member with the suffix, in any case."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(suffix)]
                    if len(names) != 1:
                        raise ValueError(f"{path} has {len(names)} members like *{suffix}")
                    out.append((path, names[0], archive.read(names[0])))
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    return archives.select("path", "content").mapInPandas(extract, "path string, member string, content binary")


def years_of_files(rows: DataFrame, file: str, ts: str, start_year: int, end_year: int) -> DataFrame:
    """file, year: the years, within bounds, that a file has times of. Bounds are stated on the time itself, so that the scan can use them."""
    low, high = (F.lit(f"{y:04d}-01-01").cast("timestamp_ntz") for y in (start_year, end_year + 1))
    return rows.where((F.col(ts) >= low) & (F.col(ts) < high)).select(F.col(file).alias("file"), F.year(ts).alias("year")).distinct()


def files_by_year(index: DataFrame) -> DataFrame:
    """year, n_files for each year from the one before the first to the one after the last, those without files too."""
    found = index.groupBy("year").agg(F.countDistinct("file").alias("n_files"))
    years = found.agg((F.min("year") - 1).alias("a"), (F.max("year") + 1).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(found, "year", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def first_valid(files: DataFrame, valid: str, order: str) -> DataFrame:
    """The first file in order that is valid."""
    return files.where(F.col(valid)).orderBy(order).limit(1)


def in_year(rows: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows of one calendar year, as a range of the time, which reaches the scan."""
    low, high = (F.lit(f"{y:04d}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    return rows.where((F.col(ts) >= low) & (F.col(ts) < high))


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with their number, from 1, within a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
