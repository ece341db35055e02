"""Tables in their roles, and the folder that tasks share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-meshwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/meshwright/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads survive a lost executor and start from these files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ensure_columns(df: DataFrame, *required: str) -> DataFrame:
    """df, if it has the columns; else an error that names the missing ones."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly values: cell_id, ts, x."""
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), "ts", F.col("value").alias("x"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells' areas by region: city_id, cell_id, area (which may be zero or less)."""
    return read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city_id"), F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("area"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"))


def log_lines(events: DataFrame) -> DataFrame:
    """day (the log file), n (the line's number), line."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(F.col("ts").cast("date").alias("day"), F.col("event_id").alias("n"), F.concat(stamp, F.lit(" "), "event_type", F.lit(": "), F.col("event_id").cast("string")).alias("line"))
