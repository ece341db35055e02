"""Log alerts and daily statistics, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.running import ordinals
from ..sources.tables import log_lines, shared_path

#: What makes a line an alert.
ALERT = r"(?i)(^|\s)(ERROR|CRITICAL)(\s|:)|Traceback \(most recent call last\)|[A-Za-z]+Error:"

#: Lines that are looked at together; around must not be larger.
BLOCK_LINES = 4096


def alerts(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(ALERT))


def alerts_with_context(lines: DataFrame, around: int = 4, log: str = "day", block: int = BLOCK_LINES) -> DataFrame:
    """Lines of each log that are within so many lines of an alert; is_alert marks the alerts. Lines are numbered by ranges, not log by log, and looked at in blocks of
    numbers to which the lines next to them are lent, so a long log is no single task and nothing is joined back."""
    placed = ordinals(lines, [log, "n"], "_at").withColumn("is_alert", F.col("line").rlike(ALERT))
    number = lambda shift: F.floor((F.col("_at") + shift) / block)
    lent = placed.withColumn("_block", F.explode(F.array_distinct(F.array(*[number(k) for k in (-around, 0, around)]))))
    window = Window.partitionBy(log, "_block").orderBy("_at").rangeBetween(-around, around)
    return lent.withColumn("_near", F.max("is_alert").over(window)).where((F.col("_block") == number(0)) & F.col("_near")).drop("_at", "_block", "_near")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, whether the table is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def drained(stream: DataFrame, act: Callable[[DataFrame], DataFrame] | None = None, out: str | None = None) -> DataFrame:
    """Run a stream in append mode over what is there; its rows, through act batch by batch, from written tables. A batch writes over its own folder only,
    so one that is run again after a failure doubles nothing."""
    spark = stream.sparkSession
    out = out or shared_path(spark, "stream")
    shaped = act or (lambda batch: batch)
    write = lambda batch, k: shaped(batch).write.mode("overwrite").parquet(f"{out}/batch={k}")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    none = shaped(spark.createDataFrame([], stream.schema))
    try:
        return spark.read.schema(none.schema).parquet(f"{out}/batch=*")
    except AnalysisException as error:
        # no batch has run: the stream has had no rows yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return none


def progress(stream: DataFrame, out: str) -> list[dict]:
    """Rows read by each batch of a run over what is there, as the engine tells them."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


def daily_by_event_time(events: DataFrame, key: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """key, day, x_min, x_max, x_mean of a stream. Rows that come later than `late` are dropped, and a day leaves the state when it is past that."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    by_day = timed.withWatermark("_t", late).groupBy(F.col(key).alias("cell_id"), F.window("_t", "1 day").alias("_w"))
    found = by_day.agg(F.min(value).alias("x_min"), F.max(value).alias("x_max"), F.avg(value).alias("x_mean"))
    return found.select("cell_id", F.col("_w.start").cast("date").alias("day"), "x_min", "x_max", "x_mean")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that are closed: those that end before the last time less two hours."""
    return drained(daily_by_event_time(event_stream(spark, sf_dir), "user_id", "ts", "value"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(alerts(log_lines(event_stream(spark, sf_dir))))


def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the lines about them, batch by batch: context does not reach into another batch."""
    return drained(log_lines(event_stream(spark, sf_dir)), alerts_with_context)
