"""Structured Streaming forms of batch operators. Batch results define what is right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.readers import table
from tablewright.sources.scratch import new_place


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names."""
    return new_place(spark, "stream")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of the files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(stream: DataFrame, mode: str = "complete", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a query over what is there and read its result: the last state (complete) or all rows given (append, update).

    Every batch is written under its number, so a batch that is run again replaces itself.
    """
    spark, place = stream.sparkSession, work_dir(stream.sparkSession)
    ran: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{place}/out/{number}")
        ran.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{place}/state")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    if not ran:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{place}/out/{max(ran)}" if mode == "complete" else f"{place}/out/*")


def with_event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their values by window and type."""
    frame = F.window("ts", width, slide or width)
    out = events.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """State by key: how many and how much so far."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key: runs of events with less than `gap` between neighbours. Batch, or a stream in append mode."""
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
