"""Streams: the resumable append as a stateful dedup, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files below a folder as they come."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def first_arrivals(rows: DataFrame, by: list[str], text: str = "text", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose digest is new within ``by``; with an event time, state older than ``delay`` is dropped."""
    keyed = rows.withColumn("digest", F.sha2(F.col(text).cast("string"), 256))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*by, "digest"])
    return keyed.dropDuplicates([*by, "digest"])


def windowed_counts(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling or sliding windows, late events up to ``delay``."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    grouped = marked.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def session_counts(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions that a pause of ``gap`` ends."""
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), *by, "n")


def until_quota(rows: DataFrame, sink: Callable[[DataFrame, int], int], quota: int, checkpoint: str):
    """Feed batches to ``sink``, which gives the rows it has in all; the query stops once that reaches ``quota``."""
    query = None

    def batch(df: DataFrame, number: int) -> None:
        if sink(df, number) >= quota and query is not None:
            query.stop()

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    return query
