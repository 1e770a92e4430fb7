"""Continuous ingestion as Structured Streaming, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest_stream(spark: SparkSession, source: str, log: str, schema: str, *, state: str) -> None:
    """Appends all rows that arrived below ``source`` since the last call to the change log at ``log``, an ordinary Parquet table.

    The file sink commits each micro-batch once, so a batch repeated after a failure adds nothing. ``state`` is the stream's checkpoint folder.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def newest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The table that a change log gives: of the rows of a key the last by ``order``; a later row of the same order wins by its content, so the result is one and the same at every run."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*log.columns)))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def windowed_counts(events: DataFrame, *, time: str, by: str, value: str, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Counts and sums by tumbling windows, for streams (with a watermark ``delay``) and tables alike."""
    e = events.withWatermark(time, delay) if delay else events
    w = e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "total")
