"""Streams of facts and events: an extension, as the batch jobs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under ``path`` (a file or a folder) as a stream with the schema that they have now.

    All files there are one micro-batch: with several, the newest event of one would make older ones of the next late.
    """
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + f"[{path[-1]}]"  # a pattern may name a single file, a plain path may not
    return spark.readStream.schema(schema).parquet(glob)


def windowed(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; windows close once the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))


def new_facts(facts: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Facts whose key has not come within the watermark."""
    return facts.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what the stream has now to ``path``; with the same checkpoint a later call goes on from there."""
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
