"""Session defaults of the jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; number and size of shuffle partitions are left to AQE and to the cluster."""
    builder = SparkSession.builder.appName("ledgerloom").config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
