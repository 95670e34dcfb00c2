"""The order in which rows were filed, over any number of files and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tables of more files than this are joined with their files' numbers by a shuffle, not by a broadcast (some 20 MB).
BROADCAST_FILES = 100_000


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, read from Parquet files, with the number of each row from 0 as ``name``.

    Files stand by the time of their writing, then by path, rows by their place in the file: a total order, in which an
    append comes after what was there. Numbers have no gaps, so that a long holds them for any table. The rows of each
    file are counted without reading a column; the running sum has one row per file.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    n_files = len(rows.inputFiles())
    if n_files <= 1:
        return placed.withColumnRenamed("_at", name).drop("_file")
    files = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.row_index").alias("_at"))
    files = files.groupBy("_file", "_time").agg((F.max("_at") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_time", "_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = placed.join(F.broadcast(files) if n_files <= BROADCAST_FILES else files, "_file")
    return placed.withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")
