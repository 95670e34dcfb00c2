"""Jobs on streams: current facts with corrections, and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.jobs.facts import CURRENT
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import facts, shared_folder
from ledgerloom.streaming import current, windows


@query("W1 W3 §2.19", CURRENT)
def current_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current facts after three filings, which come as a stream."""
    root = shared_folder(spark, "fact-stream")
    rows = facts(spark, sf_dir).select("seq", *current.KEY, "column_header", "value_raw")
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).write.mode("append").parquet(f"{root}/facts")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/facts")
        current.follow(stream, f"{root}/out", f"{root}/state")
    return current.view(spark, f"{root}/out", current.corrections(rows).schema)


@query("§2.19", """
WITH m AS (SELECT max(ts) AS m FROM events), g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS first, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", n FROM r, m WHERE b <= m - INTERVAL 2 HOUR""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of users in a stream over the events."""
    base = shared_folder(spark, "sessions")
    events = windows.stream_files(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = windows.run_once(current.sessions(events, "ts", "user_id"), f"{base}/out", f"{base}/state")
    return closed.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "end")], "n")
