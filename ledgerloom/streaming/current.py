"""The current view of facts as a stream: the best fact of each key, and its corrections as filings come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import periods

KEY = ("company", "item_name", "period")


def preference() -> Column:
    """What ``facts.current_view`` orders by, smaller is better: durations, the latest year in the header, then disclosure."""
    h = F.col("column_header")
    instant = F.when(h.contains("至") | h.contains("To"), 0).otherwise(1)
    return F.struct(instant.alias("instant"), (-F.coalesce(periods.header_year(h), F.lit(0))).alias("year"), F.col("seq").alias("seq"))


def corrections(facts: DataFrame, values: Sequence[str] = ("value_raw",)) -> DataFrame:
    """A streaming aggregation in update mode: for each key that a batch touches, its best fact so far.

    State is one row per key and never expires, as a filing may correct any period; rows are cut to the best of each key in
    every task before they are shuffled, so a key of any number of rows is no hot key.
    """
    best = F.min(F.struct(preference().alias("rank"), *values))
    return facts.groupBy(*KEY).agg(best.alias("best"))


def follow(facts: DataFrame, out: str, checkpoint: str, values: Sequence[str] = ("value_raw",)) -> None:
    """Run the stream to its present end; every batch writes the keys that it touched to a folder of its own under
    ``out``. A batch that is run again replaces itself, and a later call with the same checkpoint goes on from there."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = corrections(facts, values).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()


def view(spark, out: str, schema, values: Sequence[str] = ("value_raw",)) -> DataFrame:
    """The current facts from all corrections: a key's best only gets better, so the last is the least."""
    rows = spark.read.schema(schema).parquet(out)
    last = rows.groupBy(*KEY).agg(F.min("best").alias("best"))
    return last.select(F.col("best.rank.seq").alias("seq"), *KEY, *[F.col(f"best.{v}").alias(v) for v in values])


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: runs of events with less than ``gap`` between neighbours; they close once the watermark passes."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")
