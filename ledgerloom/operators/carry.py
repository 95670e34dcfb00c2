"""Carry-forward over long documents: a segmented prefix scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import kept


def carried(rows: DataFrame, document: str, place: str, columns: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``columns``, a struct (at, value) of the last value that is not null at or above the
    row, and the place where it stands; null if there is none. Rows of one document stand by ``place``.

    Rows are dealt by ranges of (document, place), so a document of any length is spread over tasks. Each range's last
    values make a small table of one row per document and range; a scan of that table gives every range what stands above
    it, and the join back fills the rows that find nothing in their own range. ``ranges``, by default as many as shuffle
    partitions, changes nothing in the result.
    """
    values = {f"_v{i}": c for i, c in enumerate(columns.values())}
    dealt = rows.withColumns(values)
    dealt = dealt.repartitionByRange(*([ranges] if ranges else []), F.asc_nulls_first(document), F.asc_nulls_first(place))
    dealt = kept(dealt.withColumn("_range", F.spark_partition_id()), "carry-rows")
    event = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(place).alias("at"), F.col(v).alias("value"))) for v in values}
    ends = dealt.groupBy(document, "_range").agg(*[F.max_by(event[v], F.when(F.col(v).isNotNull(), F.col(place))).alias(v) for v in values])
    above = Window.partitionBy(document).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(document).alias("_document"), F.col("_range").alias("_of"), *[F.last(v, ignorenulls=True).over(above).alias(f"{v}_above") for v in values])
    own = Window.partitionBy(document, "_range").orderBy(place)
    inside = dealt.withColumns({f"{v}_own": F.last(event[v], ignorenulls=True).over(own) for v in values})
    filled = inside.join(ends, F.col(document).eqNullSafe(F.col("_document")) & (F.col("_range") == F.col("_of")))
    return filled.select(*rows.columns, *[F.coalesce(f"{v}_own", f"{v}_above").alias(name) for v, name in zip(values, columns)])
