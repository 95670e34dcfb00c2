"""The set-based core of every lookup: tiers, relaxation, the uniqueness gate, last rows and lists.

All take candidates with a question key, so that any number of questions is answered in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relax_filter(rows: DataFrame, by: Sequence[str], predicate: Column) -> DataFrame:
    """Rows that satisfy ``predicate``, or all of a key's rows if none of them does. A null predicate is false."""
    p = F.coalesce(predicate, F.lit(False))
    any_ = F.max(p).over(Window.partitionBy(*by))
    return rows.withColumns({"_p": p, "_any": any_}).where(F.col("_p") | ~F.col("_any")).drop("_p", "_any")


def best_tier(rows: DataFrame, by: Sequence[str], tier: Column, name: str = "tier") -> DataFrame:
    """The rows of each key's lowest tier; rows of null tier never match."""
    rows = rows.withColumn(name, tier).where(F.col(name).isNotNull())
    return rows.withColumn("_least", F.min(name).over(Window.partitionBy(*by))).where(F.col(name) == F.col("_least")).drop("_least")


def unique_gate(rows: DataFrame, by: Sequence[str], value: str, keys: DataFrame | None = None) -> DataFrame:
    """One row per key: n_rows, n_unique, decision and answer, which is given only if exactly one distinct value is left.

    With ``keys``, questions without any candidate are answered ``no_candidate``.
    """
    gate = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct(value).alias("n_unique"), F.min(value).alias("_v"))
    if keys is not None:
        gate = keys.select(*by).distinct().join(gate, list(by), "left").fillna(0, ["n_rows", "n_unique"])
    decision = F.when(F.col("n_unique") == 1, "hit_unique").when(F.col("n_unique") == 0, "no_candidate").otherwise("ambiguous")
    return gate.withColumn("decision", decision).withColumn("answer", F.when(F.col("n_unique") == 1, F.col("_v"))).drop("_v")


def last_row(rows: DataFrame, by: Sequence[str], value: Column, seq: str) -> DataFrame:
    """The value disclosed last per key, by ``seq``."""
    return rows.groupBy(*by).agg(F.max_by(value, F.col(seq)).alias("last_value"))


def list_all(rows: DataFrame, by: Sequence[str], value: Column, seq: str, joiner: str = " ｜ ") -> DataFrame:
    """Distinct values per key in order of disclosure.

    Equal values are one before they are gathered, so a list is as long as the answer that it makes.
    """
    first = rows.groupBy(*by, value.alias("_v")).agg(F.min(seq).alias("_s"))
    ordered = F.array_sort(F.collect_list(F.struct("_s", "_v")))
    return first.groupBy(*by).agg(F.count("*").alias("n_values"), F.array_join(F.transform(ordered, lambda x: x["_v"]), joiner).alias("all_values"))


def keep_first(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in a stated order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")

