"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's share is its weight's part of the whole; shares beyond ``max_epochs`` times the source are clamped there and
the excess goes to the others by weight, until none is above. The repetitions of a source's documents are then a whole
number for all of them and one more for the first documents in a seeded order, up to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import written
from ledgerloom.llm.exact_dedup import whole

MAX_EPOCHS = 3
#: The weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Hexadecimal digits by which the place of the last document is narrowed at each level, and the levels.
DIGITS, LEVELS = 2, 3


def key_of(source: Column) -> Column:
    """Sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_of(doc_id: Column, seed: str = SEED) -> Column:
    """The seeded order of documents: by this digest, then by doc_id."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) in order of ``key``: a range-partitioned sort, then an offset per partition."""
    parts = written(sources.orderBy("key").withColumn("_id", F.monotonically_increasing_id()), "mix-order")
    parts = parts.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the sort: their number is a setting, not a size of the data.
    before = counts.withColumn("_before", F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)))
    return parts.join(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before")), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``capped`` and ``target`` to sources (key, source_size, weight).

    Each round one aggregation gives the words and weights that are left to the sources below the cap; only these two
    sums come to the driver. A source once capped stays so, since the level only rises.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level, words, weights = -1.0, total, 0
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        sums = sources.agg(F.sum(F.when(above, cap)).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        words, weights = total - (sums["c"] or 0), sums["w"] or 0
        if not weights or words / weights <= level:
            break
        level = words / weights
    return sources.withColumn("capped", cap <= F.col("weight") * F.lit(level)).withColumn(
        "target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    )


def plan(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents with key, order and size; sources with target, whole repetitions and the last document of one more)."""
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("source")).alias("key"),
            order_of(F.col("doc_id"), seed).alias("place"), size_of(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    sources = ranked(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(water_fill(written(sources.withColumn("weight", weight), "mix-sources"), max_epochs), "mix-targets")
    whole = F.when(F.col("capped"), F.lit(max_epochs)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # Narrow down, per source, the stretch of the order in which the running size passes the rest.
    open_ = sources.select("key", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest").where("rest > 0")
    for level in range(1, LEVELS + 1):
        n = DIGITS * level
        docs_here = sized.select("key", F.substring("place", 1, n).alias("bucket"), F.substring("place", 1, n - DIGITS).alias("prefix"), "size")
        sums = docs_here.join(open_, ["key", "prefix"]).groupBy("key", "before", "rest", "bucket").agg(F.sum("size").alias("words"))
        order = W.Window.partitionBy("key").orderBy("bucket")
        upto = F.sum("words").over(order.rowsBetween(W.Window.unboundedPreceding, 0))
        sums = sums.withColumn("_end", F.col("before") + upto).withColumn("_start", F.col("_end") - F.col("words"))
        open_ = written(sums.where("_start < rest AND _end >= rest").select("key", F.col("bucket").alias("prefix"), F.col("_start").alias("before"), "rest"), "mix-stretch")
    stretch = open_
    rows = sized.withColumn("prefix", F.substring("place", 1, DIGITS * LEVELS)).join(stretch, ["key", "prefix"])
    end = F.col("before") + F.sum("size").over(W.Window.partitionBy("key").orderBy("place", "doc_id"))
    rows = rows.withColumn("_end", end).withColumn("_start", F.col("_end") - F.sum("size").over(W.Window.partitionBy("key", "place", "doc_id")))
    # The document that passes the rest is taken if that brings the sum nearer to it.
    taken = F.when(F.col("_start") + F.col("_end") <= 2 * F.col("rest"), F.struct("place", "doc_id"))
    nothing = F.struct(F.col("prefix").alias("place"), F.lit(None).cast("long").alias("doc_id"))
    last = rows.groupBy("key", "prefix").agg(F.max(taken).alias("last")).select("key", F.coalesce("last", nothing).alias("last"))
    return sized, written(sources.join(last, "key", "left").select("key", "source_size", "target", "whole", "last"), "mix-plan")


def repeats(place: Column, doc_id: Column) -> Column:
    """Of a document joined to its source's plan."""
    here = F.struct(place.alias("place"), doc_id.alias("doc_id"))
    return F.col("whole") + F.when(here <= F.col("last"), 1).otherwise(0)


def mix(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source; others are not read).

    Null texts have size 0, and null sources are one source, the last. A source without words has target 0. Words that a
    source takes differ from its target by half of one document at most, and no document is taken more than
    ``max_epochs`` times. A null doc_id is ordered as an empty one; rows that repeat a doc_id within a source are taken
    alike. An empty table gives no rows. The plan is joined by source: Spark broadcasts it while its written size is
    below the session's limit, else it joins by sorting and splits large sources.
    """
    sized, sources = plan(docs, seed, max_epochs, weights)
    rows = sized.join(sources, "key")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats(F.col("place"), F.col("doc_id"))).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    _, sources = plan(docs, seed, max_epochs, weights)
    keyed = docs.select(whole(docs), key_of(docs["source"]).alias("key"), order_of(docs["doc_id"], seed).alias("place"), docs["doc_id"].cast("long").alias("id"))
    rows = keyed.join(sources, "key")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(True), repeats(F.col("place"), F.col("id")).cast("int")))).select("doc.*")
