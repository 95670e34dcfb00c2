"""Stored graphs: keyed tables that a new filing is merged into, the changed partitions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import texts
from ledgerloom.shared import kept

#: Partitions of a stored table; a key's partition never changes.
PARTS = 64


def edge_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def merged(rows: DataFrame, key: str, props: Sequence[str], seq: str) -> DataFrame:
    """One row per key: of each property the value disclosed last that is not null, and the last ``seq``; partial per task."""
    last = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col(seq))).alias(p) for p in props]
    return rows.groupBy(key).agg(*last, F.max(seq).alias(seq))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert(rows: DataFrame, path: str, key: str, props: Sequence[str], seq: str = "seq", parts: int = PARTS) -> DataFrame:
    """Merge ``rows`` (key, props, seq) into the table at ``path`` and return it. Rows without a key are left out.

    A property keeps its value where the new rows have none, so filings in order of ``seq`` give the table that one
    build of all gives, and a filing merged twice changes nothing. Only the partitions of new keys are read and written.
    They are complete in the shared folder before the table is touched: a run that fails can be run again.
    """
    spark = rows.sparkSession
    columns = [key, *props, seq]
    new = rows.where(F.col(key).isNotNull()).select(*columns).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    new = kept(new, "upsert-rows")
    old = stored(spark, path)
    if old is not None:
        touched = new.select("part").distinct()  # at most ``parts`` rows
        new = new.unionByName(old.join(F.broadcast(touched), "part", "left_semi").select(*new.columns))
    staged = merged(new, key, props, seq).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    staged = kept(staged, "upsert-staged")
    staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return spark.read.schema(staged.schema).parquet(path).select(*columns)


def loaded(graphs: dict[str, DataFrame]) -> DataFrame:
    """Graphs of differing columns as one, each row with its ``_graph_source``; ownership loses its percent sign."""
    every = None
    for name, g in graphs.items():
        if "ownership_percent" in g.columns:
            g = g.withColumn("ownership_percent", F.regexp_replace(F.col("ownership_percent").cast("string"), "[%％]", ""))
        g = g.withColumn("_graph_source", F.lit(name))
        every = g if every is None else every.unionByName(g, allowMissingColumns=True)
    return every


def investment_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records of investments with report_company, report_period, source and row.

    Nodes: id, label, name; edges: source, target, type, edge_key, report_period, ownership_percent, book_value. Investors
    invest in investees, once per disclosed row; investees lie somewhere and have a business.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), texts.safe_id(c))
    blank = lambda c: F.when(F.trim(c) == "", "未標註").otherwise(F.col(c))
    ends = {
        "investor": ("Company", F.col("investor_name"), node("company_name", F.coalesce(F.nullif(texts.company_key(F.col("investor_name")), F.lit("")), F.col("investor_name")))),
        "investee": ("Company", F.col("investee_name"), node("company_name", F.coalesce(F.nullif(texts.company_key(F.col("investee_name")), F.lit("")), F.col("investee_name")))),
        "location": ("Location", blank("location"), node("location", blank("location"))), "business": ("Business", blank("main_business"), node("business", blank("main_business"))),
    }
    rows = records.withColumns({f"_{k}": c for k, (_, _, c) in ends.items()})
    nodes = rows.select(F.explode(F.array(*[F.struct(F.col(f"_{k}").alias("id"), F.lit(label).alias("label"), name.alias("name")) for k, (label, name, _) in ends.items()])).alias("n")).select("n.*")
    nodes = nodes.where("trim(name) != ''").groupBy("id", "label").agg(F.min("name").alias("name"))
    none = F.lit(None).cast("double")
    made = [
        ("_investor", "_investee", "INVESTS_IN", edge_key(F.col("report_period"), F.col("source"), F.col("row")), F.col("ownership_percent"), F.col("book_value")),
        ("_investee", "_location", "LOCATED_IN", edge_key(F.col("_location")), none, none), ("_investee", "_business", "HAS_MAIN_BUSINESS", edge_key(F.col("_business")), none, none),
    ]
    edges = rows.select("investor_name", F.explode(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(t).alias("type"), k.alias("edge_key"), F.when(F.lit(t) == "INVESTS_IN", F.col("report_period")).alias("report_period"), p.alias("ownership_percent"), v.alias("book_value")) for a, b, t, k, p, v in made])).alias("e"))
    edges = edges.where("e.type != 'INVESTS_IN' OR trim(investor_name) != ''").select("e.*")
    return nodes, edges.groupBy("source", "target", "type", "edge_key").agg(F.max("report_period").alias("report_period"), F.max("ownership_percent").alias("ownership_percent"), F.max("book_value").alias("book_value"))
