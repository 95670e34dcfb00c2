"""Jobs of ingestion: HTML tables, Markdown, chunks, paths, fuzzy names and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import FACTS, facts, read, shared_folder
from ledgerloom.operators import chunking, fuzzy
from ledgerloom.sources import html_tables
from ledgerloom.streaming import windows


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer with a table of the orders; the title spans two columns and the status two rows."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), "o_orderpriority", F.lit("</td><td>"), F.format_number(F.round("o_totalprice").cast("bigint"), 0), F.lit("</td></tr>"))
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    page = F.concat(F.lit("<html><span class='zh'>訂單 "), F.col("o_custkey").cast("string"), F.lit("</span><table><tr><th>Order</th><th colspan=2>Detail</th></tr>"), "rows", F.lit("</table></html>"))
    return rows.select("o_custkey", page.alias("html"))


@query("S8 S9 T6 Z4", """
SELECT o_custkey, '訂單 ' || o_custkey AS title, CAST(o_orderkey AS VARCHAR) AS item_name, 'Detail' AS column_header, unnest([o_orderpriority, format('{:,}', CAST(round(o_totalprice) AS BIGINT))]) AS value_raw FROM orders""")
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tables.tables(_pages(spark, sf_dir), "o_custkey", "html")
    return html_tables.cells(found, ["o_custkey", "title"]).drop("row_index")


@query("S8 Z4", """SELECT page_id, len(regexp_extract_all(lower(coalesce(html, '')), '<table[ >]')) AS n_tables FROM pages""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the raw pages, counted per page; pages without a table count 0."""
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    found = html_tables.tables(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_tables"))
    return pages.select("page_id").join(found, "page_id", "left").fillna(0, ["n_tables"])


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["p_partkey"].cast("string"), x["p_type"]))
    key = F.concat_ws("/", "p_brand", "p_size")
    return parts.select(key.alias("id"), html_tables.markdown(F.array(F.lit("key"), F.lit("type")), rows).alias("text"))


@query("K7 T3 T2", "SELECT p_brand || '/' || p_size AS id, 'key: ' || p_partkey || ' | type: ' || p_type AS line FROM part")
def md_table_to_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("id", F.explode(html_tables.key_values(F.col("text"))).alias("line"))


@query("T1 T2 A14 W6")
def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(_markdown(spark, sf_dir), "id", "text")


@query("S4 Z5 Z13 D1", """
SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS company_code, replace(s_name, '#', '') AS company_name, '113Q' || (s_suppkey % 4 + 1) AS quarter, '資產負債表' AS table_name FROM supplier""")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("file:/data/"), F.col("s_suppkey").cast("string"), F.lit("_"), F.replace("s_name", F.lit("#"), F.lit("")), F.lit("/113Q"), (F.col("s_suppkey") % 4 + 1).cast("string"), F.lit("/資產負債表.csv"))
    rows = read(spark, sf_dir, "supplier").withColumn("path", path)
    return rows.select("s_suppkey", *[c.alias(n) for n, c in html_tables.path_parts(F.col("path")).items()])


@query("F29 J11")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names against all names."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = parts.where("length(p_name) > 3").select(F.col("p_partkey").alias("qid"), F.concat(F.substring("p_name", 2, 1000), F.lit("x")).alias("asked"))
    return fuzzy.most_similar(asked, parts.select("p_name"), "asked", "p_name", "qid", 0.6).select("qid", F.col("p_name").alias("match"), F.round("score", 4).alias("score"))


@query("J11 P4")
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the benchmark and the long words of all documents that are spelt nearly so."""
    words = lambda name: read(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]{9,})"), F.lit(1))).alias("w")).distinct()
    pairs = fuzzy.similar(words("benchmark").withColumnRenamed("w", "asked"), words("documents").withColumnRenamed("w", "found"), "asked", "found", 0.85)
    return pairs.where("asked != found").select("asked", "found", F.round("score", 4).alias("score"))


@query("§2.19", """
WITH m AS (SELECT max(ts) AS m FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d %H') AS hour, event_type, n FROM w, m WHERE w + INTERVAL 1 HOUR <= m - INTERVAL 2 HOUR""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly windows of a stream over the events, written to the shared folder."""
    base = shared_folder(spark, "events")
    events = windows.stream_files(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = windows.run_once(windows.windowed(events, "ts", "event_type").select(F.col("w.start").alias("start"), "event_type", "n"), base + "/out", base + "/state")
    return closed.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
