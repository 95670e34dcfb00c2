"""Jobs on headers, labels and file names, built from orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import read


@query("F11 F12 F13 P15", """
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, year(o_orderdate) AS y FROM orders)
SELECT id, CASE k WHEN 0 THEN y || '年1月1日至6月30日' WHEN 1 THEN '資產負債表_會計項目' WHEN 2 THEN '資產負債表_' || y || '年3月31日' || y || '/3/31' WHEN 3 THEN 'Unnamed: 0_level_1 Amount' WHEN 4 THEN 'record_type' ELSE 'A' || (id + 100) END AS clean,
  CASE k WHEN 0 THEN y || '年1月1日至6月30日 ' || y || '/1/1To6/30' WHEN 1 THEN '會計項目' WHEN 2 THEN y || '年3月31日 ' || y || '/3/31' WHEN 3 THEN 'Unnamed: 0_level_1 Amount' WHEN 4 THEN 'record_type' ELSE 'A' || (id + 100) END AS flat,
  CASE k WHEN 0 THEN y || '年1月1日至6月30日 ' || y || '/1/1To6/30' WHEN 1 THEN '會計項目' WHEN 2 THEN y || '年3月31日' || y || '/3/31' WHEN 3 THEN 'Amount' WHEN 4 THEN 'record type' ELSE 'A' || (id + 100) END AS words,
  k = 1 AS describes, k IN (0, 2, 3) AS holds_values, k = 5 AS is_code FROM o""")  # fmt: skip
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in six shapes, cleaned, flattened and classified."""
    k, y, i = F.col("o_orderkey") % 6, F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    h = F.when(k == 0, F.concat(y, F.lit("年1月1日至6月30日 "), y, F.lit("/1/1To6/30"))).when(k == 1, "資產負債表_會計項目").when(k == 2, F.concat(F.lit("資產負債表_"), y, F.lit("年3月31日"), y, F.lit("/3/31"))).when(k == 3, "Unnamed: 0_level_1 Amount").when(k == 4, "record_type").otherwise(F.concat(F.lit("A"), (i + 100).cast("string")))
    rows = read(spark, sf_dir, "orders").select(i.alias("id"), h.alias("h"))
    c = F.col("h")
    return rows.select("id", labels.clean_header(c).alias("clean"), labels.flat_header(c).alias("flat"), labels.header_words(c).alias("words"), labels.is_describing(c).alias("describes"), labels.is_value(c).alias("holds_values"), labels.is_account_code(c).alias("is_code"))


@query("A-4 F20 F24 F31 Z2 Z14 Z18", """
SELECT o_orderkey AS id, 'C' || o_custkey || '的' || o_orderpriority || '是多少' AS question_key, 'C' || o_custkey AS company, o_orderpriority AS item, CAST(o_custkey AS VARCHAR) AS first_segment, 'B' AS winner,
  o_orderkey % 4 + 1 AS quarter, 'C' || o_custkey || ',' || o_orderpriority AS filters, 'C' || o_custkey || '/' || o_orderpriority AS visual, CAST(o_orderkey % 5 AS INT) AS indent, left('公司' || o_custkey, 2) AS cut FROM orders""")  # fmt: skip
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, answers, lists and printed lines taken apart."""
    i, c, p = F.col("o_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("o_orderpriority")
    rows = read(spark, sf_dir, "orders").select(
        i.alias("id"), F.concat(F.lit(" 【"), c, F.lit("】的（"), F.replace(p, F.lit(" "), F.lit("_")), F.lit("）是 多少")).alias("q"), F.concat(F.lit("請教【"), c, F.lit("】在【113Q2】的【"), p, F.lit("】是多少？")).alias("t"), p.alias("p"),
        F.concat(F.lit("A: 0 ｜ A: "), F.col("o_custkey").cast("string"), F.lit(" | 較高：B")).alias("a"), F.concat(F.lit("y2024 "), F.when(i % 2 == 0, "Q").otherwise("q"), (i % 4 + 1).cast("string")).alias("period"),
        F.concat(c, F.lit(";"), c, F.lit(",, ")).alias("l"), F.concat(F.repeat(F.lit(" "), (i % 5).cast("int")), c, F.lit("    "), p, F.lit("  ")).alias("line"), F.concat(F.lit("公司"), F.col("o_custkey").cast("string")).alias("name"),
    )
    t, s = labels.template_parts(F.col("t")), labels.segments(F.col("a"))
    return rows.select(
        "id", F.regexp_replace(labels.question_key(F.col("q")), "_", " ").alias("question_key"), t["company"].alias("company"), t["item"].alias("item"), s["A"].alias("first_segment"), s["較高"].alias("winner"),
        labels.quarter_of(F.col("period")).cast("bigint").alias("quarter"), F.concat(F.array_join(labels.filter_list(F.col("l")), ","), F.lit(","), "p").alias("filters"), F.array_join(labels.visual_columns(F.col("line")), "/").alias("visual"),
        labels.indent(F.col("line")).cast("int").alias("indent"), labels.cut_bytes(F.col("name"), 6).alias("cut"),
    )


@query("P13 Z3 Z21", """
WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name AS n FROM part)
SELECT id, k NOT IN (4, 5) AS noise, CASE WHEN k = 0 THEN 'Node' ELSE replace(n, ' ', '_') END AS symbol, CASE k WHEN 0 THEN '_untitled' ELSE replace(n, ' ', '_') || '_' || k END || '.csv' AS file, k NOT IN (0, 1, 2) AS is_report FROM p""")
def label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise among facts, symbols, safe file names, and files that are no tables of a report."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    value = F.get(F.array(*map(F.lit, ("1.5%", "－", "( 0 )", "7", "1,234", "( 5 )"))), k.cast("int"))
    header = F.when(k == 3, "持股比率").otherwise("本期")
    raw_file = F.get(F.array(*map(F.lit, ("x_facts.csv", "x_all_table_facts_2.csv", "x_xbrl_notes.csv", "資產負債表.csv", "facts.csv", "x_facts.csv.bak"))), k.cast("int"))
    name = labels.file_name(F.when(k == 0, " ../").otherwise(F.concat(F.lit(" "), n, F.lit("/_"), k.cast("string"), F.lit(". "))))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), labels.is_noise(header, value, numbers.fact_number(value)).alias("noise"), labels.symbol(F.when(k == 0, "3 %").otherwise(F.concat(F.lit(" "), n, F.lit("--"))), "Node").alias("symbol"),
        F.when(k == 0, F.concat(F.lit("_"), name)).otherwise(name).alias("file"), labels.is_report_file(raw_file).alias("is_report"),
    )
