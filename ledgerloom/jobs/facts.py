"""Jobs on facts: unpivoting, parsing, keys, duplicates and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, periods, texts
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import FACTS, facts, read
from ledgerloom.operators import facts as ops


@query("T6 S1 A1 A2", f"WITH {FACTS} SELECT * FROM facts")
def fact_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lookup_projection(facts(spark, sf_dir))


@query("A4 D1 D4 N1 F7 F10", f"""WITH {FACTS}
SELECT seq, CAST(left(period, 3) AS INT) AS fiscal_year, CAST(left(period, 3) AS INT) + 1911 AS year, CAST(right(period, 1) AS INT) AS quarter,
       CASE WHEN table_name LIKE '資產負債%' THEN 'balance_sheet' WHEN table_name LIKE '%損益%' THEN 'income' ELSE 'cash_flow' END AS table_group,
       regexp_replace(table_name, '_[0-9]+$', '') AS table_base, CASE WHEN table_name LIKE '%\\_2' ESCAPE '\\' THEN 2 ELSE 1 END AS table_instance,
       split_part(item_name, ' ', 1) AS item_native, substr(item_name, instr(item_name, ' ') + 1) AS item_latin,
       CASE WHEN value_raw = '-' THEN NULL ELSE value_number END AS value_parsed,
       CASE WHEN value_raw = '-' THEN 'unknown' WHEN value_number < 0 THEN 'negative' ELSE 'positive' END AS value_sign
FROM facts""")  # fmt: skip
def fact_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["seq", "fiscal_year", "year", "quarter", "table_group", "table_base", "table_instance", "item_native", "item_latin", "value_parsed", "value_sign"]
    return ops.enrich(facts(spark, sf_dir)).select(*columns)


@query("D5 D6 D7 P6 D2 D3", f"""WITH {FACTS}, h AS (SELECT DISTINCT column_header, period FROM facts)
SELECT column_header, period, CASE WHEN column_header LIKE '%至%' THEN 'duration' ELSE 'instant' END AS period_kind,
  CASE WHEN column_header LIKE '%至%' THEN left(column_header, 4) || '-' || lpad(regexp_extract(column_header, '年([0-9]+)月1日至', 1), 2, '0') || '-01' END AS period_start,
  left(column_header, 4) || '-' || lpad(regexp_extract(column_header, '([0-9]+)月([0-9]+)日$', 1), 2, '0') || '-' || lpad(regexp_extract(column_header, '([0-9]+)日$', 1), 2, '0') AS period_end,
  CAST(left(column_header, 4) AS INT) AS header_year, column_header AS header_key,
  CASE WHEN left(column_header, 4)::INT = CAST(left(period, 3) AS INT) + 1911 THEN 'current' WHEN left(column_header, 4)::INT = CAST(left(period, 3) AS INT) + 1910 THEN 'prior' ELSE 'unknown' END AS period_role,
  (CAST(left(period, 3) AS INT) + 1911) || right(period, 2) AS western, CAST(left(period, 3) AS INT) * 10 + CAST(right(period, 1) AS INT) AS sort_key
FROM h""")  # fmt: skip
def header_period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p = F.col("column_header"), F.col("period")
    rows = facts(spark, sf_dir).select("column_header", "period").distinct()
    return rows.select(
        h, p, periods.header_kind(h).alias("period_kind"), periods.header_start(h).alias("period_start"), periods.header_end(h).alias("period_end"),
        periods.header_year(h).alias("header_year"), periods.header_key(h).alias("header_key"), periods.header_role(h, p).alias("period_role"), periods.western_label(p).alias("western"), periods.sort_key(p).alias("sort_key"),
    )


@query("N1 N2 N3 N4 N5 N6 N7 F18", """
WITH r AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderkey % 5 AS k FROM orders),
t AS (SELECT id, v, k, CASE k WHEN 0 THEN '( ' || format('{:,}', v) || ' )' WHEN 1 THEN format('{:,}', v) WHEN 2 THEN v || '%' WHEN 3 THEN '—' ELSE '-' || v END AS raw FROM r)
SELECT id, raw,
  CASE k WHEN 0 THEN -v WHEN 3 THEN NULL WHEN 4 THEN -v ELSE v END::DOUBLE AS fact_number,
  CASE k WHEN 0 THEN -v WHEN 3 THEN NULL WHEN 4 THEN -v ELSE v END::DOUBLE AS clean_number,
  CASE k WHEN 0 THEN -v WHEN 1 THEN v WHEN 4 THEN -v END::DOUBLE AS signed_number,
  CASE k WHEN 0 THEN -v WHEN 3 THEN NULL WHEN 4 THEN -v ELSE v END::DOUBLE AS first_number,
  CASE k WHEN 0 THEN (-v) || '.0000' WHEN 1 THEN v || '.0000' WHEN 4 THEN (-v) || '.0000' END AS number_key,
  CASE k WHEN 1 THEN v WHEN 2 THEN v / 100.0 WHEN 4 THEN -v END::DOUBLE AS ratio_number,
  CASE k WHEN 3 THEN 'missing_value' ELSE 'value' END AS state
FROM t""")  # fmt: skip
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("o_totalprice") * 100).cast("bigint")
    k = F.col("o_orderkey") % 5
    digits = F.format_number(v, 0)
    raw = F.when(k == 0, F.concat(F.lit("( "), digits, F.lit(" )"))).when(k == 1, digits).when(k == 2, F.concat(v.cast("string"), F.lit("%"))).when(k == 3, "—").otherwise(F.concat(F.lit("-"), v.cast("string")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    r = F.col("raw")
    key = numbers.number_key(r)
    return rows.select(
        "id", "raw", numbers.fact_number(r).alias("fact_number"), numbers.clean_number(r).alias("clean_number"), numbers.signed_number(r).alias("signed_number"),
        numbers.first_number(r).alias("first_number"), F.when(key != "null", key).alias("number_key"), numbers.ratio_number(r).alias("ratio_number"), numbers.cell_state(r).alias("state"),
    )


@query("F27 F25", f"""WITH {FACTS}
SELECT seq, left(sha1(company || '|' || period || '|' || table_name || '|' || item_name || '|' || column_header || '|' || value_raw || '|' || seq), 16) AS fact_key,
  company || ' ' || period || ' ' || item_name || ' ' || value_raw AS fact_text FROM facts""")  # fmt: skip
def fact_key_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "company", "period", "item_name", "value_raw").alias("fact_text")
    return facts(spark, sf_dir).select("seq", texts.fact_key(*[F.col(c) for c in ("company", "period", "table_name", "item_name", "column_header", "value_raw", "seq")]).alias("fact_key"), text)


@query("W2", f"""WITH {FACTS}, r AS (SELECT seq, CAST(row_number() OVER (PARTITION BY company, period, table_name, item_name, column_header ORDER BY seq) AS INT) AS duplicate_rank FROM facts)
SELECT seq, duplicate_rank, duplicate_rank > 1 AS is_duplicate FROM r""")  # fmt: skip
def dup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_rank(facts(spark, sf_dir), ["company", "period", "table_name", "item_name", "column_header"]).select("seq", "duplicate_rank", "is_duplicate")


CURRENT = f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY company, item_name, period
  ORDER BY CASE WHEN column_header LIKE '%至%' THEN 1 ELSE 0 END DESC, CAST(left(column_header, 4) AS INT) DESC, seq) AS rn FROM facts)
SELECT seq, company, period, item_name, value_raw FROM r WHERE rn = 1"""


@query("W1 W3 A5 D7", CURRENT)
def dedupe_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.current_view(facts(spark, sf_dir)).select("seq", "company", "period", "item_name", "value_raw")


@query("P11 A5 F10", f"""WITH {FACTS} SELECT period, table_name LIKE '%現金流量%' AS entity, count(*) AS n, count(DISTINCT company) AS companies FROM facts GROUP BY ALL""")
def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of cash-flow tables stand in for those about single entities, which the order tables lack."""
    named = F.regexp_replace("table_name", "現金流量", "關係人名錄")
    rows = facts(spark, sf_dir).select("period", ops.is_entity_table(named).alias("entity"), "company")
    return rows.groupBy("period", "entity").agg(F.count("*").alias("n"), F.count_distinct("company").alias("companies"))


@query("A9 J13 G10 K3", """
SELECT s_suppkey AS source, count(l_suppkey) AS n_facts, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS record_types, count(l_suppkey) > 0 AS has_facts
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1""")
def coverage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("record_type"))
    return ops.coverage(registry, lines, "source")


@query("G14 L8", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS parts, count(*) AS kinds, min(n) AS fewest, max(n) AS most, string_agg(CASE WHEN rn <= 3 THEN p_type END, ' ｜ ' ORDER BY rn) AS top_kinds FROM r GROUP BY p_brand""")  # fmt: skip
def source_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))
    top = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "p_type"))))
    return ranked.groupBy("p_brand").agg(
        F.sum("n").alias("parts"), F.count("*").alias("kinds"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.array_join(F.transform(top, lambda x: x["p_type"]), " ｜ ").alias("top_kinds")
    )


@query("S22 J19", """
SELECT o_orderkey, max(CASE WHEN k = 'status' THEN v END) AS status, max(CASE WHEN k = 'priority' THEN v END) AS priority, max(CASE WHEN k = 'customer' THEN v END) AS customer
FROM (SELECT o_orderkey, 'status' AS k, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS VARCHAR) FROM orders) GROUP BY 1""")  # fmt: skip
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-attribute-value rows back to columns, by one aggregation over stated attributes."""
    wide = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer"))
    eav = wide.unpivot(["o_orderkey"], ["status", "priority", "customer"], "k", "v")
    return eav.groupBy("o_orderkey").pivot("k", ["status", "priority", "customer"]).agg(F.first("v"))
