"""Facts, companies and relations as seen in the order tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import periods
from ledgerloom.operators import facts as ops
from ledgerloom.shared import kept, shared_folder  # noqa: F401
from ledgerloom.sources.ordered import numbered

ITEMS = {
    "l_quantity": "數量 Quantity",
    "l_extendedprice": "營業收入合計 Total operating revenue",
    "l_discount": "折讓 Sales discount",
    "l_tax": "所得稅費用 Income tax expense",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, company, period, table_name, item_name, column_header, value_raw, value_number: four per line item.

    seq is the order of disclosure and a key: no two facts share one.
    """
    d = F.col("l_shipdate")
    q = F.quarter(d)
    year = F.year(d).cast("string")
    last = F.when(q.isin(1, 4), 31).otherwise(30).cast("string")
    rows = numbered(read(spark, sf_dir, "lineitem"), "line").select(
        "line",
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("company"),
        periods.label_of(d).alias("period"),
        F.when(F.col("l_returnflag") == "R", "資產負債表").when(F.col("l_returnflag") == "A", "現金流量表_2").otherwise("綜合損益表").alias("table_name"),
        F.when(F.col("l_returnflag") == "R", F.concat(year, F.lit("年"), (q * 3).cast("string"), F.lit("月"), last, F.lit("日")))
        .when(F.col("l_linestatus") == "O", F.concat(year, F.lit("年1月1日至"), (q * 3).cast("string"), F.lit("月"), last, F.lit("日")))
        .otherwise(F.concat(year, F.lit("年"), (q * 3 - 2).cast("string"), F.lit("月1日至"), (q * 3).cast("string"), F.lit("月"), last, F.lit("日"))).alias("column_header"),
        F.col("l_quantity").cast("bigint").alias("l_quantity"), F.round("l_extendedprice").cast("bigint").alias("l_extendedprice"),
        (-F.round(F.col("l_discount") * 100).cast("bigint")).alias("l_discount"), F.round(F.col("l_tax") * 100).cast("bigint").alias("l_tax"),
    )
    long = ops.unpivot(rows, ["line", "company", "period", "table_name", "column_header"], ITEMS)
    v = F.col("value_number")
    digits = F.format_number(F.abs(v), 0)
    raw = F.when(v < 0, F.concat(F.lit("( "), digits, F.lit(" )"))).when(v == 0, "-").otherwise(digits)
    place = F.create_map(*[x for i, name in enumerate(ITEMS.values()) for x in (F.lit(name), F.lit(i))])[F.col("item_name")]
    return long.select((F.col("line") * 10 + place).cast("bigint").alias("seq"), "company", "period", "table_name", "item_name", "column_header", raw.alias("value_raw"), v.cast("double").alias("value_number"))


FACTS = """
base AS MATERIALIZED (
  SELECT row_number() OVER () - 1 AS line, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS company,
         lpad(CAST(year(l_shipdate) - 1911 AS VARCHAR), 3, '0') || 'Q' || quarter(l_shipdate) AS period,
         CASE l_returnflag WHEN 'R' THEN '資產負債表' WHEN 'A' THEN '現金流量表_2' ELSE '綜合損益表' END AS table_name,
         CASE WHEN l_returnflag = 'R' THEN year(l_shipdate) || '年' || quarter(l_shipdate) * 3 || '月' || CASE WHEN quarter(l_shipdate) IN (1, 4) THEN 31 ELSE 30 END || '日'
              WHEN l_linestatus = 'O' THEN year(l_shipdate) || '年1月1日至' || quarter(l_shipdate) * 3 || '月' || CASE WHEN quarter(l_shipdate) IN (1, 4) THEN 31 ELSE 30 END || '日'
              ELSE year(l_shipdate) || '年' || (quarter(l_shipdate) * 3 - 2) || '月1日至' || quarter(l_shipdate) * 3 || '月' || CASE WHEN quarter(l_shipdate) IN (1, 4) THEN 31 ELSE 30 END || '日' END AS column_header,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS e, -CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
  FROM lineitem
), long AS (
  SELECT line * 10 + 0 AS seq, company, period, table_name, column_header, '數量 Quantity' AS item_name, q AS v FROM base
  UNION ALL SELECT line * 10 + 1, company, period, table_name, column_header, '營業收入合計 Total operating revenue', e FROM base
  UNION ALL SELECT line * 10 + 2, company, period, table_name, column_header, '折讓 Sales discount', d FROM base
  UNION ALL SELECT line * 10 + 3, company, period, table_name, column_header, '所得稅費用 Income tax expense', t FROM base
), facts AS (
  SELECT seq, company, period, table_name, item_name, column_header,
         CASE WHEN v < 0 THEN '( ' || format('{:,}', abs(v)) || ' )' WHEN v = 0 THEN '-' ELSE format('{:,}', v) END AS value_raw, CAST(v AS DOUBLE) AS value_number
  FROM long
)
"""
