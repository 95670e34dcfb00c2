"""Jobs on the risk graph: labels of items and of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import read
from ledgerloom.operators import risks

EVIDENCE = """v AS (SELECT p_partkey AS seq, p_brand || '公司' AS company_name, '應付科目' || p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Payables' ELSE ' Other payables' END AS item_name, '應付科目' || p_size AS native,
  CASE WHEN p_partkey % 2 = 0 THEN '2024Q' || (p_partkey % 4 + 1) ELSE '113Q' || (p_partkey % 4 + 1) END AS period, p_type AS label FROM part),
q AS (SELECT p_partkey AS qid, p_partkey % 5 AS k, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN '無此公司' ELSE p_brand || '公司' END AS company, '應付科目' || p_size || '被標記為哪一類風險' AS question, '113Q' || (p_partkey % 4 + 1) AS quarter, '2024Q' || (p_partkey % 4 + 1) AS western FROM part),
s AS (SELECT q.*, v.company_name, v.native, v.period, v.label, v.seq FROM q JOIN v ON q.company IN ('', '無此公司') OR contains(v.company_name, left(q.company, 4))),
m AS (SELECT *, k < 4 AND contains(question, native) AS fits, max(CASE WHEN k < 4 AND contains(question, native) THEN length(native) ELSE 0 END) OVER (PARTITION BY qid) AS best FROM s),
r AS (SELECT *, bool_or(period IN (quarter, western)) OVER (PARTITION BY qid) AS any_period FROM m WHERE best = 0 OR (fits AND length(native) = best)),
l AS (SELECT qid, best, label, min(seq) AS seq FROM r WHERE NOT any_period OR period IN (quarter, western) GROUP BY ALL)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    variant = F.when(k % 3 == 0, "").when(k % 3 == 1, " Payables").otherwise(" Other payables")
    period = F.concat(F.when(k % 2 == 0, "2024Q").otherwise("113Q"), (k % 4 + 1).cast("string"))
    return read(spark, sf_dir, "part").select(
        k.alias("seq"), F.concat("p_brand", F.lit("公司")).alias("company_name"), F.concat(F.lit("應付科目"), F.col("p_size").cast("string"), variant).alias("item_name"), period.alias("period"), F.col("p_type").alias("label"),
    )


@query("X2 D2", f"""WITH {EVIDENCE} SELECT qid, string_agg(label, ';' ORDER BY seq, label) AS answer, CASE WHEN best > 0 THEN 'native' ELSE 'company' END AS "by" FROM l GROUP BY qid, best""")
def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of items asked for by their native names, whole companies asked for without one."""
    k = F.col("p_partkey")
    item = F.concat(F.lit("應付科目"), F.col("p_size").cast("string"), F.lit("被標記為哪一類風險"))
    asked = read(spark, sf_dir, "part").select(
        k.alias("qid"), F.when(k % 5 < 4, item).otherwise("哪一類風險").alias("question"), F.when(k % 7 == 0, "").when(k % 7 == 1, "無此公司").otherwise(F.concat("p_brand", F.lit("公司"))).alias("company"),
        F.lit("").alias("subject"), F.concat(F.lit("113Q"), (k % 4 + 1).cast("string")).alias("quarter"),
    )
    return risks.item_labels(asked, _evidence(spark, sf_dir))


@query("R11 P17", """
WITH x AS (SELECT p_brand AS source, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2024-Q1' ELSE '2024Q3' END AS period, p_type AS matched, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || '風險' END AS label, p_partkey AS seq FROM part),
e AS (SELECT source, period, matched, label, min(seq) AS seq FROM x GROUP BY ALL), q AS (SELECT p_brand AS id, p_brand AS source, CASE WHEN min(p_size) % 2 = 0 THEN 'ECONOMY' ELSE '' END AS subject, CASE WHEN min(p_size) % 3 = 0 THEN 'Q3' ELSE 'Q1' END AS quarter FROM part GROUP BY p_brand),
j AS (SELECT q.id, subject, e.*, replace(period, '-', '') = '' OR ends_with(replace(period, '-', ''), quarter) AS a FROM q JOIN e USING (source)),
k AS (SELECT *, subject <> '' AND contains(matched, left(subject, 4)) AS b FROM (SELECT *, bool_or(a) OVER (PARTITION BY id) AS any_a FROM j) WHERE a OR NOT any_a),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, label) AS n FROM (SELECT *, bool_or(b) OVER (PARTITION BY id) AS any_b FROM k) WHERE b OR NOT any_b),
l AS (SELECT id, subject, label, min(n) AS n FROM f WHERE n <= 10 AND label IS NOT NULL GROUP BY ALL)
SELECT id AS qid, CASE WHEN subject <> '' THEN '根據風險圖譜顯示，' || id || '的' || subject || '科目已被標記為' ELSE '根據風險圖譜顯示，' || id || '面臨的風險包括：' END || string_agg('【' || label || '】', '、' ORDER BY n) || '。' AS answer FROM l GROUP BY id, subject""")
def risk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each brand is exposed to, said in a sentence."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    period = F.when(k % 3 == 0, "").when(k % 3 == 1, "2024-Q1").otherwise("2024Q3")
    edges = part.select(F.col("p_brand").alias("source"), period.alias("period"), F.col("p_type").alias("matched"), F.when(k % 4 != 0, F.concat("p_type", F.lit("風險"))).alias("label"), k.alias("seq"))
    size = F.min("p_size")
    asked = part.groupBy(F.col("p_brand").alias("qid")).agg(F.when(size % 2 == 0, "ECONOMY").otherwise("").alias("subject"), F.when(size % 3 == 0, F.array(F.lit("Q3"))).otherwise(F.array(F.lit("Q1"))).alias("quarters"))
    return risks.direct_answers(asked.select("qid", F.col("qid").alias("company_id"), F.col("qid").alias("company_name"), "subject", "quarters"), edges)
