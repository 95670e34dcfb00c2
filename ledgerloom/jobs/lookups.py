"""Jobs that answer questions from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import maps, periods, texts
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import FACTS, facts, kept, read
from ledgerloom.operators import checked, lookup, relax

# One question per supplier, period and item in rotation; every second names a table, every third a header.
QUESTIONS = f"""{FACTS}, asked AS (
  SELECT company, period, item_name, min(seq) AS seq FROM facts GROUP BY ALL
), questions AS (
  SELECT company || '|' || period || '|' || item_name AS qid, CASE WHEN seq % 5 = 0 THEN substr(company, 2) ELSE company END AS q_company, period AS q_period,
         CASE seq % 3 WHEN 0 THEN item_name WHEN 1 THEN split_part(item_name, ' ', 1) ELSE substr(split_part(item_name, ' ', 1), 2) END AS q_item,
         CASE WHEN seq % 2 = 0 THEN '綜合損益表' END AS q_table, CASE WHEN (seq // 10) % 2 = 0 THEN left(CAST(CAST(left(period, 3) AS INT) + 1911 AS VARCHAR), 4) || '年1月1日至12月31日' END AS q_header, seq AS seq_
  FROM asked
)"""


def questions(rows: DataFrame) -> DataFrame:
    asked = rows.groupBy("company", "period", "item_name").agg(F.min("seq").alias("seq"))
    native = texts.native_part(F.col("item_name"))
    item = F.when(F.col("seq") % 3 == 0, F.col("item_name")).when(F.col("seq") % 3 == 1, native).otherwise(F.expr("substring(split_part(item_name, ' ', 1), 2)"))
    header = F.concat((periods.fiscal_year(F.col("period")) + periods.ROC).cast("string"), F.lit("年1月1日至12月31日"))
    return asked.select(
        F.concat_ws("|", "company", "period", "item_name").alias("qid"), F.when(F.col("seq") % 5 == 0, F.substring("company", 2, 100)).otherwise(F.col("company")).alias("q_company"), F.col("period").alias("q_period"), item.alias("q_item"),
        F.when(F.col("seq") % 2 == 0, "綜合損益表").alias("q_table"), F.when(F.floor(F.col("seq") / 10) % 2 == 0, header).alias("q_header"),
    )


@query("P1 J1 P9 G1", f"""WITH {FACTS}, q AS (SELECT DISTINCT company, period FROM facts WHERE item_name LIKE '數量%')
SELECT q.company, q.period, count(f.seq) AS n_rows, count(DISTINCT f.value_raw) AS n_unique,
  CASE WHEN count(DISTINCT f.value_raw) = 1 THEN 'hit_unique' WHEN count(f.seq) = 0 THEN 'no_candidate' ELSE 'ambiguous' END AS decision,
  CASE WHEN count(DISTINCT f.value_raw) = 1 THEN min(f.value_raw) END AS answer
FROM q LEFT JOIN facts f ON q.company = f.company AND q.period = f.period AND f.item_name = '所得稅費用 Income tax expense' AND f.table_name = '資產負債表' GROUP BY ALL""")  # fmt: skip
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per company and period: its income tax in the balance sheet, if that is one value."""
    rows = facts(spark, sf_dir)
    asked = rows.where(F.col("item_name").startswith("數量")).select("company", "period").distinct()
    found = rows.where((F.col("item_name") == "所得稅費用 Income tax expense") & (F.col("table_name") == "資產負債表"))
    return relax.unique_gate(found, ["company", "period"], "value_raw", asked)


@query("P2 P3 P4 P6 P8 P9 J1", f"""WITH {QUESTIONS}, names AS (
  SELECT q_company, company FROM (SELECT DISTINCT q_company FROM questions) JOIN (SELECT DISTINCT company FROM facts) ON contains(company, q_company)
), c AS (
  SELECT *, CASE WHEN q_table IS NULL THEN FALSE ELSE contains(table_name, q_table) END AS p1 FROM questions JOIN names USING (q_company) JOIN facts USING (company)
), r1 AS (SELECT * FROM (SELECT *, bool_or(p1) OVER (PARTITION BY qid) AS a1 FROM c) WHERE p1 OR NOT a1),
t AS (SELECT *, CASE WHEN item_name = q_item THEN 1 WHEN starts_with(item_name, q_item) AND NOT regexp_matches(substr(item_name, length(q_item) + 1, 1), '[一-鿿]') THEN 2 WHEN contains(item_name, q_item) THEN 3 END AS tier FROM r1),
b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS mt FROM t WHERE tier IS NOT NULL) WHERE tier = mt AND period = q_period),
h AS (SELECT *, coalesce(column_header = q_header, FALSE) AS p2 FROM b),
r2 AS (SELECT * FROM (SELECT *, bool_or(p2) OVER (PARTITION BY qid) AS a2 FROM h) WHERE p2 OR NOT a2)
SELECT q.qid, count(r2.seq) AS n_rows, count(DISTINCT value_raw) AS n_unique,
  CASE WHEN count(DISTINCT value_raw) = 1 THEN 'hit_unique' WHEN count(r2.seq) = 0 THEN 'no_candidate' ELSE 'ambiguous' END AS decision,
  CASE WHEN count(DISTINCT value_raw) = 1 THEN min(value_raw) END AS answer, min(tier) AS tier
FROM questions q LEFT JOIN r2 ON q.qid = r2.qid GROUP BY q.qid""")  # fmt: skip
def lookup_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(facts(spark, sf_dir), "facts")  # questions, items and values all come from it
    return lookup.lookup(questions(rows), rows)


@query("P4 J11")
def lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One misspelt question per company and item, with the first period that it has: answered through the most similar item."""
    rows = kept(facts(spark, sf_dir), "facts")
    first = rows.groupBy("company", "item_name").agg(F.min("period").alias("q_period"))
    null = F.lit(None).cast("string")
    asked = first.select(F.concat_ws("|", "company", "item_name").alias("qid"), F.col("company").alias("q_company"), "q_period", F.concat(F.expr("substring(item_name, 1, length(item_name) - 2)"), F.lit("xn")).alias("q_item"), null.alias("q_table"), null.alias("q_header"))
    return lookup.lookup(asked, rows, 0.7)


@query("W5 J9", """
WITH c AS (SELECT c_custkey AS qid, c_name AS a, lag(c_name) OVER (ORDER BY c_custkey) AS b FROM customer)
SELECT qid, CASE WHEN b IS NULL THEN a ELSE b || ',' || a END AS names FROM c""")
def name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's name and the one before it in a sentence, among all names, their stems and an alias of each."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    before = c.select((F.col("code") + 1).alias("code"), F.col("name").alias("before"))
    q = c.join(before, "code", "left").select(F.col("code").alias("qid"), F.concat(F.lit("請比較 "), F.coalesce(F.concat("before", F.lit("、")), F.lit("")), "name", F.lit(" 的營收")).alias("text"))
    names = c.unionByName(c.select("code", F.substring("name", 10, 100).alias("name")))
    return lookup.scanned(q, names).select("qid", F.array_join("names", ",").alias("names"))


@query("P5 P7 P8 D8", f"""WITH {FACTS}, q AS (SELECT seq AS qid, company AS qc, item_name AS qi, period AS qp FROM (SELECT *, row_number() OVER (PARTITION BY company, item_name, period ORDER BY seq) AS rn FROM facts) WHERE rn = 1),
c AS (SELECT q.qid, qi, f.*, CASE WHEN qi LIKE '%折讓%' THEN table_name LIKE '%現金流量%' ELSE FALSE END AS p1 FROM q JOIN facts f ON f.company = qc AND f.item_name = qi AND f.period = qp),
r1 AS (SELECT * FROM (SELECT *, bool_or(p1) OVER (PARTITION BY qid) AS a1 FROM c) WHERE p1 OR NOT a1),
s AS (SELECT *, table_name LIKE '%損益%' AND right(period, 1) <> '1' AND contains(column_header, '年' || (CAST(right(period, 1) AS INT) * 3 - 2) || '月1日至') AS p2 FROM r1),
r2 AS (SELECT * FROM (SELECT *, bool_or(p2) OVER (PARTITION BY qid) AS a2 FROM s) WHERE p2 OR NOT a2)
SELECT qid, count(*) AS n_rows, count(DISTINCT value_raw) AS n_unique, min(seq) AS first_seq, max(seq) AS last_seq FROM r2 GROUP BY qid""")  # fmt: skip
def single_quarter_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    key = ["company", "item_name", "period"]
    asked = rows.groupBy(*key).agg(F.min("seq").alias("qid"))
    found = lookup.single_quarter(lookup.statement_guard(rows.join(asked, key).withColumn("q", F.col("item_name")), "q"))
    return found.groupBy("qid").agg(F.count("*").alias("n_rows"), F.count_distinct("value_raw").alias("n_unique"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("W7 L7 P9", f"""WITH {FACTS}, k AS (SELECT *, max(CAST(left(period, 3) AS INT) * 10 + CAST(right(period, 1) AS INT)) OVER (PARTITION BY company, item_name) AS top FROM facts)
SELECT company, item_name, min(period) AS disclosed_period, count(*) AS n_rows, count(DISTINCT value_raw) AS n_unique, CASE WHEN count(DISTINCT value_raw) = 1 THEN min(value_raw) END AS answer
FROM k WHERE CAST(left(period, 3) AS INT) * 10 + CAST(right(period, 1) AS INT) = top GROUP BY ALL""")  # fmt: skip
def latest_period_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.latest_period(facts(spark, sf_dir), ["company", "item_name"])
    out = found.groupBy("company", "item_name").agg(F.min("period").alias("disclosed_period"), F.count("*").alias("n_rows"), F.count_distinct("value_raw").alias("n_unique"), F.min("value_raw").alias("v"))
    return out.withColumn("answer", F.when(F.col("n_unique") == 1, F.col("v"))).drop("v")


SUMS = f"""{FACTS}, s AS (
  SELECT company, period, sum(CASE WHEN item_name LIKE '營業收入%' THEN CAST(value_number AS BIGINT) END)::BIGINT AS revenue, sum(CASE WHEN item_name LIKE '所得稅%' THEN CAST(value_number AS BIGINT) END)::BIGINT AS tax,
         sum(CASE WHEN item_name LIKE '折讓%' THEN CAST(value_number AS BIGINT) END)::BIGINT AS discount FROM facts GROUP BY ALL
)"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, tax and discount of each company and period, in one pass by conditional aggregation (no self-join)."""
    item, v = F.col("item_name"), F.col("value_number").cast("bigint")
    parts = {"revenue": "營業收入", "tax": "所得稅", "discount": "折讓"}
    return facts(spark, sf_dir).groupBy("company", "period").agg(*[F.sum(F.when(item.startswith(p), v)).alias(n) for n, p in parts.items()])


@query("J2 M1 M2 M10", f"""WITH {SUMS} SELECT company, period, CASE WHEN discount = 0 OR tax IS NULL OR discount IS NULL THEN 'not_computable' ELSE 'ok' END AS status,
  CASE WHEN discount <> 0 THEN round(CAST(tax AS DOUBLE) / CAST(discount AS DOUBLE) * 100, 2) END AS value FROM s""")  # fmt: skip
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lookup.ratio_status(F.col("tax").cast("double"), F.col("discount").cast("double"))
    return sums(spark, sf_dir).select("company", "period", status.alias("r")).select("company", "period", "r.*")


@query("M3 M4 J3 G2 M6", f"""WITH {SUMS} SELECT a.period, a.company AS a, b.company AS b,
  CASE WHEN a.revenue = b.revenue THEN '相同' WHEN a.revenue > b.revenue THEN '較高: ' || a.company ELSE '較高: ' || b.company END AS label, a.company || ': ' || a.revenue || ' ｜ ' || b.company || ': ' || b.revenue AS answer
FROM s a JOIN s b ON a.period = b.period AND CAST(substr(b.company, 2) AS INT) = CAST(substr(a.company, 2) AS INT) + 1""")  # fmt: skip
def cross_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company beside the one filed next, period by period: an equi-join on both keys."""
    s = sums(spark, sf_dir).select("period", "company", "revenue", F.expr("CAST(substring(company, 2) AS INT)").alias("no"))
    b = s.select("period", F.col("company").alias("b"), F.col("revenue").alias("y"), (F.col("no") - 1).alias("no"))
    pairs = s.withColumnsRenamed({"company": "a", "revenue": "x"}).join(b, ["period", "no"])
    label = lookup.compared(F.col("a"), F.col("x"), F.col("b"), F.col("y"))
    return pairs.select("period", "a", "b", label.alias("label"), F.concat("a", F.lit(": "), F.col("x").cast("string"), F.lit(" ｜ "), "b", F.lit(": "), F.col("y").cast("string")).alias("answer"))


@query("J4 M5 G3 M7 M8", f"""WITH {SUMS}, o AS (SELECT *, first_value(revenue) OVER w AS f, last_value(revenue) OVER w AS l, count(*) OVER (PARTITION BY company) AS n FROM s WINDOW w AS (PARTITION BY company ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT DISTINCT company, n AS n_periods, f AS first_value, l AS last_value, CASE WHEN l > f THEN '上升' WHEN l < f THEN '下降' ELSE '持平' END AS trend FROM o WHERE n >= 3""")  # fmt: skip
def cross_period_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sums(spark, sf_dir)
    out = s.groupBy("company").agg(F.count("*").alias("n_periods"), F.min_by("revenue", "period").alias("first_value"), F.max_by("revenue", "period").alias("last_value")).where("n_periods >= 3")
    return out.withColumn("trend", lookup.trend(F.col("first_value"), F.col("last_value")))


@query("W9 M6", f"""WITH {SUMS}, w AS (SELECT company, period, revenue, lead(period) OVER o AS p2, lead(period, 2) OVER o AS p3, lead(revenue) OVER o AS r2, lead(revenue, 2) OVER o AS r3 FROM s WINDOW o AS (PARTITION BY company ORDER BY period))
SELECT company, period, period || ': ' || revenue || ' ｜ ' || p2 || ': ' || r2 || ' ｜ ' || p3 || ': ' || r3 AS answer FROM w WHERE p3 IS NOT NULL AND revenue IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL""")  # fmt: skip
def three_period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("company").orderBy("period")
    s = sums(spark, sf_dir).select("company", "period", "revenue", *[F.lead(c, k).over(w).alias(f"{c[0]}{k}") for c in ("period", "revenue") for k in (1, 2)])
    parts = [F.concat(p, F.lit(": "), F.col(r).cast("string")) for p, r in (("period", "revenue"), ("p1", "r1"), ("p2", "r2"))]
    answer = F.concat(parts[0], F.lit(" ｜ "), parts[1], F.lit(" ｜ "), parts[2])  # null if any value is: all or nothing
    return s.select("company", "period", answer.alias("answer")).where("answer IS NOT NULL")


@query("A-1 A-2 A-3 F26", """
SELECT o_orderkey AS id, 'C' || o_custkey AS party, o_orderpriority AS account, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS amount,
  'value_2=C' || o_custkey || '; value_4=' || o_orderpriority || '; value_5=' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS summary, o_custkey % 2 = 0 AS even_party FROM orders""")  # fmt: skip
def kv_map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.format_number(F.round("o_totalprice").cast("bigint"), 0)
    party = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    line = F.concat(F.lit("value_2="), party, F.lit("; value_3=note; value_4="), "o_orderpriority", F.lit("; value_5="), amount)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line"), (F.col("o_custkey") % 2 == 0).alias("even_party"))
    c = F.col("line")
    return rows.select("id", maps.value_of(c, "value_2").alias("party"), maps.value_of(c, "value_4").alias("account"), maps.value_of(c, "value_5").alias("amount"), maps.summary(c).alias("summary"), "even_party")


@query("P16 P3", """
WITH q AS (SELECT c_custkey AS qid, c_nationkey AS n FROM customer), c AS (SELECT qid, s_suppkey, s_acctbal > 5000 AS p1, s_suppkey % 7 = qid % 7 AS p2 FROM q JOIN supplier ON s_nationkey = n),
a AS (SELECT * FROM (SELECT *, bool_or(p1) OVER (PARTITION BY qid) AS x FROM c) WHERE p1 OR NOT x), b AS (SELECT * FROM (SELECT *, bool_or(p2) OVER (PARTITION BY qid) AS y FROM a) WHERE p2 OR NOT y)
SELECT qid, count(*) AS n, min(s_suppkey) AS first_supplier FROM b GROUP BY qid""")  # fmt: skip
def relax_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discriminators in a row, each applied only where it leaves a candidate. Suppliers of a nation that no discriminator
    tells apart are one candidate with their number and the first of them, so questions never meet single suppliers."""
    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").alias("s_nationkey"))
    alike = read(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_acctbal") > 5000).alias("rich"), (F.col("s_suppkey") % 7).alias("rest")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))
    rows = relax.relax_filter(relax.relax_filter(q.join(alike, "s_nationkey"), ["qid"], F.col("rich")), ["qid"], F.col("rest") == F.col("qid") % 7)
    return rows.groupBy("qid").agg(F.sum("n").alias("n"), F.min("first").alias("first_supplier"))


@query("P19 D8 D9 D10", f"""WITH {FACTS}, g AS (SELECT company, period, item_name, table_name, value_raw, column_header LIKE '%年1月1日至%' AS cumulative FROM facts WHERE table_name = '綜合損益表'),
r AS (SELECT * FROM (SELECT *, bool_or(NOT cumulative) OVER (PARTITION BY company, period, item_name) AS single FROM g) WHERE NOT cumulative OR NOT single)
SELECT company, period, item_name, count(*) AS n_rows, count(DISTINCT value_raw) AS n_unique, CASE WHEN count(DISTINCT value_raw) = 1 THEN 'hit_unique' ELSE 'ambiguous' END AS decision, CASE WHEN count(DISTINCT value_raw) = 1 THEN min(value_raw) END AS answer FROM r GROUP BY ALL""")  # fmt: skip
def resolve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single quarters before cumulative columns, then the gate."""
    key = ["company", "period", "item_name"]
    rows = facts(spark, sf_dir).where("table_name = '綜合損益表'")
    return relax.unique_gate(relax.relax_filter(rows, key, ~F.col("column_header").contains("年1月1日至")), key, "value_raw")


@query("W8 U2", """
WITH f AS (SELECT o_custkey, o_orderstatus AS v, min(o_orderkey) AS s FROM orders GROUP BY ALL), a AS (SELECT o_custkey, string_agg(v, ' ｜ ' ORDER BY s) AS all_values, count(*) AS n_values FROM f GROUP BY 1),
l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_value FROM orders GROUP BY 1) SELECT * FROM a JOIN l USING (o_custkey)""")  # fmt: skip
def list_all_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    every = relax.list_all(rows, ["o_custkey"], F.col("o_orderstatus"), "o_orderkey")
    return every.join(relax.last_row(rows, ["o_custkey"], F.col("o_orderstatus"), "o_orderkey"), "o_custkey")


@query("J9 W4 F28 I2", """
WITH w AS (SELECT n_name AS word FROM nation UNION SELECT left(n_name, 3) FROM nation), q AS (SELECT s_suppkey AS qid, 'report of ' || n_name || ' and ' || s_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT qid, word, row_number() OVER (PARTITION BY qid ORDER BY length(word) DESC, word) AS rn FROM q JOIN w ON contains(text, word)) SELECT qid, word FROM h WHERE rn = 1""")  # fmt: skip
def longest_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    words = nation.select(F.col("n_name").alias("word")).union(nation.select(F.substring("n_name", 1, 3))).distinct()
    q = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    q = q.select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("report of "), "n_name", F.lit(" and "), "s_name").alias("text"))
    return checked.longest_contained(q, words, "qid", "text", "word").select("qid", "word")


@query("J10 F3 F4 Z1", """
WITH k AS (SELECT upper(replace(c_name, '#', '')) AS key, c_custkey AS code FROM customer), f AS (SELECT c_custkey AS qid, CASE c_custkey % 5 WHEN 0 THEN c_name || '股份有限公司' WHEN 1 THEN lower(c_name) || ', Co., Ltd.' WHEN 2 THEN 'Supplier#' || c_custkey WHEN 3 THEN left(c_name, length(c_name) - 1) ELSE 'Asia ' || c_name || ' (HK)' END AS filed,
  CASE c_custkey % 5 WHEN 3 THEN upper(replace(left(c_name, length(c_name) - 1), '#', '')) WHEN 4 THEN upper('Asia' || replace(c_name, '#', '') || 'HK') ELSE upper(replace(c_name, '#', '')) END AS key FROM customer)
SELECT qid, filed, CASE WHEN qid % 5 < 2 THEN qid WHEN qid % 5 = 2 THEN NULL ELSE (SELECT min(code) FROM k WHERE contains(k.key, f.key) OR contains(f.key, k.key)) END AS code,
  CASE WHEN qid % 5 = 2 THEN 'no_company' WHEN qid % 5 < 2 THEN 'resolved' ELSE 'resolved_in_part' END AS status FROM f""")  # fmt: skip
def company_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings joined to companies on the normalised name, equal or one within the other."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat("c_name", F.lit("股份有限公司"))).when(k % 5 == 1, F.concat(F.lower("c_name"), F.lit(", Co., Ltd."))).when(k % 5 == 2, F.concat(F.lit("Supplier#"), k.cast("string")))
    name = name.when(k % 5 == 3, F.expr("left(c_name, length(c_name) - 1)")).otherwise(F.concat(F.lit("Asia "), "c_name", F.lit(" (HK)")))
    asked = c.select(k.alias("qid"), name.alias("filed"))
    known = c.select(texts.company_key(F.col("c_name")).alias("key"), k.alias("code"))
    found = lookup.company_codes(asked.select("qid", texts.company_key(F.col("filed")).alias("name")), known)
    status = F.when(F.col("code").isNull(), "no_company").when(F.col("tier") == 1, "resolved").otherwise("resolved_in_part")
    return asked.join(found, "qid", "left").select("qid", "filed", "code", status.alias("status"))


@query("J17 N6", f"""WITH {FACTS}, c AS (SELECT printf('%.4f', value_number) AS key, count(*) AS n_cells, min(seq) AS first_seq FROM facts WHERE value_raw <> '-' GROUP BY 1)
SELECT o_orderkey AS id, n_cells, first_seq FROM orders JOIN c ON printf('%.4f', round(o_totalprice)) = key""")  # fmt: skip
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers traced back to the cells that print their value, by a normalised key aggregated before the join."""
    from ledgerloom.functions.numbers import number_key

    cells = facts(spark, sf_dir).where("value_raw != '-'").groupBy(number_key(F.col("value_raw")).alias("key")).agg(F.count("*").alias("n_cells"), F.min("seq").alias("first_seq"))
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("%.4f", F.round("o_totalprice")).alias("key"))
    return asked.join(cells, "key").select("id", "n_cells", "first_seq")
