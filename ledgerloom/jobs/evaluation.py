"""Jobs of evaluation, statistics, audits and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import periods
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import FACTS, facts, read
from ledgerloom.operators import evaluate, routing
from ledgerloom.operators.facts import current_view

ANSWERS = """a AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_orderstatus AS mode, o_custkey AS k, CAST(round(o_totalprice) AS BIGINT) AS v, o_orderkey % 5 AS c FROM orders),
s AS (SELECT *, c <> 3 AS em, c = 3 AS refusal FROM a)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, mode, k, answer, gold: answers in several spellings; every fifth refuses."""
    c, v = F.col("o_orderkey") % 5, F.round("o_totalprice").cast("bigint")
    digits = F.format_number(v, 0)
    answer = F.when(c == 0, digits).when(c == 1, F.concat(F.lit("<think>x</think> "), v.cast("string"))).when(c == 2, F.concat(F.lit("( "), digits, F.lit(" )"))).when(c == 3, "找不到符合條件的資料").otherwise("b;a")
    gold = F.when(c == 2, F.concat(F.lit("-"), v.cast("string"))).when(c == 4, "a;b").otherwise(v.cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("mode"), F.col("o_custkey").alias("k"), answer.alias("answer"), gold.alias("gold"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, g = F.col("answer"), F.col("gold")
    return answers(spark, sf_dir).withColumns({"em": evaluate.exact(a, g), "refusal": evaluate.refused(a)})


@query("E1 E6 E10 F18 P20 F19", f"WITH {ANSWERS} SELECT id, em, refusal FROM s")
def em_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "em", "refusal")


@query("E1 E10", f"""WITH {ANSWERS} SELECT id, c = 1 AS numeric, c IN (1, 2) AS contains, c IN (0, 1, 2) AS partial FROM s""")
def number_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and gold compared by the numbers in them: one of two, both, both and another, none, and gold without any."""
    c, k = F.col("id") % 5, F.lit(" of 7.5")
    v = F.format_number(F.col("v"), 0)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("bigint").alias("v"))
    answer = F.when(c == 0, v).when(c == 1, F.concat(F.lit("7.5 and "), v)).when(c == 2, F.concat(v, k, F.lit(" since 0.5"))).when(c == 3, "none").otherwise("12")
    gold = F.when(c == 4, "no number").otherwise(F.concat(F.col("v").cast("string"), k))
    return rows.select("id", *[x.alias(n) for n, x in evaluate.number_matches(answer, gold).items()])


@query("E7 G4 G5 G6 G8 G9", f"""WITH {ANSWERS}, t AS (SELECT kind, mode, em, refusal, c IN (0, 1, 2) AS contains, c IN (1, 3) AS fallback, CAST(k % 100 AS DOUBLE) AS seconds FROM s),
r AS (SELECT kind, mode, count(*) AS n, count(*) FILTER (WHERE em) AS n_right, count(*) FILTER (WHERE refusal) AS n_refused, count(*) FILTER (WHERE contains) AS n_contains, count(*) FILTER (WHERE fallback) AS n_fallback,
  count(*) FILTER (WHERE em AND fallback) AS rf, count(*) FILTER (WHERE em AND NOT fallback) AS rs, min(seconds) AS least_seconds, round(avg(seconds), 4) AS mean_seconds, max(seconds) AS most_seconds FROM t GROUP BY ROLLUP (kind, mode)),
q AS (SELECT *, n - n_refused AS n_answered, round(n_right::DOUBLE / nullif(n - n_refused, 0), 4) AS precision, round(n_right::DOUBLE / n, 4) AS recall, round(n_contains::DOUBLE / n, 4) AS contains_rate,
  round(rf::DOUBLE / nullif(n_fallback, 0), 4) AS fallback_em, round(rs::DOUBLE / nullif(n - n_fallback, 0), 4) AS stable_em, n_right::DOUBLE / nullif(n - n_refused, 0) AS p, n_right::DOUBLE / n AS r FROM r)
SELECT kind, mode, n, n_right, n_refused, n_contains, n_fallback, least_seconds, mean_seconds, most_seconds, n_answered, precision, recall, contains_rate, fallback_em, stable_em,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(stable_em - fallback_em, 4) AS stability_gap FROM q""")  # fmt: skip
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and mode, per kind, and overall, in one pass; answers after think-blocks and refusals count as fallbacks."""
    rows = scored(spark, sf_dir).withColumn("contains", evaluate.number_matches(F.col("answer"), F.col("gold"))["contains"])
    rows = rows.withColumns({"fallback": F.col("refusal") | F.col("answer").contains("<think>"), "seconds": (F.col("k") % 100).cast("double")})
    return evaluate.report(rows, "kind", "mode")


@query("G7 E5 W10", """
WITH r AS (SELECT o_orderpriority AS kind, l_orderkey AS id, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END DESC) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT kind, id, round(sum(CASE WHEN k <= 5 THEN g / log2(k + 1) ELSE 0 END) / nullif(sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END), 0), 6) AS ndcg, min(CASE WHEN g > 0 THEN k END) AS hit FROM r GROUP BY ALL)
SELECT kind, count(*) AS n, round(avg(CASE WHEN hit <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_1, round(avg(CASE WHEN hit <= 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_3, round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_5,
  round(CAST(sum(CAST(coalesce(ndcg, 0) AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS ndcg_5, round(CAST(sum(CAST(coalesce(round(1.0::DOUBLE / hit, 6), 0) AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS mrr FROM s GROUP BY kind""")  # fmt: skip
def ranking_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@k, NDCG@5 and MRR of the lines of orders as ranked lists, per kind of order; exact sums of six decimals."""
    grade = F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0)
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", grade.alias("g")))).alias("r"))
    g = F.transform("r", lambda x: x["g"])
    rows = lines.select("o_orderkey", F.round(evaluate.ndcg(g, 5), 6).cast("decimal(18,6)").alias("ndcg"), F.round(evaluate.reciprocal_rank(g), 6).cast("decimal(18,6)").alias("rr"))
    rows = rows.join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind")), "o_orderkey")
    hit = lambda k: F.round(F.avg(F.when(F.col("rr") >= round(1 / k, 6) - 1e-6, 1.0).otherwise(0.0)), 4).alias(f"hit_{k}")
    mean = lambda c, name: F.round(F.sum(c).cast("double") / F.count("*"), 4).alias(name)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), *[hit(k) for k in (1, 3, 5)], mean("ndcg", "ndcg_5"), mean("rr", "mrr"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    both = t.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).join(nxt.groupBy("conv_id", "turn").agg(F.min("gold").alias("gold")), ["conv_id", "turn"])
    return both.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "gold")


ROUGE = r"""
WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), p AS (SELECT a.conv_id || '-' || a.turn AS id, list_filter(regexp_split_to_array(lower(a.text), '\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '') AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
u AS (SELECT id, 0 AS side, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM p UNION ALL SELECT id, 1, unnest(y), generate_subscripts(y, 1) FROM p),
l AS (SELECT id, side, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY id, side ORDER BY i)),
m AS (SELECT id, side, 1 AS n, w AS gram FROM l UNION ALL SELECT id, side, 2, w || ' ' || w2 FROM l WHERE w2 IS NOT NULL UNION ALL SELECT id, side, 3, w || ' ' || w2 || ' ' || w3 FROM l WHERE w3 IS NOT NULL),
g AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM m GROUP BY ALL), c AS (SELECT id, n, sum(least(a, b)) AS o, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
s AS (SELECT p.id, k.n, coalesce(o::DOUBLE / nullif(a, 0), 0) AS p, coalesce(o::DOUBLE / nullif(b, 0), 0) AS r FROM p CROSS JOIN (VALUES (1), (2), (3)) k(n) LEFT JOIN c ON c.id = p.id AND c.n = k.n)
SELECT id, n, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f FROM s"""


@query("E2 G19 U7", ROUGE)
def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the next, by runs of one, two and three words."""
    return evaluate.rouge(_turns(spark, sf_dir), "id", "text", "gold", 1, 2, 3)


@query("E2 G19", f"SELECT id, precision, recall, f FROM ({ROUGE}) WHERE n = 2")
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by runs of two words only."""
    return evaluate.rouge(_turns(spark, sf_dir), "id", "text", "gold", 2).drop("n")


@query("E4 E5 W10 E14", """
WITH r AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END DESC) AS b FROM lineitem),
s AS (SELECT id, sum(CASE WHEN k <= 5 THEN g / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS best, min(CASE WHEN g > 0 THEN k END) AS hit FROM r GROUP BY id)
SELECT id, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 4) AS ndcg, round(CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / hit END, 4) AS rr, coalesce(hit <= 3, FALSE) AS hit_3 FROM s""")  # fmt: skip
def ndcg_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0)
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", grade.alias("g")))).alias("r"))
    g = F.transform("r", lambda x: x["g"])
    rr = evaluate.reciprocal_rank(g)
    return rows.select("id", F.round(evaluate.ndcg(g, 5), 4).alias("ndcg"), F.round(rr, 4).alias("rr"), (rr > 0.3).alias("hit_3"))


@query("E12 Z34", """
WITH s AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS k FROM customer GROUP BY 1), w AS (SELECT *, k::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM s)
SELECT nation, n, k, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 1), 6) AS high FROM w""")  # fmt: skip
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return s.select("nation", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("E11")
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    return s.select("nation", "n", "k", evaluate.clopper_pearson("k", "n").alias("ci")).select("nation", "n", "k", "ci.*")


@query("E13 G16 Z39", """
WITH t AS (SELECT o_orderpriority, o_totalprice > 200000 AS a, o_orderstatus = 'F' AS b FROM orders),
n AS (SELECT o_orderpriority, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM t GROUP BY 1),
s AS (SELECT o_orderpriority, only_a + only_b AS m, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM n),
p AS (SELECT o_orderpriority, round(least(1.0, 2 * sum(exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) - m * ln(2.0)))), 6) AS p FROM s GROUP BY 1)
SELECT n.*, p FROM n JOIN p USING (o_orderpriority)""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graders of the orders of each priority, their 2 x 2 table and the exact test."""
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") > 200000).alias("a"), (F.col("o_orderstatus") == "F").alias("b"))
    return evaluate.discordant(rows, ["o_orderpriority"], "a", "b").withColumn("p", F.round(evaluate.mcnemar("only_a", "only_b"), 6))


@query("G21 J16 Z46", """
WITH a AS (SELECT o_orderkey AS id, o_totalprice > 200000 AS r FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS r FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN a.r IS NULL THEN 'new' WHEN b.r IS NULL THEN 'gone' WHEN a.r AND b.r THEN 'right' WHEN a.r THEN 'right→wrong' WHEN b.r THEN 'wrong→right' ELSE 'wrong' END AS flip, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")  # fmt: skip
def run_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 200000).alias("a"))
    b = o.where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("b"))
    flip = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") & F.col("b"), "right").when(F.col("a"), "right→wrong").when(F.col("b"), "wrong→right").otherwise("wrong")
    return a.join(b, "id", "full").groupBy(flip.alias("flip")).agg(F.count("*").alias("n"))


@query("E9 G15 U4 Z41", """
WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS g, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus <> 'P'))) AS a FROM orders GROUP BY 1),
h AS (SELECT o_custkey, g, coalesce(a, []) AS a FROM g)
SELECT o_custkey, g = a AS set_em, round(len(list_intersect(g, a))::DOUBLE / len(g), 4) AS coverage, len(list_filter(g, lambda x: NOT list_contains(a, x)))::INT AS missing FROM h""")  # fmt: skip
def set_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are lists: equal as sets, the share of the gold that is covered, and what is missing."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("g"), F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))).alias("a"))
    return o.select("o_custkey", (F.col("g") == F.col("a")).alias("set_em"), F.round(F.size(F.array_intersect("g", "a")) / F.size("g"), 4).alias("coverage"), F.size(F.array_except("g", "a")).alias("missing"))


@query("D1 D2 D3 D5 D6 D7 D11 J15 §2.22", f"""WITH {FACTS}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, item_name, period ORDER BY CASE WHEN column_header LIKE '%至%' THEN 1 ELSE 0 END DESC, CAST(left(column_header, 4) AS INT) DESC, seq) AS rn FROM facts) WHERE rn = 1),
u AS (SELECT company, item_name, period, count(DISTINCT value_raw) AS n_unique FROM facts WHERE table_name = '綜合損益表' AND column_header NOT LIKE '%年1月1日至%' GROUP BY ALL),
a AS (SELECT v.company, v.item_name, v.period, v.seq // 10 % 8 AS k, coalesce(n_unique, 0) AS n_unique FROM v LEFT JOIN u USING (company, item_name, period))
SELECT company, item_name, period, CASE WHEN k = 0 THEN 'D3 corrupt gold' WHEN k = 6 THEN 'D6 item name mismatch' WHEN k = 7 THEN 'D7 prior-period source' WHEN k = 1 THEN 'D11 row index in question' WHEN n_unique = 0 THEN 'D1 not in corpus' WHEN n_unique > 1 THEN 'D5 ambiguous row' WHEN k IN (2, 3) THEN 'ok' WHEN k = 4 THEN 'D2 wrong column' ELSE 'D1 not in corpus' END AS defect FROM a""")  # fmt: skip
def gold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers of the current view, most spoilt on purpose, against single-quarter income statements."""
    rows = facts(spark, sf_dir)
    key = ["company", "item_name", "period"]
    corpus = rows.where((F.col("table_name") == "綜合損益表") & ~F.col("column_header").contains("年1月1日至"))
    found = corpus.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct("value_raw").alias("n_unique"), F.min("value_raw").alias("found"))
    k = F.floor(F.col("seq") / 10) % 8
    gold = current_view(rows).join(found, key, "left").fillna(0, ["n_rows", "n_unique"])
    asked = F.when(k == 1, "公司的【7】中，數值為何").otherwise(F.concat_ws(" ", *key))
    prior = F.lit("123,456,789")
    printed = F.when(k == 0, "value_2=1; value_3=2").when(k.isin(1, 2, 3), F.coalesce("found", F.lit("1"))).when(k == 4, prior).otherwise("987,654,321")
    item, source = F.when(k == 6, evaluate.BROKEN_ITEMS[0]).otherwise(F.col("item_name")), F.when(k == 7, F.concat(F.lit("去年同期"), "table_name")).otherwise(F.col("table_name"))
    # A dash is no number: such gold is written as zero on both sides.
    code = evaluate.audit_code(F.when(printed == "-", "0").otherwise(printed), asked, item, source, F.col("n_rows"), F.col("n_unique"), F.when(F.col("found") == "-", "0").otherwise(F.col("found")), prior)
    return gold.select(*key, code.alias("defect"))


@query("D4 D2", f"""WITH {FACTS}, s AS (SELECT company, period, CAST(left(period, 3) AS INT) + 1911 AS y, CAST(sum(value_number) AS BIGINT) AS v FROM facts WHERE item_name LIKE '營業收入%' GROUP BY ALL),
p AS (SELECT company, period, y, v, lead(y) OVER w AS y2, lead(v) OVER w AS v2, lead(period) OVER w AS period2 FROM s WINDOW w AS (PARTITION BY company ORDER BY period))
SELECT company, period, period2, CASE WHEN v % 4 = 0 AND y <> y2 THEN 'D4 same value for two periods' WHEN v % 4 = 1 AND v <> v2 THEN 'D4 same value for two periods' WHEN v % 4 = 2 THEN 'D2 wrong column' ELSE 'ok' END AS defect FROM p WHERE period2 IS NOT NULL""")  # fmt: skip
def audit_two_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenues of neighbouring periods as gold: with one column for both, the first value twice, a wrong second value, or right."""
    sums_ = facts(spark, sf_dir).where(F.col("item_name").startswith("營業收入")).groupBy("company", "period").agg(F.sum(F.col("value_number").cast("bigint")).alias("v"))
    w = Window.partitionBy("company").orderBy("period")
    rows = sums_.withColumns({"period2": F.lead("period").over(w), "v2": F.lead("v").over(w)}).where("period2 IS NOT NULL")
    year = lambda c: periods.fiscal_year(F.col(c)) + periods.ROC
    k, printed = F.col("v") % 4, lambda c: F.format_number(F.col(c), 0)
    header = F.when(k == 0, year("period"))
    second = F.when(k == 1, printed("v")).when(k == 2, F.format_number(F.col("v") + F.col("v2") + 1, 0)).otherwise(printed("v2"))
    defect = evaluate.two_period_defect(header, (year("period"), year("period2")), (printed("v"), second), (printed("v"), printed("v2")))
    return rows.select("company", "period", "period2", defect.alias("defect"))


@query("D9 M10", """
WITH r AS (SELECT s_suppkey AS id, s_name AS a, CAST(round(s_acctbal) AS BIGINT) AS n, s_suppkey % 7 + 3 AS d FROM supplier), p AS (SELECT x.id, x.a, y.a AS b, round(x.n::DOUBLE / x.d * 100, 2) AS r1, round(y.n::DOUBLE / y.d * 100, 2) AS r2 FROM r x JOIN r y ON y.id = x.id + 1)
SELECT id, CASE WHEN id % 4 = 1 THEN 'D9 arithmetic' WHEN id % 4 = 3 THEN 'D9 winner' WHEN r1 = r2 THEN 'D9 no winner' ELSE 'ok' END AS defect FROM p""")  # fmt: skip
def audit_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of each supplier and the next: some with a wrong ratio, some with the loser as winner. Two may bear one name, so keys tell who won."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    r = s.select(k.alias("id"), k.alias("a"), F.round("s_acctbal").cast("bigint").cast("double").alias("n"), (k % 7 + 3).cast("double").alias("d"))
    p = r.join(r.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"), F.col("n").alias("n2"), F.col("d").alias("d2")), "id")
    r1, r2, k = F.round(F.col("n") / F.col("d") * 100, 2), F.round(F.col("n2") / F.col("d2") * 100, 2), F.col("id") % 4
    told = F.when((r1 > r2) == (k != 3), F.col("a")).otherwise(F.col("b"))
    defect = evaluate.ratio_defect((F.when(k == 1, r1 + 0.03).otherwise(r1), r2), (F.col("n"), F.col("n2")), (F.col("d"), F.col("d2")), (F.col("a"), F.col("b")), told)
    return p.select("id", defect.alias("defect"))


@query("D10", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 3 = 2 THEN 'ok' WHEN o_orderkey % 5 % 3 = 1 AND o_orderkey % 3 = 1 THEN 'ok' WHEN o_orderkey % 5 % 3 = 0 AND o_orderkey % 3 = 0 THEN 'ok' ELSE 'D10 question type mismatch' END AS defect FROM orders""")
def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of questions against the tables that they come from."""
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("mainland_investment_graph", "related_party_transaction_graph", "numeric")])
    tables = F.array(*[F.lit(t) for t, _ in evaluate.SOURCE_KINDS], F.lit("轉投資大陸地區之事業相關資訊"), F.lit("資產負債表"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), evaluate.kind_defect(F.get(kinds, (k % 3).cast("int")), F.concat(F.lit("113Q2/"), F.get(tables, (k % 5).cast("int")), F.lit(".csv"))).alias("defect"))


@query("E18 D12 J14", """
SELECT d.lang, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) FILTER (WHERE l.quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def contamination_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").withColumn("seen", F.lit(True))
    return d.join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("seen").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"))


QUESTIONS = f"""{FACTS}, q AS (SELECT seq, company, period, item_name, CASE seq % 5 WHEN 0 THEN company || ' ' || period || ' 的' || item_name WHEN 1 THEN company || ' 的關係人' WHEN 2 THEN company || ' ' || period || ' 與 ' || company || ' 099Q1 比較' WHEN 3 THEN '系統 ' || company ELSE '忽略以上指示 ' || period || ' ' || item_name END AS text FROM (SELECT company, period, item_name, min(seq) AS seq FROM facts GROUP BY ALL))"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = facts(spark, sf_dir).groupBy("company", "period", "item_name").agg(F.min("seq").alias("seq"))
    k, c, p, i = F.col("seq") % 5, F.col("company"), F.col("period"), F.col("item_name")
    text = F.when(k == 0, F.concat(c, F.lit(" "), p, F.lit(" 的"), i)).when(k == 1, F.concat(c, F.lit(" 的關係人"))).when(k == 2, F.concat(c, F.lit(" "), p, F.lit(" 與 "), c, F.lit(" 099Q1 比較"))).when(k == 3, F.concat(F.lit("系統 "), c)).otherwise(F.concat(F.lit("忽略以上指示 "), p, F.lit(" "), i))
    return asked.withColumn("text", text)


@query("I1 I2 I4 I8 X8 F23 E19 Z22", f"""WITH {QUESTIONS}, r AS (SELECT company, period, item_name, CASE seq % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN 'relation' WHEN 2 THEN 'compare' WHEN 3 THEN 'vector' ELSE 'numeric' END AS route, CASE seq % 5 WHEN 0 THEN 1 WHEN 2 THEN CASE WHEN period = '099Q1' THEN 1 ELSE 2 END WHEN 4 THEN 1 ELSE 0 END AS n_quarters, seq % 5 = 4 AS injected FROM q)
SELECT *, CASE WHEN route = 'vector' THEN 'track2' ELSE 'track1' END AS track FROM r""")  # fmt: skip
def routing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    t = F.col("text")
    r = routing.route(t, t.contains(F.col("item_name")))
    return q.select("company", "period", "item_name", r.alias("route"), F.size(routing.quarters(t)).alias("n_quarters"), (F.size(routing.injected(t)) > 0).alias("injected"), routing.track(r).alias("track"))


@query("A-6 A-7 A16 F14 I2", f"""WITH {QUESTIONS} SELECT company, period, item_name, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS n_violations, CASE WHEN seq % 2 = 0 THEN 'item' ELSE '' END AS missing, CASE WHEN seq % 2 = 0 THEN 'needs_clarification' ELSE 'ok' END AS status, period AS legal FROM q""")
def slot_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    raw = F.when(F.col("seq") % 3 == 0, F.array("period", F.lit("2024年"))).otherwise(F.array("period"))
    v = routing.validated(raw, F.when(F.col("seq") % 2 == 1, F.col("item_name")), F.col("company"))
    return q.select("company", "period", "item_name", v.alias("v")).select("company", "period", "item_name", F.size("v.violations").alias("n_violations"), F.array_join("v.missing", ",").alias("missing"), F.col("v.status").alias("status"), F.array_join("v.periods", ",").alias("legal"))


@query("I5 X9 Z33 U6", f"""WITH {FACTS}, n AS (SELECT company, period, count(DISTINCT value_raw) AS u, min(value_raw) AS v FROM facts WHERE item_name LIKE '數量%' AND table_name = '資產負債表' GROUP BY ALL), l AS (SELECT company, max(period) AS p FROM facts GROUP BY 1), k AS (SELECT DISTINCT company, period FROM facts)
SELECT k.company, k.period, CASE WHEN u = 1 THEN 'direct_lookup' WHEN u > 1 THEN 'refuse_ambiguous' WHEN period = p THEN 'latest_period' ELSE 'refuse_no_candidate' END AS answer_mode, CASE WHEN u = 1 THEN v END AS answer FROM k LEFT JOIN n USING (company, period) JOIN l USING (company)""")  # fmt: skip
def answer_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages joined by question; the first that answers, or the typed refusal, decides."""
    rows = facts(spark, sf_dir)
    direct = rows.where(F.col("item_name").startswith("數量") & (F.col("table_name") == "資產負債表")).groupBy("company", "period").agg(F.count_distinct("value_raw").alias("u"), F.min("value_raw").alias("v"))
    last = rows.groupBy("company").agg(F.max("period").alias("p"))
    q = rows.select("company", "period").distinct().join(direct, ["company", "period"], "left").join(last, "company")
    mode = F.when(F.col("u") == 1, "direct_lookup").when(F.col("u") > 1, "refuse_ambiguous").when(F.col("period") == F.col("p"), "latest_period").otherwise("refuse_no_candidate")
    return q.select("company", "period", mode.alias("answer_mode"), F.when(F.col("u") == 1, F.col("v")).alias("answer"))
