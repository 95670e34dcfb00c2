"""Jobs on the graph of the order tables: suppliers, parts, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import texts
from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import read
from ledgerloom.operators import graph, relax

SUPPLIES = """e AS (SELECT DISTINCT 'supplier:' || l_suppkey AS source, 'customer:' || o_custkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, edge_id: which supplier delivers to which customer."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    return pairs.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target"), F.concat_ws(">", "l_suppkey", "o_custkey").alias("edge_id"),
    )


@query("G11 A10 F5 Z17", """
WITH r AS (SELECT 'company:' || o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS note, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders)
SELECT id, arg_min(note, seq) FILTER (WHERE trim(note) <> '') AS note, arg_min(status, seq) FILTER (WHERE trim(status) <> '') AS status FROM r GROUP BY id""")  # fmt: skip
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("company:"), F.col("o_custkey").cast("string")).alias("id"), k.alias("seq"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("note"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("status"),
    )
    return graph.merge_nodes(rows, ["note", "status"])


@query("G12 A11 A12", """
WITH f AS (SELECT o_custkey, o_orderpriority, o_orderstatus AS s, min(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey AS source, o_orderpriority AS type, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(s, ';' ORDER BY k) AS source_csv FROM f GROUP BY ALL""")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("source_csv"), F.col("o_orderkey").alias("seq"))
    return graph.merge_edges(rows, ["source", "type"], "source_csv")


@query("J5 J6 U1", f"""WITH {SUPPLIES}, a AS (SELECT c_nationkey AS nation, 'customer:' || c_custkey AS id FROM customer UNION SELECT s_nationkey, 'supplier:' || s_suppkey FROM supplier),
h AS (SELECT nation, source, target FROM e JOIN a ON source = id UNION SELECT nation, source, target FROM e JOIN a ON target = id)
SELECT nation, source, target, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, substr(source, 10)) AS source_name FROM h LEFT JOIN supplier ON source = 'supplier:' || s_suppkey""")  # fmt: skip
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges around the companies of each nation, with names; every second supplier is without one."""
    suppliers = read(spark, sf_dir, "supplier")
    sid = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id")
    nodes = suppliers.select(sid, F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return graph.named(graph.hops_of(supplies(spark, sf_dir), _companies(spark, sf_dir), "nation"), nodes, "source").select("nation", "source", "target", "source_name")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, id of all suppliers and customers."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return customers.union(read(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))))


@query("J7 U3 R14", f"""WITH {SUPPLIES}, a AS (SELECT s_nationkey AS nation, 'supplier:' || s_suppkey AS id FROM supplier), h1 AS (SELECT DISTINCT nation, target AS id FROM e JOIN a ON source = id),
h2 AS (SELECT DISTINCT h1.nation, source AS id FROM e JOIN h1 ON target = h1.id WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.nation = h1.nation AND a.id = source))
SELECT nation, id, 1 AS hop FROM h1 UNION ALL SELECT nation, id, 2 FROM h2""")  # fmt: skip
def subgraph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes one and two hops from the suppliers of each nation."""
    edges = supplies(spark, sf_dir)
    anchors = _companies(spark, sf_dir).where("id LIKE 'supplier:%'")
    first = graph.neighbours_of(edges, anchors, "nation")
    second = graph.neighbours_of(edges, first, "nation").join(anchors, ["nation", "id"], "left_anti")
    return first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))


@query("R13", """
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT x.a, y.b AS c, count(*) AS n_middles, min(x.b) AS least FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM e z WHERE z.a = x.a AND z.b = y.b) GROUP BY ALL""")
def two_hop_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indirect holdings: a holds some b that holds c, and a does not hold c itself; over how many, and the least of them."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).where("source != target")
    return graph.indirect(edges).groupBy("a", "c").agg(F.count("*").alias("n_middles"), F.min("b").alias("least"))


@query("Q3 Q17", """
SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50) AS large,
  (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS neighbours FROM supplier""")
def optional_match_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three optional patterns per supplier, each counted by itself."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey", "l_orderkey", "l_returnflag", "l_quantity")
    near = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("value"))
    out = graph.profile(s, "s_suppkey", returned=lines.where("l_returnflag = 'R'").select("s_suppkey", F.col("l_partkey").alias("value")), large=lines.where("l_quantity = 50").select("s_suppkey", F.col("l_orderkey").alias("value")))
    return graph.profile(out, "s_nationkey", neighbours=near).drop("s_nationkey")


@query("Q6 Q13 Q16 G13 J18", f"""WITH {SUPPLIES} SELECT target AS customer, count(DISTINCT source) AS n_suppliers, string_agg(DISTINCT source, ',' ORDER BY source) AS suppliers FROM e GROUP BY 1 HAVING count(DISTINCT source) > 3""")
def shared_party_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplies(spark, sf_dir)  # distinct already, so plain counts suffice
    return e.groupBy(F.col("target").alias("customer")).agg(F.count("*").alias("n_suppliers"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("suppliers")).where("n_suppliers > 3")


@query("Q9 Q12 Q4 G2", """
SELECT r_name AS stage, n_name AS segment, s_name AS company FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage to segment to company: the small levels are joined first, the large one is filtered at the scan."""
    upper = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return s.join(upper, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("stage"), F.col("n_name").alias("segment"), F.col("s_name").alias("company"))


@query("Q7 Q11 L9 Q1 Q2", """
WITH g AS (SELECT p_brand, p_type, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) AS book FROM part WHERE p_size <> 15 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY book DESC, p_type) AS INT) AS rank FROM g)
SELECT p_brand, p_type, n, book, rank FROM r WHERE rank <= 5""")  # fmt: skip
def group_stats_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "part").where("p_size != 15").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(F.col("p_retailprice").cast("decimal(18,4)")).cast("double").alias("book"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("book"), "p_type"))
    return g.withColumn("rank", rank).where("rank <= 5")


RULES = (
    {"name": "供應鏈壓力", "level": "strong", "any": ["STEEL", "COPPER", "TIN"], "exclude": ["SMALL"]},
    {"name": "營運資金壓力", "level": "medium", "all": [["ECONOMY", "STANDARD"], ["BRASS", "NICKEL"]]},
    {"name": "匯率風險", "level": "weak", "any": ["PROMO"]},
)


@query("J12 P12 A-9 A13 J8 Z15 Z16", """
WITH t AS (SELECT p_partkey AS id, upper(p_type || ' ' || p_name) AS x FROM part), m AS (
 SELECT id, '供應鏈壓力' AS risk, 'strong' AS level, list_sort(list_filter(['COPPER', 'STEEL', 'TIN'], lambda w: contains(x, w))) AS k FROM t WHERE NOT contains(x, 'SMALL') AND (contains(x, 'STEEL') OR contains(x, 'COPPER') OR contains(x, 'TIN'))
 UNION ALL SELECT id, '營運資金壓力', 'medium', list_sort(list_filter(['BRASS', 'ECONOMY', 'NICKEL', 'STANDARD'], lambda w: contains(x, w))) FROM t WHERE (contains(x, 'ECONOMY') OR contains(x, 'STANDARD')) AND (contains(x, 'BRASS') OR contains(x, 'NICKEL'))
 UNION ALL SELECT id, '匯率風險', 'weak', ['PROMO'] FROM t WHERE contains(x, 'PROMO'))
SELECT id, risk, level, array_to_string(k, ';') AS keywords FROM m""")  # fmt: skip
def risk_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("text"))
    found = rows.select("id", F.inline(graph.matched_rules(F.col("text"), RULES)))
    return found.select("id", F.col("name").alias("risk"), "level", F.array_join("keywords", ";").alias("keywords"))


@query("W8", """
WITH c AS (SELECT c_custkey AS qid, o_orderkey, o_orderpriority, o_totalprice, o_orderstatus = 'O' AS p FROM customer JOIN orders ON c_custkey = o_custkey),
r AS (SELECT * FROM (SELECT *, bool_or(p) OVER (PARTITION BY qid) AS a FROM c) WHERE p OR NOT a)
SELECT qid, count(*) AS n_candidates, arg_max(o_orderpriority, o_orderkey) AS answer, 'L0-investee' AS layer FROM r GROUP BY qid""")
def relation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer, the open ones where there are any, and the one disclosed last."""
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = relax.relax_filter(edges, ["qid"], F.col("o_orderstatus") == "O")
    return rows.groupBy("qid").agg(F.count("*").alias("n_candidates"), F.max_by("o_orderpriority", "o_orderkey").alias("answer")).withColumn("layer", F.lit("L0-investee"))


@query("J18", """
WITH t AS (SELECT l_suppkey AS payer, o_custkey AS party, l_returnflag AS account, l_extendedprice AS amount, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT *, count(*) OVER (PARTITION BY payer, party, account) AS n FROM t)
SELECT payer, party, account, seq, CAST(round(amount) AS BIGINT) AS amount FROM u WHERE n = 1""")
def related_party_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that payer, counterparty and account determine, by one aggregation instead of a self-join."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("l_suppkey").alias("payer"), F.col("o_custkey").alias("party"), F.col("l_returnflag").alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.round("l_extendedprice").cast("bigint").alias("amount"))
    return rows.groupBy("payer", "party", "account").agg(F.min("seq").alias("seq"), F.min("amount").alias("amount"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("S13 S14 W6 U5", """
WITH c AS (SELECT r_name, n_name, s_name, s_suppkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey)
SELECT r_name AS stage, n_name AS segment, s_suppkey AS code, s_name AS company FROM c""")
def outline_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an outline (stage, segment, company) and what each company line inherits from the lines above it."""
    from ledgerloom.sources.outline import carry_forward

    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    n = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    place = lambda a, b, c: F.format_string("%06d.%06d.%09d", a, b, c)
    zero = F.lit(0)
    lines = n.select(F.col("r_name").alias("doc"), place(F.col("r_regionkey"), F.col("n_nationkey"), zero).alias("line_no"), F.concat(F.lit("("), "n_name", F.lit(")")).alias("line"))
    lines = lines.union(r.select("r_name", place(F.col("r_regionkey"), zero - 1, zero), F.concat(F.lit("["), "r_name", F.lit("]"))))
    s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = lines.union(s.select("r_name", place(F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey") + 1), F.concat_ws(" ", "s_suppkey", "s_name")))
    return carry_forward(lines, "doc", "line_no", "line").select("stage", "segment", F.col("code").cast("bigint").alias("code"), "company")


@query("J14 E18 U5", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)""")
def exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a key of either family of exclusions: one anti-join each."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    seen = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    bad = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return c.join(seen, "c_custkey", "left_anti").join(bad, "c_nationkey", "left_anti").select("c_custkey")


@query("G22 W4 §2.23", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('seed-3:' || o_orderkey), o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn <= 2""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of each customer by a seeded hash: the same draw wherever and however often it runs."""
    order = [F.md5(F.concat(F.lit("seed-3:"), F.col("o_orderkey").cast("string"))), F.col("o_orderkey")]
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("rn", rank).where("rn <= 2").drop("rn")


@query("G18 J18", """
WITH v AS (SELECT p_brand, p_size, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_size, p_partkey FROM v WHERE n = 1""")
def values_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that identify a row within their group."""
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("F2 F5 F16 F17 F8", """
SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS slug, upper(replace(s_name, '#', '')) AS key, '［＿公司＿］' AS masked, 'abc(' || lower(s_name) || ')' AS folded FROM supplier""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    whole = F.concat(F.lit("［"), F.regexp_replace(n, ".+", "Supplier"), F.lit("］"))
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", texts.safe_id(n).alias("slug"), texts.company_key(F.concat(n, F.lit(" Co., Ltd."))).alias("key"), texts.masked(whole, ["Supplier", "Supp"]).alias("masked"), texts.folded(F.concat(F.lit("ABC（"), n, F.lit("）"))).alias("folded"),
    )
