"""Jobs that build graphs from table files: selection, typed records, nodes and edges, stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import kept, read, shared_folder
from ledgerloom.operators import snapshots
from ledgerloom.sources import records, selection
from ledgerloom.sources.ordered import numbered

NAMES = ("被投資公司名稱、所在地區", "關係人名稱及關係", "應收關係人款項_明細", "被投資公司 相關資訊_2", "其他")
HEADER = ("投資公司名稱", "被投資公司名稱", "代號", "所在地區", "主要營業項目", "原始投資金額", "上期期末", "股數", "比率", "帳面金額", "本期認列之投資損益", "備註")
CELLS = [f"c{i}" for i in range(13)]

PAGES = """c AS (SELECT *, c_nationkey % 5 AS kind, c_custkey // 1000 AS page, CAST(round(c_acctbal) AS BIGINT) AS v, c_custkey % 7 AS k FROM customer), files AS (SELECT DISTINCT c_nationkey AS nation, page, kind FROM c)"""
VALID = f"""{PAGES}, r AS (SELECT c_custkey, '控股' || c_nationkey || ' 股份有限公司' AS investor_name, c_name AS investee_name, n_name AS location, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS main_business,
  CAST(v AS DOUBLE) AS book_value, CAST(c_custkey % 100 AS DOUBLE) AS ownership_percent FROM c JOIN nation ON c_nationkey = n_nationkey WHERE kind IN (0, 1, 3) AND k > 2)"""


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, text of table files, one for the customers of a nation out of each 1,000: a header and rows, some of them no records."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, v, blank = F.col("c_custkey") % 7, F.round("c_acctbal").cast("bigint"), F.lit("")
    money = F.when(v < 0, F.concat(F.lit("( "), F.format_number(-v, 0), F.lit(" )"))).otherwise(F.format_number(v, 0))
    investor = F.when(k == 0, "合計").otherwise(F.concat(F.lit("控股"), F.col("c_nationkey").cast("string"), F.lit(" 股份有限公司")))
    row = [
        investor, F.when(k.isin(0, 1), "").otherwise(F.col("c_name")), F.col("c_custkey").cast("string"), F.col("n_name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")),
        money, F.lit("-"), F.format_number(F.col("c_custkey") * 1000, 0), F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%")), money, F.lit("nan"), blank, F.lit("more"),
    ]
    names = F.array(*map(F.lit, NAMES))
    rows = c.select(F.get(names, F.col("c_nationkey") % 5).alias("t"), F.col("c_nationkey").alias("n"), F.floor(F.col("c_custkey") / 1000).alias("p"), F.col("c_custkey").alias("at"), *[F.when(k == 2, "").otherwise(x).alias(c) for x, c in zip(row, CELLS)])
    # Every kind of file but the third begins with a header.
    head = rows.select("t", "n", "p").distinct().where(F.col("n") % 5 != 2).select("t", "n", "p", F.lit(-1).alias("at"), *[F.lit(x).alias(c) for x, c in zip([*HEADER, ""], CELLS)])
    rows = head.unionByName(rows).withColumn("is_text", F.col("n") % 5 == 4)
    root = shared_folder(spark, "filed-tables")
    dealt = rows.repartition("t", "n", "p").sortWithinPartitions("t", "n", "p", "at")
    dealt.where("NOT is_text").drop("at", "is_text").write.partitionBy("t", "n", "p").csv(root)
    dealt.where("is_text").select("t", "n", "p", F.concat_ws(",", *CELLS).alias("value")).write.mode("append").partitionBy("t", "n", "p").text(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(F.url_decode("path").alias("path"), F.decode("content", "UTF-8").alias("text")).withColumn("name", F.regexp_extract("path", "/t=([^/]+)/", 1))


def _place(i: int, name: str):
    return F.regexp_extract("path", f"/{'np'[i]}=([^/]+)/", 1).cast("bigint").alias(name)


@query("S15 S16 S17 K3", f"""WITH {PAGES}, k AS (SELECT unnest(['investment', 'related_parties', 'transactions']) AS rule)
SELECT nation, page, rule, CASE WHEN kind = 4 THEN 'not_csv' WHEN rule = 'investment' THEN CASE kind WHEN 1 THEN 'by_content' WHEN 2 THEN 'not_target' ELSE 'by_name' END
  WHEN rule = 'related_parties' THEN CASE kind WHEN 1 THEN 'by_name' WHEN 2 THEN 'excluded_keyword' ELSE 'not_target' END ELSE CASE kind WHEN 1 THEN 'excluded_keyword' WHEN 2 THEN 'by_name' ELSE 'not_target' END END AS reason
FROM files, k""")
def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files each build reads or leaves, and why."""
    files = kept(_filed(spark, sf_dir), "table-files")
    every = None
    for rule in (selection.investment, selection.related_parties, selection.transactions):
        for part in selection.selected(files, rule):
            rows = part.select(_place(0, "nation"), _place(1, "page"), F.lit(rule.__name__).alias("rule"), "reason")
            every = rows if every is None else every.unionByName(rows)
    return every


def _investments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chosen, _ = selection.selected(_filed(spark, sf_dir), selection.investment)
    lines = chosen.select(F.col("path").alias("source"), _place(0, "nation"), F.posexplode(F.split("text", "\r?\n")).alias("row", "line")).where("line != ''")
    cells = F.from_csv("line", F.lit(", ".join(f"{c} string" for c in CELLS)))
    return records.investments(lines.select("source", "nation", "row", F.array(*[cells[c] for c in CELLS]).alias("cells")))


@query("S18 P14 N2", f"WITH {VALID} SELECT c_custkey AS code, investor_name, investee_name, location, main_business, ownership_percent, book_value, NULL::DOUBLE AS original_investment_prior FROM r")
def investment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of the investment tables."""
    found, _ = _investments(spark, sf_dir)
    return found.select(F.col("investee_code_or_index").cast("bigint").alias("code"), "investor_name", "investee_name", "location", "main_business", "ownership_percent", "book_value", "original_investment_prior")


@query("P14 S18", f"""WITH {PAGES}, x AS (SELECT c_nationkey AS nation, CASE k WHEN 0 THEN 'total' WHEN 1 THEN 'no_investee' ELSE 'blank' END AS reason FROM c WHERE kind IN (0, 1, 3) AND k < 3 UNION ALL SELECT nation, 'header' FROM files WHERE kind IN (0, 1, 3))
SELECT nation, reason, count(*) AS n FROM x GROUP BY ALL""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same tables that are no records, by why."""
    _, left = _investments(spark, sf_dir)
    return left.groupBy("nation", "reason").agg(F.count("*").alias("n"))


@query("R1 A10", f"""WITH {VALID}, i AS (SELECT *, 'company_name:' || split_part(investor_name, ' ', 1) AS a, 'company_name:' || lower(replace(investee_name, '#', '')) AS b FROM r)
SELECT a AS source, b AS target, 'INVESTS_IN' AS type, '113Q4' AS report_period, ownership_percent, book_value FROM i
UNION ALL SELECT DISTINCT b, 'location:' || lower(regexp_replace(location, '[^A-Za-z0-9]+', '_', 'g')), 'LOCATED_IN', NULL, NULL, NULL FROM i
UNION ALL SELECT DISTINCT b, 'business:' || CASE WHEN main_business = '' THEN '未標註' ELSE lower(main_business) END, 'HAS_MAIN_BUSINESS', NULL, NULL, NULL FROM i""")
def investment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the investment graph of the records."""
    found, _ = _investments(spark, sf_dir)
    _, edges = snapshots.investment_graph(found.withColumn("report_period", F.lit("113Q4")))
    return edges.drop("edge_key")


DELIVERIES = """l AS MATERIALIZED (SELECT row_number() OVER () - 1 AS seq, l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem),
d AS (SELECT l_suppkey || '>' || o_custkey AS edge_key, seq, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS note, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS BIGINT) || '%' END AS ownership_percent FROM l JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT edge_key, arg_max(note, seq) FILTER (WHERE note IS NOT NULL) AS note, arg_max(ownership_percent, seq) FILTER (WHERE ownership_percent IS NOT NULL) AS ownership_percent, max(seq) AS seq FROM d GROUP BY edge_key)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries merged into a stored table filing by filing: the older half of the lines, the newer half, and that again."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = numbered(read(spark, sf_dir, "lineitem"), "seq")
    rows = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(">", "l_suppkey", "o_custkey").alias("edge_key"), "seq", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("note"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("%"))).alias("ownership_percent"),
    )
    middle = lines.count() // 2
    path, props = shared_folder(spark, "snapshot"), ["note", "ownership_percent"]
    older, newer = (rows.where(f"seq {op} {middle}") for op in ("<", ">="))
    for filing in (older, newer, newer):
        table = snapshots.upsert(filing, path, "edge_key", props)
    return table


@query("K5 G12", f"WITH {DELIVERIES} SELECT edge_key, note, ownership_percent, seq FROM g")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph after three filings, the last one a repetition."""
    return _snapshot(spark, sf_dir)


@query("S20 U1", f"""WITH {DELIVERIES} SELECT edge_key, note, replace(ownership_percent, '%', '') AS ownership_percent, NULL AS nation, 'deliveries' AS _graph_source FROM g
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, n_name, 'locations' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def compiled_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored graphs of differing columns as one table that says where each edge is from."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    located = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("edge_key"), F.col("n_name").alias("nation"))
    return snapshots.loaded({"deliveries": _snapshot(spark, sf_dir).drop("seq"), "locations": located})
