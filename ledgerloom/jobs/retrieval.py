"""Jobs of retrieval on documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.jobs.registry import query
from ledgerloom.jobs.tables import read
from ledgerloom.operators import checked, retrieve

VECTORS = """u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
e AS (SELECT label, i, sum(CAST(v[i] AS DECIMAL(18,9))) / count(*) AS m FROM u, range(1, 65) t(i) GROUP BY ALL),
c AS (SELECT label AS qid, list(CAST(m AS DOUBLE) ORDER BY i) AS c FROM e GROUP BY label),
q AS (SELECT qid, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS qv FROM c)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", retrieve.unit(F.col("embedding").cast("array<double>")).alias("vector"))


def centroids(chunks: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors, summed as decimals so that the order of rows does not matter."""
    parts = chunks.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg((F.sum(F.col("x").cast("decimal(18,9)")).cast("double") / F.count("*")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return means.select(F.col("label").alias("qid"), retrieve.unit(F.col("m")).alias("q_vector"))


@query("V2 V3 L1", f"""WITH {VECTORS}, s AS (SELECT qid, vec_id, round(list_dot_product(v, qv), 4) AS score FROM q, u),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vectors(spark, sf_dir)
    scores = retrieve.vector_scores(centroids(chunks), chunks).select("qid", "vec_id", "score")
    return retrieve.ranked(scores, ["qid"], "score", "vec_id", 5)


@query("V1 V10 S21", f"""WITH {VECTORS}, s AS (SELECT qid, vec_id, label, vec_id % 10 AS part, round(list_dot_product(v, qv), 4) AS score FROM q, u),
t AS (SELECT *, CASE WHEN label = qid AND part = qid % 10 THEN 1 WHEN label = qid THEN 2 END AS tier FROM s),
m AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best),
r AS (SELECT qid, vec_id, score, tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM m) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on metadata first (label and part, else label; never none), then cosine among what is left."""
    from ledgerloom.operators.relax import best_tier

    chunks = vectors(spark, sf_dir)
    q = centroids(chunks)
    pairs = chunks.join(q, chunks["label"] == q["qid"])  # an equi-join: other labels are never scored
    rows = best_tier(pairs, ["qid"], F.when(F.col("vec_id") % 10 == F.col("qid") % 10, 1).otherwise(2))
    scored = rows.select("qid", "vec_id", "tier", F.round(retrieve.dot(F.col("vector"), F.col("q_vector")), 4).alias("score"))
    return retrieve.ranked(scored, ["qid"], "score", "vec_id", 5)


@query("V4 U6 L5", f"""WITH {VECTORS}, s AS (SELECT qid, vec_id, vec_id % 4 AS part, round(list_dot_product(v, qv), 4) AS score FROM q, u),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, part ORDER BY score DESC, vec_id) AS k FROM s),
d AS (SELECT qid, vec_id, max(score) AS score FROM r WHERE k <= 3 GROUP BY ALL), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM d) SELECT * FROM f WHERE rank <= 12""")  # fmt: skip
def multi_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries per part, merged without repeats and capped at k times their number."""
    chunks = vectors(spark, sf_dir).withColumn("part", F.col("vec_id") % 4)
    scores = retrieve.vector_scores(centroids(vectors(spark, sf_dir)), chunks).select("qid", "part", "vec_id", "score")
    best = retrieve.ranked(scores, ["qid", "part"], "score", "vec_id", 3, "k").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    return retrieve.ranked(best, ["qid"], "score", "vec_id", 12)


BM25 = """d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(any_value(t)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
s AS (SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM s)"""


@query("V5 G20 Z37", f"WITH {BM25} SELECT * FROM lex WHERE rank <= 5")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieve.ranked(retrieve.bm25(items, docs), ["qid"], "score", "doc_id", 5)


@query("V6 W12 Z37", f"""WITH {BM25}, c AS (SELECT qid, doc_id, count(*) AS common FROM q JOIN tf USING (term) GROUP BY ALL),
o AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY common DESC, doc_id) AS rank FROM c),
f AS (SELECT qid, doc_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 8) AS score FROM (SELECT qid, doc_id, rank FROM lex WHERE rank <= 50 UNION ALL SELECT qid, doc_id, rank FROM o WHERE rank <= 50) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's best 50 fused with the best 50 by number of common terms."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    lexical = retrieve.ranked(retrieve.bm25(items, docs), ["qid"], "score", "doc_id", 50)
    terms = lambda df, key: df.select(key, F.explode(F.array_distinct(retrieve.tokens(F.col("text")))).alias("term"))
    common = terms(docs, "doc_id").join(terms(items, "qid"), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("common"))
    return retrieve.ranked(retrieve.fused(lexical, retrieve.ranked(common, ["qid"], "common", "doc_id", 50)), ["qid"], "score", "doc_id", 5)


@query("T4 T5 W11 L3", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, substr(text, 1, 80) ORDER BY turn) AS n FROM conversations), s AS (SELECT conv_id, turn, text, row_number() OVER w AS i, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM o WHERE n = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(least(length(text), 400) AS INT) AS used FROM s WHERE upto <= 400 OR i = 1""")  # fmt: skip
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return retrieve.within_budget(turns, ["conv_id"], "text", "turn", 400).select("conv_id", "turn", "used")


@query("L10 E14 V8 L6", f"""WITH {BM25}, g AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT qid, min(rank) AS best FROM lex JOIN g USING (qid, doc_id) GROUP BY qid)
SELECT qid, best, best <= 1 AS hit_1, best <= 5 AS hit_5, best <= 20 AS hit_20 FROM h""")  # fmt: skip
def gold_rank_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep BM25 ranks the first document that holds a benchmark item's whole text."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    gold = checked.contained(docs, items.withColumnRenamed("text", "passage").select("passage").distinct(), "doc_id", "text", "passage").select("doc_id", F.col("passage").alias("text")).join(items, "text").select("qid", "doc_id")
    scores = retrieve.bm25(items, docs)
    # The best gold document of each item, then how many stand above it: a count instead of a ranking of everything.
    top = scores.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("g"))
    above = scores.join(top, "qid").where(F.struct((-F.col("score")).alias("s"), "doc_id") <= F.col("g"))
    best = above.groupBy("qid").agg(F.count("*").cast("int").alias("best"))
    return best.select("qid", "best", *[(F.col("best") <= k).alias(f"hit_{k}") for k in (1, 5, 20)])


@query("L3 L4 L6 L7", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE rn <= greatest(2, n // 4)""")  # fmt: skip
def priority_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority rows first, in stable order, up to a cap that depends on the group."""
    w = Window.partitionBy("o_custkey")
    order = w.orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), "o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.where(F.col("rn") <= F.greatest(F.lit(2), F.floor(F.col("n") / 4))).select("o_custkey", "o_orderkey")
