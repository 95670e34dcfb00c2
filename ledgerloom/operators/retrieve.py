"""Retrieval: vectors under metadata filters, BM25, rank fusion, merged sub-queries and context budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(v: Column) -> Column:
    """``v`` (array<double>) over its length."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ranked(rows: DataFrame, by: Sequence[str], score: str, tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank per key by falling score, ties by ``tie``; the best ``k``, if given, stay (Spark limits each task's
    group before the shuffle)."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie))))
    return out.where(F.col(name) <= k) if k else out


def vector_scores(queries: DataFrame, chunks: DataFrame, on: Column | None = None) -> DataFrame:
    """Cosine similarity of each query (qid, q_vector) with each chunk (vector), both of unit length, rounded to four
    decimals. Without a condition every question meets every chunk, in blocks."""
    pairs = chunks.join(queries, on) if on is not None else join_blocks(chunks, queries)
    return pairs.withColumn("score", F.round(dot(F.col("vector"), F.col("q_vector")), 4))


def join_blocks(chunks: DataFrame, queries: DataFrame, size: int = 256, parts: int = 64) -> DataFrame:
    """Every stated query with every chunk, a block of queries at a time.

    Chunks are dealt into ``parts`` parts by a hash; both sides are keyed by (block, part), so a chunk is sent once to each block and a
    block once to each part, and no key is shared by more than a block of queries and a part of the chunks.
    """
    blocks = queries.count() // size + 1
    asked = queries.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("qid", "q_vector")).alias("_queries"))
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = chunks.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in chunks.columns]), F.lit(parts)).cast("int"))
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return dealt.join(asked, ["_block", "_part"]).select(*chunks.columns, F.inline("_queries"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, doc_id, score of every query (qid, text) with every document (doc_id, text) that shares a term.

    Documents are tokenised once and counted per (document, term) before anything is joined; the queries' distinct terms
    prune the counts first, so terms nobody asks for are never shuffled by document. A text that is an array of tokens, as
    ``segment.segmented`` gives for unspaced script, is taken as it is.
    """
    def terms_of(rows: DataFrame) -> Column:
        is_array = rows.schema["text"].dataType.typeName() == "array"
        return F.transform("text", F.lower) if is_array else tokens(F.col("text"))

    lengths = docs.select("doc_id", F.size(terms_of(docs)).alias("dl"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    terms = queries.select("qid", F.explode(F.array_distinct(terms_of(queries))).alias("term"))
    wanted = terms.select("term").distinct()
    # Lengths are joined later: next to explode they would be computed anew for every token.
    tf = docs.select("doc_id", F.explode(terms_of(docs)).alias("term"))
    tf = tf.join(wanted, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(df, "term").join(lengths, "doc_id").join(F.broadcast(totals)).select("term", "doc_id", weight.alias("w"))  # totals is one row
    return terms.join(weighted, "term").groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 4).alias("score"))


def fused(*rankings: DataFrame, key: Sequence[str] = ("qid", "doc_id"), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank)."""
    rows = rankings[0].select(*key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(*key, "rank"))
    return rows.groupBy(*key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))


def within_budget(chunks: DataFrame, by: Sequence[str], text: str, rank: str, budget: int = 4000, fingerprint: int = 80) -> DataFrame:
    """Ranked chunks that fit a budget of characters: a chunk that begins as an earlier one goes, and the first that does
    not fit ends the context, whatever comes after. A first chunk that is too long is cut to the budget.

    The windows hold one question's ranked chunks, whose number its top-k bounds.
    """
    start = F.substring(text, 1, fingerprint)
    once = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*by, start).orderBy(rank))).where("_n = 1")
    order = Window.partitionBy(*by).orderBy(rank)
    once = once.withColumns({"_i": F.row_number().over(order), "_sum": F.sum(F.length(text)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    kept = once.where((F.col("_sum") <= budget) | (F.col("_i") == 1))
    return kept.withColumn("used", F.least(F.length(text), F.lit(budget))).drop("_n", "_i", "_sum")
