"""Exact top-k search by columnar branch-and-bound.

Vectors lie in blocks, dimension by dimension. A task takes one block of queries and one block of candidates and adds up
inner products a few dimensions at a time, heavy ones first. What the remaining dimensions can add at most is bounded by the remaining
mass (the norms of both rests); candidates whose bound falls below the k-th best score that is certain are compacted
away, so later dimensions touch survivors only. All scores are integers and exact.

The stated queries meet all rows, in blocks: candidates go to every block of queries once, and of each pair of blocks
only k rows a query leave. Copies of blocks are shuffled by the pair of blocks, with components in as few bytes as they
need. They are never broadcast: Spark takes a side's size from its files, before it is copied for every block of the
other, and would gather all copies in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import give_back, settings, written

K = 20
SCALE = 64
#: Vectors of a block of queries, and of a block of candidates, at most.
QUERY_BLOCK, BLOCK = 16384, 65536
#: Smaller tables of queries are dealt into so many blocks, of LEAST_BLOCK queries at least.
QUERY_BLOCKS, LEAST_BLOCK = 8, 1024
#: Dimensions that are added between two compactions.
STRIDE = 8
#: Bounds begin where the remaining dimensions have this share of the block's norm; until then TOGETHER queries go at once.
REST, TOGETHER = 0.4, 32


def scaled(vectors: DataFrame, asked: Column, scale: int = SCALE) -> DataFrame:
    """row (valid in the written table), vec_id, asked and v (array of integers): floor(scale * x) of every component.
    Rows that are null, or hold null or non-finite components, are left out."""
    x = F.col("x")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col("embedding").cast("array<double>").alias("x")).where(fine)
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "asked", F.transform("x", lambda c: F.floor(c * scale)).alias("v")), "topk-vectors")


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as the largest of them needs."""
    low, high = matrix.min(initial=0), matrix.max(initial=0)
    return matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def packed(rows: DataFrame, blocks: int, seed: int) -> DataFrame:
    """The vectors in about as many ``blocks``: dims, block, row, id, no_id, width (bytes of a component) and, dimension
    after dimension, the components, as bytes. Vectors of a block have the same number of components."""
    keyed = rows.select(F.size("v").alias("dims"), F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(blocks)).cast("int").alias("block"), "row", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("no_id"), "v")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = narrow(np.stack(pdf["v"].to_numpy()).astype(np.int64).T)
        own = {c: [pdf[c].to_numpy(t).tobytes()] for c, t in (("row", np.int64), ("id", np.int64), ("no_id", np.bool_))}
        return pd.DataFrame({"dims": [int(pdf["dims"].iloc[0])], "block": [int(pdf["block"].iloc[0])], **own, "width": [matrix.itemsize], "columns": [np.ascontiguousarray(matrix).tobytes()]})

    schema = "dims int, block int, row binary, id binary, no_id binary, width int, columns binary"
    return written(keyed.groupBy("dims", "block").applyInPandas(pack, schema), "topk-blocks")


class Block(NamedTuple):
    row: np.ndarray
    id: np.ndarray
    no_id: np.ndarray
    columns: np.ndarray  # dims x n

    @staticmethod
    def of(dims: int, row: bytes, id: bytes, no_id: bytes, width: int, columns: bytes) -> Block:
        rows = np.frombuffer(row, np.int64)
        matrix = np.frombuffer(columns, np.dtype(f"i{width}")).reshape(dims, len(rows)) if dims else np.zeros((1, len(rows)), np.int64)
        return Block(rows, np.frombuffer(id, np.int64), np.frombuffer(no_id, np.bool_), matrix)


def search_block(asked: Block, block: Block, k: int) -> dict[str, np.ndarray]:
    """query (row), query_id, candidate (place in ``block``) and score of the k best candidates of each query."""
    columns, queries = block.columns, asked.columns
    order = np.argsort(-np.abs(columns.astype(np.float64)).sum(axis=1), kind="stable")  # heavy dimensions first
    whole, exact = (columns, queries), None
    columns, queries = columns[order].astype(np.float64), queries[order].astype(np.float64)
    dims = len(columns)
    mass = np.append(np.cumsum((columns**2).sum(axis=1)[::-1])[::-1], 0.0)
    # Bounds begin where the rest can add little: before that they drop no candidate, and a product of matrices is quicker.
    first = next(s for s in [*range(STRIDE, dims, STRIDE), dims] if mass[s] <= REST**2 * mass[0])
    stops = [*range(first, dims, STRIDE), dims]
    rest = [np.sqrt((columns[s:] ** 2).sum(axis=0)) for s in [0, *stops]]
    query_rest = [np.sqrt((queries[s:] ** 2).sum(axis=0)) for s in [0, *stops]]
    out: dict[str, list] = {c: [] for c in ("query", "query_id", "candidate", "score")}
    for q in range(len(asked.row)):
        if q % TOGETHER == 0:
            begun = queries[:first, q : q + TOGETHER].T @ columns[:first]
        alive = np.flatnonzero(block.row != asked.row[q])
        if rest[0].max(initial=0.0) * query_rest[0][q] < 2.0**53:
            # Sums of integers below 2**53 are exact; the bound's roots are not, so it is widened a little.
            score = begun[q % TOGETHER][alive]
            for step, stop in enumerate(stops, 1):
                if stop > first:
                    score += queries[start:stop, q] @ columns[start:stop, alive]
                start = stop
                if stop == dims or len(alive) <= k:
                    continue
                slack = rest[step][alive] * query_rest[step][q] * (1 + 1e-9) + 1e-6
                low = score - slack
                certain = np.partition(low, len(low) - k)[len(low) - k]
                stay = score + slack >= certain
                alive, score = alive[stay], score[stay]
            score = score.astype(np.int64)
        else:  # whole numbers of any length
            exact = whole[0].astype(object) if exact is None else exact
            score = np.clip(whole[1][:, q].astype(object) @ exact[:, alive], -(2**63), 2**63 - 1).astype(np.int64)
        if len(alive) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            stay = score >= edge
            alive, score = alive[stay], score[stay]
        best = np.lexsort((block.id[alive], block.no_id[alive], -score))[:k]
        for c, x in (("query", np.full(len(best), asked.row[q])), ("query_id", np.full(len(best), asked.id[q])), ("candidate", alive[best]), ("score", score[best])):
            out[c].append(x)
    return {c: np.concatenate(x) for c, x in out.items()}


def paired(left: DataFrame, right: DataFrame, query_blocks: int, blocks: int) -> DataFrame:
    """Every block of queries beside every block of candidates (names with r_) of as many dimensions.

    Both sides are copied and keyed by the pair, which is the work that is asked for, and meet by a shuffle.
    """
    parts = ("row", "id", "no_id", "width", "columns")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.select("dims", F.col("block").alias("qb"), other(blocks).alias("cb"), F.struct(*parts).alias("l"))
    found = right.select("dims", F.col("block").alias("cb"), other(query_blocks).alias("qb"), F.struct(*parts).alias("r"))
    return asked.hint("merge").join(found.hint("merge"), ["dims", "qb", "cb"]).select("dims", "l.*", *[F.col(f"r.{c}").alias(f"r_{c}") for c in parts])


def top_k(vectors: DataFrame, asked: Column, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) for every row where ``asked``.

    Every row but the query's own is a candidate, also rows that repeat its vec_id; each row that is asked has ranks of its own. Ties go to
    the smaller vec_id, null last. Unusable vectors take no part; only vectors of equally many components meet; fewer
    than k candidates give fewer rows; empty tables give none. Scores beyond 64 bits are held at their limits.
    """
    rows = scaled(vectors, asked, scale)
    queries = rows.where("asked")
    n = queries.count()
    query_blocks = max(1, -(-n // min(query_block, max(LEAST_BLOCK, -(-n // QUERY_BLOCKS)))))
    blocks = max(1, -(-rows.count() // block))
    pairs = paired(packed(queries, query_blocks, 1), packed(rows, blocks, 2), query_blocks, blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, *parts = (column[i].as_py() for column in batch.columns)
                own, other = Block.of(dims, *parts[:5]), Block.of(dims, *parts[5:])
                found = search_block(own, other, k)
                at = found.pop("candidate")
                found |= {"vec_id": pa.array(other.id[at], mask=other.no_id[at]), "row": other.row[at]}
                yield pa.RecordBatch.from_pydict({c: pa.array(found[c]) for c in ("query", "query_id", "vec_id", "row", "score")})
        give_back()

    found = pairs.mapInArrow(search, "query long, query_id long, vec_id long, row long, score long")
    order = W.Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    # One pair of blocks is a batch: a task holds no more, however many pairs fall to it.
    with settings(vectors.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": 1}):
        return written(best, "topk-best")
