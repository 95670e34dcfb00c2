"""Toxicity: a factorization machine over hashed terms.

score(x) = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the distinct terms of a text, so a pair such as an
insult and a group's name can weigh more, or less, than both alone. Terms are words and
beginnings of words; labels, languages, sources and ids are never inputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import Words, ids_and_texts, map_texts, written

#: Labelled rows that training reads at most, in the order of a hash of doc_id, and terms that come to the driver with them:
#: texts beyond that are left out of the sample.
MAX_TRAIN_ROWS, MAX_TRAIN_TERMS = 12_000, 6_000_000
#: Hash buckets of the terms.
BUCKETS = 1 << 18
#: A bucket takes part in the machine if twice its log-likelihood ratio is beyond what chance gives among all buckets. With
#: every bucket (179,438 stand in the 3,155 training texts of sf0.1) it learns the texts by heart: the area under the
#: held-out curve falls from 0.96 to 0.79.
LEAST_G = 12.0
FACTORS = 8
#: Beginnings of words, in bytes of UTF-8, that are terms too.
PREFIXES = (4, 5, 6, 7, 8)


class Model(NamedTuple):
    place: np.ndarray  # of a bucket in w and v, or -1
    w0: float
    w: np.ndarray
    v: np.ndarray


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct terms of each text, in order."""
    words = Words(texts)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = words.prefix_sums()
    keys = [words.hashes(sums=sums)]
    rows = [words.text]
    for n in PREFIXES:
        longer = words.ends - words.starts > n
        keys.append(words.hashes(words.starts[longer], words.starts[longer] + n, sums) ^ np.uint64(n))
        rows.append(words.text[longer])
    both = np.unique(np.concatenate(rows) * BUCKETS + (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def term_lists(texts: list[str | None]) -> dict:
    text, bucket = terms(texts)
    return {"terms": np.split(bucket.astype(np.int32), np.searchsorted(text, np.arange(1, len(texts))))}


def sums(key: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(key, x, minlength=n).astype(float)


def raw_scores(text: np.ndarray, term: np.ndarray, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums, and the factor sums, of n texts given as (text, term) pairs ordered by text."""
    linear = sums(text, w[term], n)
    factor = np.stack([sums(text, v[term, f], n) for f in range(v.shape[1])], axis=1)
    squares = sums(text, (v[term] ** 2).sum(axis=1), n)
    return w0 + linear + 0.5 * ((factor**2).sum(axis=1) - squares), factor


def fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 7, epochs: int = 30) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss over mini-batches; rows hold the terms of each text."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS))
    g0, gw, gv = 1e-6, np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            sizes = np.array([len(rows[i]) for i in batch])
            text = np.repeat(np.arange(len(batch)), sizes)
            term = np.concatenate([rows[i] for i in batch]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
            z, factor = raw_scores(text, term, len(batch), w0, w, v)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            g = error.sum()
            g0 += g * g
            w0 -= 0.1 * g / np.sqrt(g0)
            seen = np.unique(term)
            dw = sums(term, error[text], n_terms)[seen] + 1e-5 * w[seen]
            gw[seen] += dw**2
            w[seen] -= 0.1 * dw / np.sqrt(gw[seen])
            own = sums(term, error[text], n_terms)[seen]
            dv = np.stack([sums(term, error[text] * factor[text, f], n_terms)[seen] for f in range(FACTORS)], axis=1)
            dv += -own[:, None] * v[seen] + 1e-4 * v[seen]
            gv[seen] += dv**2
            v[seen] -= 0.02 * dv / np.sqrt(gv[seen])
    return w0, w, v


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the rows of ``labels`` (doc_id, toxic) that are not held out, at most ``max_rows`` of them.

    The sampled ids are broadcast: their number is bounded by ``max_rows``. Rows with a null doc_id or label, or a
    label that is neither 0 nor 1, teach nothing; of rows that repeat a doc_id the largest label counts and one text does. Without labels
    the model is empty and every score is 0.5.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = ids_and_texts(docs).join(F.broadcast(sample), "doc_id")
    listed = written(map_texts(rows, term_lists, "terms array<int>"), "toxic-terms")
    listed = written(listed.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms")), "toxic")
    totals = listed.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    if not n or not bad or bad == n:
        rate = (bad + 0.5) / (n + 1)
        return Model(np.full(BUCKETS, -1, np.int32), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    # A term's worth: its share of the log-likelihood ratio of presence against the label.
    counts = listed.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("b"), F.count("*").alias("k"))
    share = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    k, b = F.col("k").cast("double"), F.col("b").cast("double")
    g = share(b, k * bad / n) + share(k - b, k * (n - bad) / n) + share(F.lit(float(bad)) - b, (n - k) * bad / n) + share(F.lit(float(n - bad)) - k + b, (n - k) * (n - bad) / n)
    best = written(counts.where("k >= 2").select("term", g.alias("g")).where(F.col("g") >= LEAST_G).select("term"), "toxic-kept")
    kept = np.sort(best.toArrow()["term"].to_numpy()).astype(np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    mine = listed.select("doc_id", "toxic", F.explode_outer("terms").alias("term")).join(best.withColumn("known", F.col("term")), "term", "left")
    mine = mine.groupBy("doc_id", "toxic").agg(F.array_sort(F.collect_list("known")).alias("terms")).withColumn("key", F.xxhash64("doc_id"))
    upto = F.sum(F.size("terms")).over(W.Window.orderBy("key", "doc_id"))  # over max_rows rows at most
    local = mine.withColumn("upto", upto).where(F.col("upto") <= MAX_TRAIN_TERMS).orderBy("key", "doc_id").collect()
    w0, w, v = fit([place[np.array(r.terms, dtype=np.int64)] for r in local], np.array([r.toxic for r in local], float), len(kept))
    return Model(place, w0, w, v)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts have no terms: their score is the model's base rate. A null doc_id is not held out; repeated
    rows have one row each; an empty table gives none.
    """

    def scored(texts: list[str | None]) -> dict:
        text, bucket = terms(texts)
        term = model.place[bucket]
        known = term >= 0
        z, _ = raw_scores(text[known], term[known].astype(np.int64), len(texts), model.w0, model.w, model.v)
        return {"score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    out = map_texts(ids_and_texts(docs), scored, "score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
