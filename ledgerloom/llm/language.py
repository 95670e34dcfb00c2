"""Language ID by fusing evidence with Bayes' rule.

Likelihoods of a page's text come from hashed byte trigrams counted over all labelled documents. Grouped aggregation of
the texts' posteriors gives what a declared markup language and a path's language code say, and priors by address: a
host's counts are smoothed by its domain's, these by its suffix's (the last label), and these by all pages'.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import byte_lengths, map_texts, steps, written

BUCKETS = 1 << 14
#: Trigram tables are of so many languages at a time: each block of them has a pass of its own over the texts.
BLOCK = 100
#: A text's mean log-likelihood counts as of so many trigrams at most: neighbouring trigrams are not independent.
EFFECTIVE = 40
#: Pages' worth of the wider group's distribution that a group's own counts are mixed with.
SMOOTHING = 5.0

_MARKUP = re.compile(r"<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*+(>|\Z)", re.I | re.S)
_OPENED = re.compile(r"<(?:script|style)\b.*|<!--.*", re.I | re.S)


def visible(html: str | None) -> str:
    """The text of a page: no markup, scripts, styles or comments; entities resolved. A ``<`` behind the last ``>`` is a sign.

    Linear: the first such ``<`` ends the search, as what follows it can hold no tag.
    """
    plain = lambda m: _OPENED.sub(" ", m[0]) if m[1] == "" else " "
    return entities.unescape(_MARKUP.sub(plain, html)) if html else ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the byte trigrams of the lower-cased texts; runs of white space are one space."""
    raw = [" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(b" " + r + b" " for r in raw), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (data[:-2] * 65536 + data[1:-1] * 256 + data[2:]) * np.uint32(2654435761)
    inside = owner[2:] == owner[:-2]
    return owner[2:][inside], (code >> np.uint32(18))[inside].astype(np.int64)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")


def languages(docs: DataFrame) -> list[str]:
    """Every language that a document (text, lang) has, in order."""
    return sorted(r.lang for r in labelled(docs).select("lang").distinct().collect())


def profiles(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """The log-probabilities of the trigrams of ``langs``, over all documents (text, lang) of those languages."""
    docs = labelled(docs)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            own = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            texts = batch.column(1)
            for a, b in steps(byte_lengths(texts)):
                text, bucket = trigrams(texts.slice(a, b - a).to_pylist())
                lang = own[a:b][text]
                sums += np.bincount(lang[lang >= 0] * BUCKETS + bucket[lang >= 0], minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket])], names=["lang", "bucket", "n"])

    table = np.full((len(langs), BUCKETS), 0.5)
    counts = docs.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return np.log(table / table.sum(axis=1, keepdims=True))


def log_likelihoods(texts: list[str], table: np.ndarray) -> np.ndarray:
    text, bucket = trigrams(texts)
    n = np.bincount(text, minlength=len(texts))
    sums = np.stack([np.bincount(text, row[bucket], minlength=len(texts)) for row in table], axis=1)
    return sums * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]


def evidence(pages: DataFrame, docs: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, host, domain, suffix, declared, path_code, log_text (in order of ``langs``) of every page, as a written table."""
    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[^:]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)).alias("path_code"),
        F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"), page.alias("html"),
    )
    rows = rows.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    rows = rows.withColumn("log_text", F.array().cast("array<double>"))
    for a in range(0, len(langs), BLOCK):
        table = profiles(docs, langs[a : a + BLOCK])
        if a + BLOCK < len(langs):
            rows = rows.withColumn("_html", F.col("html"))
        rows = map_texts(rows, lambda x, table=table: {"_more": [*log_likelihoods([visible(t) for t in x], table)]}, "_more array<double>", "html")
        rows = written(rows.withColumn("log_text", F.concat("log_text", "_more")).drop("_more").withColumnRenamed("_html", "html"), "lang-evidence")
    return rows


def with_softmax(rows: DataFrame, logs: str, name: str) -> DataFrame:
    rows = rows.withColumn("_top", F.array_max(logs)).withColumn("_parts", F.transform(logs, lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_total", F.aggregate("_parts", F.lit(0.0), lambda total, x: total + x))
    return rows.withColumn(name, F.transform("_parts", lambda x: x / F.col("_total"))).drop("_top", "_parts", "_total")


def smoothed(rows: DataFrame, key: str, wider: Column | None, n: int, also: tuple[str, ...] = ()) -> DataFrame:
    """key and ``prior``: the group's summed posteriors with SMOOTHING pages of ``wider`` (an array of each row's group)."""
    sums = [F.sum(F.col("p")[i]) for i in range(n)]
    grouped = rows.groupBy(key, *also).agg(F.array(*sums).alias("sums"), F.count("*").alias("n"))
    return grouped if wider is None else grouped.select(key, *also, mixed("sums", "n", wider).alias("prior"))


def mixed(sums: str, count: str, wider: Column) -> Column:
    return F.zip_with(sums, wider, lambda s, w: (s + SMOOTHING * w) / (F.col(count) + SMOOTHING))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang and score (posterior of lang) of every row of ``pages`` (page_id, url, html).

    Languages are those of ``docs`` (text, lang). Null html is no text and declares nothing, a null url has an empty
    host; then the other evidence decides, at last the prior of all pages. Ties go to the language that sorts first.
    A page's own posterior is part of the sums of its host, declared language and path code: beside SMOOTHING pages of the wider group it
    confirms itself a little where these hold few pages. Without a labelled document lang is null and score 0. Null page_ids stay; repeated rows have one row each.
    """
    langs = languages(docs)
    n = len(langs)
    if not n:
        host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[^:]*://([^/?#]*)", 1))
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("score"))
    rows = with_softmax(evidence(pages, docs, langs), "log_text", "p")
    overall = rows.agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)], F.count("*").alias("n")).first()
    prior = [(overall[i] or 0.0) / overall["n"] if overall["n"] else 1 / n for i in range(n)]
    every = F.array(*[F.lit(0.99 * p + 0.01 / n) for p in prior])
    suffixes = smoothed(rows, "suffix", every, n).withColumnRenamed("prior", "_suffix")
    domains = smoothed(rows, "domain", None, n, ("suffix",)).join(suffixes, "suffix").select("domain", mixed("sums", "n", F.col("_suffix")).alias("_domain"))
    hosts = smoothed(rows, "host", None, n, ("domain",)).join(domains, "domain").select("host", mixed("sums", "n", F.col("_domain")).alias("by_host"))
    hosts = written(hosts, "lang-hosts")
    declared = written(smoothed(rows, "declared", every, n).withColumnRenamed("prior", "by_declared"), "lang-declared")
    codes = written(smoothed(rows, "path_code", every, n).withColumnRenamed("prior", "by_code"), "lang-codes")
    full = rows.join(hosts, "host").join(declared, "declared").join(codes, "path_code")
    # P(evidence | language) is proportional to P(language | evidence) / P(language).
    logs = F.zip_with("log_text", "by_host", lambda x, p: x + F.log(p))
    for by in ("by_declared", "by_code"):
        logs = F.zip_with(logs, by, lambda x, p: x + F.log(p))
    full = with_softmax(full.withColumn("_logs", F.zip_with(logs, every, lambda x, p: x - 2 * F.log(p))), "_logs", "_post")
    name = lambda c: F.array(*map(F.lit, langs))[F.array_position(c, F.array_max(c)).cast("int") - 1]
    return full.select("page_id", "host", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), name("log_text").alias("text_lang"), name("_post").alias("lang"), F.array_max("_post").alias("score"))
