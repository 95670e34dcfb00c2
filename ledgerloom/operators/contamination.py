"""How much of a question stands in a text: runs of words by an inverted index of their rarest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import kept

#: Words of a run; an item with fewer is one run.
RUN = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))


def contained_share(items: DataFrame, texts: DataFrame, item: str, text: str, run: int = RUN, least: float = 0.5) -> DataFrame:
    """item, text, n_words, covered, share of every item (key ``item``, column text) and text (key ``text``, column text) that
    share runs of words which cover ``least`` of the item's words.

    Every run of an item stands in the index under the one of its words that is rarest in all texts. A text's word brings
    its neighbours along only where it is such a word, so what is joined grows with the places of rare words and not
    with the texts. Runs are then compared as a whole. Items are tables too, of any number; common runs that many texts
    hold are rows of (text, run), never pairs of texts. Items and texts without words give no row.
    """
    asked = kept(items.select(F.col(item).alias("_item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0), "contamination-items")
    last = F.greatest(F.size("_w") - run, F.lit(0))
    runs = asked.select("_item", "_w", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    runs = runs.select("_item", "_at", F.slice("_w", F.col("_at") + 1, F.lit(run)).alias("_run"))
    runs = kept(runs.withColumns({"_hash": F.xxhash64(F.array_join("_run", " ")), "_len": F.size("_run")}), "contamination-runs")
    # A text's words, each with the words around it; the lists of neighbours are linear in the text.
    around = F.transform(F.col("_t"), lambda w, i: F.struct(w.alias("w"), F.least(i, F.lit(run - 1)).alias("before"), F.slice(F.col("_t"), F.greatest(i - run + 2, F.lit(1)), F.least(i, F.lit(run - 1)) + run).alias("near")))
    split = texts.select(F.col(text).alias("_text"), words(F.col("text")).alias("_t"))
    vocabulary = runs.select(F.explode("_run").alias("_word")).distinct()
    counts = split.select(F.explode("_t").alias("_word")).join(vocabulary, "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    each = runs.select("_hash", "_len", F.posexplode("_run").alias("_off", "_word")).distinct().join(counts, "_word", "left")
    anchors = each.groupBy("_hash", "_len").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_off", "_word")).alias("a"))
    # A word that no text has rules its run out.
    anchors = kept(anchors.where("a.n > 0").select("_hash", "_len", F.col("a._off").alias("_off"), F.col("a._word").alias("_word")), "contamination-anchors")
    places = split.select("_text", F.explode(around).alias("p")).select("_text", F.col("p.w").alias("_word"), "p.before", "p.near").join(anchors, "_word")
    begins = F.col("before") - F.col("_off")
    met = places.where((begins >= 0) & (begins + F.col("_len") <= F.size("near")))
    met = met.where(F.xxhash64(F.array_join(F.slice("near", begins + 1, F.col("_len")), " ")) == F.col("_hash")).select("_text", "_hash").distinct()
    hits = met.join(runs.select("_item", "_at", "_hash", "_len"), "_hash").groupBy("_item", "_text").agg(F.collect_set(F.struct("_at", "_len")).alias("runs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["_at"], r["_at"] + r["_len"] - 1)))))
    sized = hits.withColumn("covered", covered).join(asked.groupBy("_item").agg(F.max(F.size("_w")).alias("n_words")), "_item")
    share = F.round(F.col("covered") / F.col("n_words"), 4)
    return sized.where(F.col("covered") >= least * F.col("n_words")).select(F.col("_item").alias(item), F.col("_text").alias(text), "n_words", "covered", share.alias("share"))
