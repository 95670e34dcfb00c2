"""URL filters: fixed host and path rules, and association rules that FP-growth mines from labelled URLs.

The tokens of labelled URLs and their label are Spark FP-growth's transactions. Rules from tokens to the label ``block``
that reach a support and a confidence stay; one that a rule with fewer tokens implies at no less confidence goes. An
inverted index from a rule's tokens to the rule finds, for every URL, the rules whose tokens it all has.

Labels are a table of their own; they teach where no base rule decides, as mined rules count there only. Where no labels
are given, the pages themselves say what they are (``evidence``): by their visible text, which the quality classifier,
fitted without labels on the texts of all pages, keeps or not.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import language, quality
from ledgerloom.llm.common import map_texts, written

#: Fixed values: (verdict, host, path) of the base rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A rule needs MIN_COUNT labelled pages to block, at every size of the table, and MIN_CONFIDENCE of its labelled pages.
MIN_CONFIDENCE, MIN_COUNT = 0.8, 5


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(_url, locate('://', _url) + 3)"))


def parsed(pages: DataFrame, *also: str) -> DataFrame:
    """page_id, host, path, tokens and ``also`` of every url: A-Z of the host in lower case, the path up to ``?``, ``#`` or the end."""
    lower = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("_url"), *also)
    p = p.withColumn("_rest", F.coalesce(after_scheme(F.col("_url")), F.lit("")))
    p = p.withColumn("h", F.regexp_extract("_rest", "^[^/?#]*", 0)).withColumn("_tail", F.expr("substring(_rest, length(h) + 1)"))
    p = p.withColumn("host", F.expr(lower)).withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0))
    query = F.expr("substring(_tail, length(path) + 1)")
    pieces = [
        F.transform(F.filter(F.split("host", "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(F.split("host", "[^0-9a-z]+"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x)),
        F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(F.filter(F.split(query, "[?&#]"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0])),
        F.array(F.concat(F.lit("scheme:"), F.when(F.locate("://", F.col("_url")) > 0, F.lower(F.substring_index("_url", "://", 1))).otherwise(""))),
    ]
    return p.select("page_id", "host", "path", *also, F.array_distinct(F.concat(*pieces)).alias("tokens"))


def fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def base_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        verdict = F.when(fits(host, path), kind).otherwise(verdict)
    return rule, verdict


def vocabulary(labelled: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """token, item, n, bad and apart of the tokens that stand in ``min_count`` pages to block; others are in no rule.

    Tokens that stand in the same pages share an ``item``, the least of them. n counts an item's pages and bad those to
    block. Items ``apart`` stand in every page, or only in pages to block: with other items they make no surer rule.
    """
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    marks = sets.select("n", "bad", F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit(1), "tokens").alias("two"), F.explode(F.array_distinct("tokens")).alias("token"))
    same = ["n", "bad", "one", "two"]
    each = marks.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    each = written(each.where(F.col("bad") >= min_count), "url-tokens")
    items = each.groupBy(same).agg(F.min("token").alias("item"))
    every = labelled.count()
    spread = (F.col("bad") == F.col("n")) | (F.col("n") == every)
    return written(each.join(items, same).select("token", "item", "n", "bad", spread.alias("apart")), "url-items")


def as_items(sets: DataFrame, words: DataFrame) -> DataFrame:
    """tokens_id and tokens of distinct token sets, in items of ``words``; sets without any are left out."""
    sets = sets.select("tokens_id", "tokens").dropDuplicates(["tokens_id"]).select("tokens_id", F.explode("tokens").alias("token"))
    return sets.join(words.select("token", "item"), "token").groupBy("tokens_id").agg(F.sort_array(F.collect_set("item")).alias("tokens"))


def rules_of(labelled: DataFrame, words: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """The rules over the items of ``words``: single items by their counts, combinations by mining the items that are not apart."""
    labelled = labelled.withColumn("tokens_id", F.xxhash64("tokens"))
    sets = as_items(labelled, words.where(~F.col("apart")))
    rows = labelled.select("tokens_id", "blocked").join(sets, "tokens_id").select("tokens", "blocked")
    alone = words.where((F.col("bad") >= min_count) & (F.col("bad") / F.col("n") >= min_confidence))
    alone = alone.select(F.col("item").alias("rule_id"), F.array("item").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"), F.col("bad").alias("n")).distinct()
    return pruned(written(alone.unionByName(mine(rows, min_confidence, min_count).where("size(tokens) > 1")), "url-found"))


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that hold a shorter one of no less confidence, which says all that they say."""
    index = rules.select(F.explode("tokens").alias("token"), F.col("rule_id").alias("short"), F.size("tokens").alias("k"), F.col("confidence").alias("as_sure"))
    inside = rules.select("rule_id", "confidence", F.size("tokens").alias("own"), F.explode("tokens").alias("token")).join(index, "token")
    inside = inside.where("k < own AND as_sure >= confidence").groupBy("rule_id", "short", "k").agg(F.count("*").alias("met")).where("met = k")
    return rules.join(inside.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "n")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """rule_id, tokens, confidence and n of the mined rules for ``block``; ``labelled`` has tokens and blocked (boolean).

    Only pages to block are FP-growth's transactions, as only they support a rule: so an itemset is one of ``min_count`` pages to
    block, whatever the size of the table, and none of clean pages alone is made. How many labelled pages hold an itemset
    is counted over the distinct token sets with their numbers, each itemset standing under its rarest token.
    """
    sets = labelled.where(F.col("blocked").isNotNull()).select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "blocked")
    sets = written(sets.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")), "url-sets")
    bad = sets.where("bad > 0").select(F.col("tokens").alias("items"), F.explode(F.sequence(F.lit(1), F.col("bad"))).alias("_k")).select("items")
    n = sets.agg(F.sum("bad")).first()[0] or 0
    if n < max(min_count, 1):
        return sets.sparkSession.createDataFrame([], "rule_id string, tokens array<string>, confidence double, n long")
    # Half a page less, so that rounding cannot raise the count.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / n)).fit(bad)
    found = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    found = written(found.withColumn("rule_id", F.concat_ws(" ", "tokens")), "url-itemsets")
    index = indexed(found).withColumnRenamed("n", "support")
    hits = sets.select("tokens", "n", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    counted = hits.groupBy("rule_id").agg(F.first("needed").alias("tokens"), F.first("support").alias("n"), F.sum("n").alias("held"))
    rules = counted.select("rule_id", "tokens", (F.col("n") / F.col("held")).alias("confidence"), "n").where(F.col("confidence") >= min_confidence)
    return pruned(written(rules, "url-rules"))


def indexed(rules: DataFrame) -> DataFrame:
    """The inverted index: each rule under its rarest token, the one that fewest rules hold, with all its tokens as ``needed``."""
    tokens = rules.select("rule_id", F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("held"))
    key = tokens.join(rarity, "token").groupBy("rule_id").agg(F.min(F.struct("held", "token")).alias("key"))
    return written(rules.withColumnRenamed("tokens", "needed").join(key.select("rule_id", F.col("key.token").alias("token")), "rule_id"), "url-index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens_id, mined (the surest rule that matches, ties to the smaller id) for distinct token sets of ``urls``.

    A rule is found in the index under one of its tokens; the others are checked there.
    """
    sets = urls.select("tokens_id", "tokens").dropDuplicates(["tokens_id"])
    hits = sets.select("tokens_id", "tokens", F.explode("tokens").alias("token")).join(indexed(rules), "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.groupBy("tokens_id").agg(F.min(F.struct((-F.col("confidence")).alias("sure"), "rule_id")).alias("best")).select("tokens_id", F.col("best.rule_id").alias("mined"))


def evidence(pages: DataFrame) -> DataFrame:
    """page_id and blocked of every row of ``pages`` (page_id, html; url is not read) with a visible word: blocked if the
    quality classifier rejects its text. Texts are cut from the pages anew in each pass: they would fill as much disk."""
    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").cast("string").alias("html"))
    texts = map_texts(rows, lambda x: {"text": [language.visible(t) for t in x]}, "text string", "html")
    judged = quality.judge(texts, quality.train(texts)).where(F.translate("pattern", "-", "") != "")
    return judged.select(F.col("doc_id").alias("page_id"), (~F.col("kept")).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the association rule that decided, if any) of every row of ``pages``.

    ``labels`` (page_id, blocked) are what is mined, on pages without a base rule: MIN_COUNT of them to block at least for a
    rule. The base rules come first; where none fits, an association rule that matches blocks, and else the url is allowed. Null urls and urls
    without ``://`` have an empty host and path. Null page_ids stay, repeated rows have one row each, and a page_id
    that several labels name counts as blocked if any blocks; null labels say nothing. Without labels nothing is mined.
    """
    urls = written(parsed(pages).withColumn("tokens_id", F.xxhash64("tokens")), "urls")
    bad = labels.where("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    known = written(urls.where(base_rule(rules)[0].isNull()).join(bad, "page_id").select("tokens", "blocked"), "url-labelled")
    words = vocabulary(known)
    mined = written(rules_of(known, words, min_confidence), "url-mined")
    rule, verdict = base_rule(rules)
    found = written(matched(as_items(urls, words), mined), "url-matches")
    out = urls.join(found, "tokens_id", "left").withColumns({"rule": rule, "_base": verdict})
    own = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_base", own).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
