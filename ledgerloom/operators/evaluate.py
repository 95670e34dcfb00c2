"""Scores of answers and rankings, and the statistics on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, texts

#: What refusals say.
REFUSALS = ("找不到相關資料", "找不到符合條件的資料", "條件不足", "無法回答", "沒有相關資料", "不清楚", "查無資料")
#: Fixed value: how the message of a failed service begins.
SERVICE_ERROR = "[vLLM"


def refused(answer: Column) -> Column:
    """No answer, a service's error, or one of the phrases of refusal."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return (a == "") | a.startswith(SERVICE_ERROR) | a.rlike("|".join(REFUSALS))


def exact(answer: Column, gold: Column) -> Column:
    """Equal after normalisation, or the same number, or the same set of labels joined by ``;``."""
    a, g = texts.answer(answer), texts.answer(gold)
    labels = lambda c: F.array_sort(F.array_distinct(F.split(c, "[;；]")))
    same = numbers.signed_number(answer) == numbers.signed_number(gold)
    return (a == g) | F.coalesce(same, F.lit(False)) | (labels(a) == labels(g))


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text, digit-group commas and parentheses left out."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,()]", ""), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def number_matches(answer: Column, gold: Column) -> dict[str, Column]:
    """numeric (the same numbers), contains (all of the gold's) and partial (one of them); false for gold without a number."""
    a, g = numbers_in(answer), numbers_in(gold)
    some, missing = F.size(g) > 0, F.size(F.array_except(g, a))
    return {"numeric": some & (missing == 0) & (F.size(F.array_except(a, g)) == 0), "contains": some & (missing == 0), "partial": some & (missing < F.size(g))}


#: Absolute and relative error that is none, the wider one where the answer speaks of percents, and how far from its end.
NEAR, SHARE, WIDE, TAIL = 0.01, 0.05, 0.10, 100
YES_NO = ("yes", "no")


def tolerant(answer: Column, gold: Column, response: Column) -> tuple[Column, Column]:
    """(right, unreadable) of an answer on given evidence.

    yes and no are equal or not. Numbers are equal within NEAR or SHARE of the gold, as they are, as percent or as share; with the
    other sign by their absolute values; and, where the answer is above 1, the gold below and the response's end
    speaks of percents, within WIDE as a share. A null answer, and one that is no number, is unreadable.
    """
    a, g = F.lower(F.trim(answer)), F.lower(F.trim(gold))
    x, y = numbers.ratio_number(answer), numbers.ratio_number(gold)

    def near(p: Column, q: Column, share: float = SHARE) -> Column:
        return (F.abs(p - q) <= NEAR) | ((q != 0) & (F.abs(p - q) / F.abs(q) <= share))

    either = near(x, y) | near(x / 100, y) | near(x * 100, y)
    signs = (x * y < 0) & (near(F.abs(x), F.abs(y)) | near(F.abs(x) / 100, F.abs(y)) | near(F.abs(x) * 100, F.abs(y)))
    percent = F.right(F.coalesce(response, F.lit("")), F.lit(TAIL)).rlike("(?i)%|percent(?:age)?")
    wide = (x > 1) & (F.abs(y) > 0) & (F.abs(y) < 1) & percent & near(x / 100, y, WIDE)
    is_word = g.isin(*YES_NO)
    right = F.when(answer.isNull(), False).when(is_word, a == g).otherwise(F.coalesce(either | signs | wide, F.lit(False)))
    unreadable = F.when(answer.isNull(), True).when(is_word, (a != g) & ~a.isin(*YES_NO)).otherwise(x.isNull() | y.isNull())
    return right, unreadable


def report(rows: DataFrame, *by: str) -> DataFrame:
    """Per group of a rollup of ``by``: counts, and rates of four decimals. rows has em, refusal, contains, fallback (booleans) and seconds.

    Precision is of the answers given, recall of all questions; stable answers are those without a fallback.
    """
    share = lambda x, n: F.round(F.try_divide(F.col(x).cast("double"), F.col(n)), 4)
    counts = rows.rollup(*by).agg(
        F.count("*").alias("n"), F.count_if("em").alias("n_right"), F.count_if("refusal").alias("n_refused"), F.count_if("contains").alias("n_contains"),
        F.count_if("fallback").alias("n_fallback"), F.count_if(F.col("em") & F.col("fallback")).alias("right_fallback"), F.count_if(F.col("em") & ~F.col("fallback")).alias("right_stable"),
        F.min("seconds").alias("least_seconds"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.max("seconds").alias("most_seconds"),
    ).withColumns({"n_answered": F.col("n") - F.col("n_refused"), "n_stable": F.col("n") - F.col("n_fallback")})
    counts = counts.withColumns({"precision": share("n_right", "n_answered"), "recall": share("n_right", "n"), "contains_rate": share("n_contains", "n"), "fallback_em": share("right_fallback", "n_fallback"), "stable_em": share("right_stable", "n_stable")})
    p, r = F.try_divide(F.col("n_right").cast("double"), "n_answered"), F.col("n_right") / F.col("n")
    return counts.withColumns({"f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4), "stability_gap": F.round(F.col("stable_em") - F.col("fallback_em"), 4)}).drop("right_fallback", "right_stable", "n_stable")


def rouge(pairs: DataFrame, key: str, answer: str, gold: str, *sizes: int) -> DataFrame:
    """key, n, precision, recall and f of the n-grams of tokens, for each n of ``sizes``, four decimals.

    Multiset overlap by a join on (key, n, n-gram). Tokens are cut once; an n-gram is n neighbouring rows, so the work grows
    with the length of the text. Pairs without an n-gram score 0. Texts are cut at blanks; a column that is an array of
    tokens, as ``segment.segmented`` gives for unspaced script, is taken as it is.
    """
    def grams(c: str, name: str) -> DataFrame:
        if pairs.schema[c].dataType.typeName() == "array":
            words = F.transform(F.col(c), F.lower)
        else:
            words = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda x: x != "")
        rows = pairs.select(key, words.alias("t"))
        # A list of n-grams is zipped from the list of tokens and the lists that begin one, two, ... tokens later.
        shifted = lambda t, n: F.arrays_zip(*[F.slice(t, k + 1, F.greatest(F.size(t) - n + 1, F.lit(0))).alias(str(k)) for k in range(n)])
        cut = [rows.select(key, F.lit(n).alias("n"), F.explode(shifted(F.col("t"), n)).alias("g")).select(key, "n", F.concat_ws(" ", *[F.col(f"g.`{k}`") for k in range(n)]).alias("gram")) for n in sizes]
        every = cut[0]
        for more in cut[1:]:
            every = every.unionByName(more)
        return every.groupBy(key, "n", "gram").agg(F.count("*").alias(name))

    both = grams(answer, "x").join(grams(gold, "y"), [key, "n", "gram"], "full").fillna(0, ["x", "y"])
    sums = both.groupBy(key, "n").agg(F.sum(F.least("x", "y")).alias("o"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    rows = pairs.select(key, F.explode(F.array(*map(F.lit, sizes))).alias("n")).join(sums, [key, "n"], "left").fillna(0, ["o", "x", "y"])
    p, r = F.coalesce(F.try_divide("o", "x"), F.lit(0.0)), F.coalesce(F.try_divide("o", "y"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select(key, "n", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f"))


def dcg(grades: Column) -> Column:
    """Of an array of grades in order of rank."""
    gains = F.transform(grades, lambda g, i: g / F.log2(i + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def ndcg(grades: Column, k: int) -> Column:
    """Against the same grades in the best order; 0 without any relevant one."""
    best = dcg(F.slice(F.reverse(F.array_sort(grades)), 1, k))
    return F.when(best > 0, dcg(F.slice(grades, 1, k)) / best).otherwise(0.0)


def reciprocal_rank(grades: Column) -> Column:
    at = F.array_position(F.transform(grades, lambda g: g > 0), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p = F.try_divide(successes.cast("double"), n)
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - spread, F.lit(0.0)), F.least(centre + spread, F.lit(1.0))


def _binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def clopper_pearson_bounds(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval by bisection."""
    def solve(f) -> float:
        a, b = 0.0, 1.0
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if f(m) else (a, m)
        return (a + b) / 2

    low = 0.0 if k == 0 else solve(lambda p: 1 - _binomial_cdf(k - 1, n, p) < alpha / 2)
    high = 1.0 if k == n else solve(lambda p: _binomial_cdf(k, n, p) > alpha / 2)
    return low, high


def clopper_pearson(k: str, n: str) -> Column:
    """struct(low, high) from aggregated counts, so it is computed once per group and not per row."""
    return F.pandas_udf(_intervals, "struct<low:double,high:double>")(k, n)


def _intervals(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson_bounds(int(a), int(b)) if b else (math.nan, math.nan) for a, b in zip(k, n)], columns=["low", "high"])


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided exact test on the discordant pairs."""
    return 1.0 if b + c == 0 else min(1.0, 2 * _binomial_cdf(min(b, c), b + c, 0.5))


def mcnemar(b: str, c: str) -> Column:
    return F.pandas_udf(_p_values, "double")(b, c)


def _p_values(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c)])


def discordant(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Counts of the 2 x 2 table of two yes-no columns."""
    cells = {"both": F.col(a) & F.col(b), "only_a": F.col(a) & ~F.col(b), "only_b": ~F.col(a) & F.col(b), "neither": ~F.col(a) & ~F.col(b)}
    return pairs.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


#: Items whose native and Latin names mean different things, and the kind of question that each source table belongs to.
BROKEN_ITEMS = ("繼續營業單位淨利（淨損） Diluted earnings (loss) per share from continuing operations",)
SOURCE_KINDS = (
    ("轉投資大陸地區之事業相關資訊", "mainland_investment_graph"), ("母子公司間業務關係及重要交易往來情形", "related_party_transaction_graph"), ("被投資公司名稱", "investment_graph"),
)
#: Difference of a ratio, in percent points, that is still right.
RATIO_TOLERANCE = 0.02


def audit_code(gold: Column, question: Column, item: Column, source: Column, n_rows: Column, n_unique: Column, found: Column, prior: Column) -> Column:
    """The first defect of a gold answer that applies, in a fixed order; ``ok`` if none does."""
    return (
        F.when(gold.rlike(r"value_\d+\s*="), "D3 corrupt gold")
        .when(item.isin(*BROKEN_ITEMS), "D6 item name mismatch")
        .when(source.contains("去年同期"), "D7 prior-period source")
        .when(question.rlike(r"的\s*【\s*\d{1,3}\s*】\s*(?:中|涉及|是|，)"), "D11 row index in question")
        .when(n_rows == 0, "D1 not in corpus")
        .when(n_unique > 1, "D5 ambiguous row")
        .when(numbers.number_key(gold) == numbers.number_key(found), "ok")
        .when(numbers.number_key(gold) == numbers.number_key(prior), "D2 wrong column")
        .otherwise("D1 not in corpus")
    )


def two_period_defect(header_year: Column, years: tuple[Column, Column], golds: tuple[Column, Column], truths: tuple[Column, Column]) -> Column:
    """Of a question on two periods: one column for both, or one gold for two values (D4); a gold that is not its period's value (D2)."""
    keys, true = [numbers.number_key(g) for g in golds], [numbers.number_key(t) for t in truths]
    one_column = (header_year == years[0]) != (header_year == years[1])
    wrong = F.coalesce((keys[0] != true[0]) | (keys[1] != true[1]), F.lit(False))
    same = F.coalesce((keys[0] == keys[1]) & (true[0] != true[1]), F.lit(False))
    return F.when(F.coalesce(one_column, F.lit(False)) | same, "D4 same value for two periods").when(wrong, "D2 wrong column").otherwise("ok")


def ratio_defect(ratios: tuple[Column, Column], numerators: tuple[Column, Column], denominators: tuple[Column, Column], names: tuple[Column, Column], winner: Column) -> Column:
    """D9 if a ratio is not its numerator by its denominator, the winner is not the higher one, or both ratios are equal.

    The higher one is the first if its ratio is greater, else the second: a first that is told as winner of equal ratios is wrong."""
    off = [F.coalesce(F.abs(r - F.round(F.try_divide(n, d) * 100, 2)) > RATIO_TOLERANCE, F.lit(False)) for r, n, d in zip(ratios, numerators, denominators)]
    higher = F.when(ratios[0] > ratios[1], names[0]).otherwise(names[1])
    return F.when(off[0] | off[1], "D9 arithmetic").when(winner != higher, "D9 winner").when(ratios[0] == ratios[1], "D9 no winner").otherwise("ok")


def kind_defect(kind: Column, source: Column) -> Column:
    """D10 if a question says that it is of one graph and its source table belongs to another."""
    wrong = F.lit(False)
    for table, expected in SOURCE_KINDS:
        wrong |= source.contains(table) & (kind != expected)
    return F.when(kind.contains("graph") & wrong, "D10 question type mismatch").otherwise("ok")
