"""Typed records of tables that are known by the places of their columns, and why a row is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, texts
from ledgerloom.shared import kept

#: The columns of an investment table by place, and which are numbers.
INVESTMENT = (
    "investor_name", "investee_name", "investee_code_or_index", "location", "main_business", "original_investment_end", "original_investment_prior", "shares_held", "ownership_percent", "book_value",
    "investment_income_loss", "note",
)
NUMBERS = ("original_investment_end", "original_investment_prior", "shares_held", "ownership_percent", "book_value", "investment_income_loss")
#: Words of header rows, and of rows that sum up.
HEADER_WORDS = ("投資公司名稱", "被投資公司名稱", "所在地區", "主要營業項目", "原始投資金額", "期末持有", "本期認列", "備註")
TOTAL_WORDS = ("投資公司名稱", "被投資公司名稱", "合計", "總計")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def investments(rows: DataFrame, cells: str = "cells") -> tuple[DataFrame, DataFrame]:
    """(records, rejected rows) of the rows of investment tables, whose values are an array ``cells``; other columns stay.

    Records have INVESTMENT's columns, those of NUMBERS as doubles (null where a cell is no number), and ``extra``, the
    cells beyond. Rejected rows keep their cells and say why: blank, header, no_investee or total. Missing cells are blank.
    """
    values = F.transform(F.coalesce(F.col(cells), F.array().cast("array<string>")), lambda c: texts.cell(c))
    rows = rows.withColumn("_v", values)
    at = {c: F.coalesce(F.get("_v", F.lit(i)), F.lit("")) for i, c in enumerate(INVESTMENT)}
    who = F.concat(at["investor_name"], at["investee_name"])
    reason = F.when(F.array_join("_v", "") == "", "blank").when(_holds(F.array_join("_v", ""), HEADER_WORDS), "header").when(_holds(who, TOTAL_WORDS), "total").when(at["investee_name"] == "", "no_investee")
    judged = kept(rows.withColumn("reason", reason), "judged-rows")
    others = [c for c in rows.columns if c not in (cells, "_v")]
    typed = [(numbers.clean_number(c) if n in NUMBERS else c).alias(n) for n, c in at.items()]
    extra = F.slice("_v", F.lit(len(INVESTMENT) + 1), F.greatest(F.size("_v") - len(INVESTMENT), F.lit(0))).alias("extra")
    return judged.where("reason IS NULL").select(*others, *typed, extra), judged.where("reason IS NOT NULL").select(*others, cells, "reason")
