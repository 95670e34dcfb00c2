"""Which table files a build reads, and why not the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import kept

# Words in the names, or in the first rows, of the files of each kind.
INVESTMENT_NAME, INVESTMENT_NAME_ANY = "被投資公司", ("所在地區", "相關資訊", "投資資訊")
INVESTMENT_ROWS, INVESTMENT_ROWS_ANY = ("被投資公司", "所在地區"), ("投資公司", "主要營業項目", "期末持有", "原始投資金額", "本期認列")
PARTY_NAMES = ("關係人名稱及關係", "關係人名稱關係")
PARTY_NOT = ("關係人交易", "重大交易", "交易", "應收", "應付", "營業收入", "收入", "進貨", "費用", "款項", "餘額", "明細")
TRANSACTION_NAMES = (
    "母子公司間業務關係及重要交易往來情形", "母子公司間業務關係", "重要交易往來情形", "轉投資大陸地區之事業相關資訊", "轉投資大陸地區", "大陸地區之事業相關資訊", "應付關係人款項", "應收關係人款項",
)
TRANSACTION_NOT = (
    "關係人名稱及關係", "關係人名稱關係", "_facts", "facts", "all_table_facts", "numeric_facts", "coverage_report", "optimized", "source_table_index", "xbrl_notes", "xbrl_note",
    "Independent_Auditors", "會計師查核", "應收款項之備抵損失變動資訊", "應收款項之帳齡分析",
)
#: Fixed value: signs that names are compared without.
SIGNS = r"[\s_、，,。．.（）()【】\[\]-]+|…"
#: Rows whose content may speak for a file.
FIRST_ROWS = 5


def bare(text: Column) -> Column:
    """A name without white space and signs."""
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), SIGNS, "")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(bare(F.lit(w))) for w in words))


def _every(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (text.contains(bare(F.lit(w))) for w in words))


def first_rows(text: Column) -> Column:
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\r?\n", FIRST_ROWS + 1), 1, FIRST_ROWS), " ")


def is_csv(path: Column) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).endswith(".csv")


def investment(path: Column, name: Column, text: Column) -> Column:
    """The reason to read (``by_...``) or to leave a file as one of investments: by its name, else by its first rows."""
    n, rows = bare(name), bare(first_rows(text))
    by_name = n.contains(INVESTMENT_NAME) & _any(n, INVESTMENT_NAME_ANY)
    by_rows = _every(rows, INVESTMENT_ROWS) & _any(rows, INVESTMENT_ROWS_ANY)
    return F.when(~is_csv(path), "not_csv").when(by_name, "by_name").when(by_rows, "by_content").otherwise("not_target")


def related_parties(path: Column, name: Column, text: Column) -> Column:
    """The same for the register of related parties: only by name, and not if the name says more."""
    n = bare(name)
    return F.when(~is_csv(path), "not_csv").when(_any(n, PARTY_NOT), "excluded_keyword").when(_any(n, PARTY_NAMES), "by_name").otherwise("not_target")


def transactions(path: Column, name: Column, text: Column) -> Column:
    """The same for transactions with related parties."""
    n = bare(name)
    return F.when(~is_csv(path), "not_csv").when(_any(n, TRANSACTION_NOT), "excluded_keyword").when(_any(n, TRANSACTION_NAMES), "by_name").otherwise("not_target")


def selected(files: DataFrame, rule, path: str = "path", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files to read, files left), both with ``reason``; the files themselves are read once."""
    judged = kept(files.withColumn("reason", rule(F.col(path), F.col(name), F.col(text))), "judged-files")
    wanted = F.col("reason").startswith("by_")
    return judged.where(wanted), judged.where(~wanted)
