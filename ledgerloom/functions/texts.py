"""Names, labels and answers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms at the end of a company's name.
LEGAL_FORMS = ("股份有限公司", "有限公司", "Co., Ltd.", "Inc.", "Corp.", "Ltd.")


def cell(c: Column) -> Column:
    """Runs of white space are one blank; null, ``nan`` and ``none`` are empty."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s 　]+", " "))
    return F.when(F.lower(out).isin("nan", "none", "null"), "").otherwise(out)


def without_legal_form(c: Column) -> Column:
    forms = "|".join(f.replace(".", r"\.") for f in LEGAL_FORMS)
    return F.trim(F.regexp_replace(c, rf"(\s*({forms}))+$", ""))


def company_key(c: Column) -> Column:
    """Equal for spellings of one name: no legal form, punctuation or blanks, Latin letters in capitals."""
    return F.upper(F.regexp_replace(without_legal_form(c), r"[\s\p{Punct}、，。（）]+", ""))


def safe_id(c: Column) -> Column:
    """A lower-case slug; the start of the MD5 digest for a name without letters or digits."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 12)).otherwise(slug)


def native_part(c: Column) -> Column:
    """A label up to its first Latin letter."""
    return F.trim(F.regexp_extract(c, "^[^A-Za-z]*", 0))


def latin_part(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "[A-Za-z].*$", 0))


def folded(c: Column) -> Column:
    """Full-width parentheses become half-width, letters small."""
    return F.lower(F.translate(c, "（）", "()"))


def answer(c: Column) -> Column:
    """An answer to compare: no thinking block, no blanks, commas or blank before %, letters small."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(\d)\s+%", "$1%"), r"[\s,]+", ""))


def bracketed(c: Column) -> Column:
    """The tokens in 【】."""
    return F.regexp_extract_all(c, F.lit("【([^】]+)】"), F.lit(1))


def table_base(c: Column) -> Column:
    return F.regexp_replace(c, r"_\d+$", "")


def table_instance(c: Column) -> Column:
    found = F.regexp_extract(c, r"_(\d+)$", 1)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def statement(c: Column) -> Column:
    """The main statement that a table's name means, else null."""
    return (
        F.when(c.contains("資產負債"), "balance_sheet").when(c.contains("損益"), "income").when(c.contains("現金流量"), "cash_flow").when(c.contains("權益變動"), "equity")
    )


def fact_key(*parts: Column) -> Column:
    """The start of the SHA-1 digest of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def masked(c: Column, names: list[str], mark: str = "＿公司＿") -> Column:
    """Every name replaced by ``mark``, longer names first."""
    for n in sorted(names, key=lambda x: (-len(x), x)):
        c = F.replace(c, F.lit(n), F.lit(mark))
    return c
