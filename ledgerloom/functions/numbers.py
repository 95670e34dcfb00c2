"""Number parsers. Each follows its own rule for signs, percents and failures; they are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a cell that mean no value.
MISSING = ("", "-", "—", "－", "N/A", "n/a", "NA", "無", "不適用")


def _bare(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _to_double(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.cast("double"))


def fact_number(raw: Column) -> Column:
    """Cells of facts: half-width parentheses around the whole are a minus; commas, blanks and % go; MISSING is null."""
    c = _bare(raw)
    minus = c.startswith("(") & c.endswith(")")
    plain = F.translate(c, "(),% （）$", "")
    value = _to_double(plain)
    return F.when(c.isin(*MISSING), None).when(minus, -value).otherwise(value)


def clean_number(raw: Column) -> Column:
    """Cells of relation tables: as fact_number, but only for wholly numeric content."""
    c = F.regexp_replace(_bare(raw), r"[,%\s]", "")
    inner = F.regexp_extract(c, r"^\((.*)\)$", 1)
    return F.when(inner != "", -_to_double(inner)).otherwise(_to_double(c))


def signed_number(raw: Column) -> Column:
    """Values to compare: parentheses of either width give minus the absolute value; a % sign is no number."""
    c = F.regexp_replace(F.translate(_bare(raw), "（），", "(),"), r"[,\s]", "")
    inner = F.regexp_extract(c, r"^\((.*)\)$", 1)
    return F.when(_bare(raw).isin(*MISSING), None).when(inner != "", -F.abs(_to_double(inner))).otherwise(_to_double(c))


def first_number(raw: Column) -> Column:
    """The first number anywhere; a parenthesis anywhere makes a positive one negative."""
    c = F.translate(_bare(raw), ",", "")
    value = _to_double(F.regexp_extract(c, r"-?\d+(\.\d+)?", 0))
    return F.when(c.contains("(") & (value > 0), -value).otherwise(value)


def number_key(raw: Column) -> Column:
    """A key for equal numbers: four decimals as text; percents and anything else but one number have none."""
    return F.format_string("%.4f", F.when(~_bare(raw).contains("%"), signed_number(raw)))


def ratio_number(raw: Column) -> Column:
    """Answers in words: percents are divided by 100; parentheses mean nothing."""
    c = F.regexp_replace(_bare(raw), r"[,$\s]", "")
    value = _to_double(F.regexp_replace(c, "%$", ""))
    return F.when(c.endswith("%"), value / 100).otherwise(value)


def cell_state(raw: Column) -> Column:
    """not_found for null, missing_value for MISSING, else value; zero is a value."""
    return F.when(raw.isNull(), "not_found").when(_bare(raw).isin(*MISSING), "missing_value").otherwise("value")


def value_type(raw: Column) -> Column:
    return F.when(_bare(raw).contains("%"), "percent").otherwise("amount")


def sign_name(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value < 0, "negative").when(value == 0, "zero").otherwise("positive")


def percent_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator in percent, two decimals; null if either is missing or the denominator is zero."""
    return F.round(F.try_divide(numerator, denominator) * 100, 2)
