"""Quarters in the ROC calendar, and the periods that column headers name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROC = 1911
LABEL = r"^(\d{3})Q([1-4])$"
RANGE = r"(\d{2,4})年(\d{1,2})月(\d{1,2})日(?:至|到|~|～|-|－)(?:(\d{2,4})年)?(\d{1,2})月(\d{1,2})日"
INSTANT = r"(\d{2,4})年(\d{1,2})月(\d{1,2})日"


def label_of(date: Column) -> Column:
    return F.concat(F.lpad((F.year(date) - ROC).cast("string"), 3, "0"), F.lit("Q"), F.quarter(date).cast("string"))


def fiscal_year(label: Column) -> Column:
    return F.when(label.rlike(LABEL), F.regexp_extract(label, LABEL, 1).cast("int"))


def quarter(label: Column) -> Column:
    return F.when(label.rlike(LABEL), F.regexp_extract(label, LABEL, 2).cast("int"))


def western_year(year: Column) -> Column:
    """Years of up to three digits count from 1912 on."""
    return F.when(year.between(1, 999), year + ROC).otherwise(year)


def western_label(label: Column) -> Column:
    """114Q4 becomes 2025Q4; anything else stays."""
    return F.when(label.rlike(LABEL), F.concat((fiscal_year(label) + ROC).cast("string"), F.lit("Q"), quarter(label).cast("string"))).otherwise(label)


def sort_key(label: Column) -> Column:
    """Order of quarters; labels that are none come first."""
    return F.coalesce(fiscal_year(label) * 10 + quarter(label), F.lit(-1))


def _int(c: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found.cast("int"))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


#: Words of headers without a date and the role that each gives, in the order in which they are looked for.
RELATIVE = (
    ("去年同期累計", "prior_ytd"), ("本期累計", "current_ytd"), ("去年同期", "prior"), ("本期期末", "current_end"), ("本期期初", "current_beginning"),
    ("期末", "current_end"), ("期初", "current_beginning"), ("本期", "current"), ("上期", "prior"), ("前期", "prior"),
)


def header_kind(header: Column) -> Column:
    relative = header.rlike("|".join(w for w, _ in RELATIVE))
    return F.when(header.rlike(RANGE), "duration").when(header.rlike(INSTANT), "instant").when(relative, "relative").otherwise("unknown")


def header_role(header: Column, label: Column) -> Column:
    """current or prior by the year in which the header's date ends against the report's; else what its words say."""
    ends, year = F.substring(header_end(header), 1, 4).cast("int"), fiscal_year(label) + ROC
    dated = F.when(ends == year, "current").when(ends == year - 1, "prior").otherwise("unknown")
    words = F.lit("unknown")
    for word, role in reversed(RELATIVE):
        words = F.when(header.contains(word), role).otherwise(words)
    return F.when(header.rlike(RANGE) | header.rlike(INSTANT), dated).otherwise(words)


def header_start(header: Column) -> Column:
    """Start of a duration as ISO text; null for an instant."""
    return F.when(header.rlike(RANGE), _iso(western_year(_int(header, RANGE, 1)), _int(header, RANGE, 2), _int(header, RANGE, 3)))


def header_end(header: Column) -> Column:
    year = F.coalesce(_int(header, RANGE, 4), _int(header, RANGE, 1))
    span = _iso(western_year(year), _int(header, RANGE, 5), _int(header, RANGE, 6))
    day = _iso(western_year(_int(header, INSTANT, 1)), _int(header, INSTANT, 2), _int(header, INSTANT, 3))
    return F.when(header.rlike(RANGE), span).when(header.rlike(INSTANT), day)


def header_year(header: Column) -> Column:
    return _int(header, r"(20\d{2}|19\d{2})", 1)


def header_key(header: Column) -> Column:
    """What two headers of one date share: the date, or range of dates, else the first 12 characters."""
    found = F.regexp_extract(header, INSTANT + r"((?:至|到|~|～|-|－)(?:\d{2,4}年)?\d{1,2}月\d{1,2}日)?", 0)
    return F.when(found != "", found).otherwise(F.substring(header, 1, 12))


def quarter_start_month(q: Column) -> Column:
    return (q - 1) * 3 + 1
