"""Intent rules, slots and their validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import periods

#: Words of questions on relations and on comparisons.
RELATION_WORDS, COMPARE_WORDS = ("關係人", "供應鏈", "轉投資", "被投資", "風險"), ("比較", "較高", "相比", "趨勢")
QUARTER = r"(\d{3}Q[1-4])"


def quarters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(QUARTER), F.lit(1)))


def route(text: Column, known_item: Column) -> Column:
    """Ordered rules: relations first, then comparisons, numbers of a known item, and text search for the rest."""
    return (
        F.when(text.rlike("|".join(RELATION_WORDS)), "relation")
        .when(text.rlike("|".join(COMPARE_WORDS)) | (F.size(quarters(text)) > 1), "compare")
        .when(known_item, "numeric")
        .otherwise("vector")
    )


def track(mode: Column) -> Column:
    """The track of an answer mode; old names are aliases."""
    return F.when(mode.isin("numeric", "compare", "direct_lookup", "relation"), "track1").when(mode.isin("vector", "rag"), "track2").otherwise("unknown")


def validated(periods_raw: Column, item: Column, company: Column) -> Column:
    """struct(periods, violations, missing, status): illegal periods are dropped and recorded; a question without company
    or item needs clarification."""
    asked = F.coalesce(periods_raw, F.array().cast("array<string>"))
    legal = F.filter(asked, lambda p: p.rlike(periods.LABEL))
    dropped = F.transform(F.array_except(asked, legal), lambda p: F.concat(F.lit("illegal period: "), p))
    missing = F.filter(F.array(F.when(company.isNull() | (company == ""), F.lit("company")), F.when(item.isNull() | (item == ""), F.lit("item"))), lambda x: x.isNotNull())
    return F.struct(legal.alias("periods"), dropped.alias("violations"), missing.alias("missing"), F.when(F.size(missing) > 0, "needs_clarification").otherwise("ok").alias("status"))


def injected(text: Column) -> Column:
    """Patterns of instructions in a question that are not for the reader of it."""
    patterns = F.array(*map(F.lit, [r"ignore (all )?previous", r"system prompt", r"忽略.{0,6}指示"]))
    return F.filter(patterns, lambda p: F.regexp_like(F.lower(text), p))
