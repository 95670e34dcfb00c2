"""Serialised rows: ``value_2=a; value_4=b`` and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(c: Column, separator: str = r"\s*[;｜|]\s*") -> Column:
    """array<struct<key, value>> in order; pieces without ``=`` are left out, ``=`` within a value stays."""
    pieces = F.filter(F.split(F.coalesce(c, F.lit("")), separator), lambda p: p.contains("="))
    return F.transform(pieces, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))


def value_of(c: Column, key: str) -> Column:
    """The last value of ``key``, or null."""
    found = F.filter(entries(c), lambda e: e["key"] == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def summary(c: Column, limit: int = 12, longest: int = 120) -> Column:
    """The first ``limit`` entries with a digit and no overlong value, as ``key=value; ...``."""
    kept = F.filter(entries(c), lambda e: e["value"].rlike(r"\d") & (F.length(e["value"]) <= longest))
    return F.array_join(F.transform(F.slice(kept, 1, limit), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
