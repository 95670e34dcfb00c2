"""Outlines in text: ``[stage]``, ``(segment)`` and ``code name`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.carry import carried

STAGE, SEGMENT, COMPANY = r"^\[(.+)\]$", r"^\((.+)\)$", r"^(\d+[A-Z]?)\s+(.+)$"


def carry_forward(lines: DataFrame, document: str, place: str, line: str, ranges: int | None = None) -> DataFrame:
    """Company lines with the stage and segment above them; other lines match no rule and are left out.

    Lines are ordered by ``place`` within each document and dealt over tasks by ``ranges`` of it (``carry.carried``), so an
    outline may have any length. A new stage ends the segment.
    """
    text = F.trim(line)
    found = lambda p, g=1: F.when(text.rlike(p), F.regexp_extract(text, p, g))
    rows = lines.select(document, place, found(STAGE).alias("_is_stage"), found(SEGMENT).alias("_is_segment"), found(COMPANY).alias("code"), found(COMPANY, 2).alias("company"))
    rows = carried(rows, document, place, {"_stage": F.col("_is_stage"), "_segment": F.col("_is_segment")}, ranges)
    open_ = F.col("_stage").isNull() | (F.col("_segment.at") > F.col("_stage.at"))
    rows = rows.withColumns({"stage": F.col("_stage.value"), "segment": F.when(open_, F.col("_segment.value"))})
    return rows.where(F.col("code").isNotNull()).select(document, place, "stage", "segment", "code", "company")
