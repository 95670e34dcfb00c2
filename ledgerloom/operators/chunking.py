"""Row-aware chunks of Markdown tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

SINGLE, TARGET, LEAST, MOST = 15, 1500, 10, 40


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def is_section(line: str) -> bool:
    """A row of three cells or more with text in its second cell, the name, only: neither a code nor values."""
    cells = cells_of(line)
    return len(cells) >= 3 and bool(cells[1]) and not any(cells[:1] + cells[2:])


def is_subtotal(line: str) -> bool:
    """A row whose code ends in XX."""
    return cells_of(line)[0].upper().endswith("XX")


def chunks(text: str | None) -> list[str]:
    """Chunks of whole rows. The lines up to the header rule come first in each; up to SINGLE rows make one chunk.

    A chunk has about TARGET characters of rows, repeats the last rows of the one before it, starts with the section that
    its first row is in, and never ends right before a subtotal row.
    """
    lines = (text or "").split("\n")
    rule = next((i for i, l in enumerate(lines) if re.fullmatch(r"\|[\s:|-]+\|", l.strip())), -1)
    head, rows = lines[: rule + 1], [l for l in lines[rule + 1 :] if l.strip()]
    if not rows:
        return ["\n".join(head)] if head else []
    if len(rows) <= SINGLE:
        return ["\n".join([*head, *rows])]
    n = max(LEAST, min(MOST, int(TARGET / max(1, sum(map(len, rows)) / len(rows)))))
    overlap = max(2, n // 8)
    sections: list[str | None] = []  # the section that each row stands below
    for row in rows:
        sections.append(sections[-1] if sections and not is_section(rows[len(sections) - 1]) else rows[len(sections) - 1] if sections else None)
    out, start = [], 0
    while start < len(rows):
        end = min(start + n, len(rows))
        while end < len(rows) and is_subtotal(rows[end]):
            end += 1
        above = sections[start]
        carried = [above] if above and not is_section(rows[start]) else []
        out.append("\n".join([*head, *carried, *rows[start:end]]))
        if end == len(rows):
            break
        start = max(start + 1, end - overlap)
    return out


def chunked(tables: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, total_chunks, content of every table; greedy, so by Arrow batches of whole tables."""
    kind = tables.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            rows = [(k, i, len(c), x) for k, t in zip(part[key], part[text]) for c in [chunks(t)] for i, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "content"])

    return tables.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, total_chunks int, content string")
