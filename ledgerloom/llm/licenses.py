"""License scans: exact base phrases, and a fuzzy search for short license notices.

The fuzzy search takes each notice with a bound of k edits. By the pigeonhole principle a span within k edits holds
one of k + 1 pieces of the notice unchanged, so the pieces are exact seeds: only around a seed's places does the
``regex`` library match the whole notice with at most k errors, and report the span and its edits.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.common import fold, ids_and_texts, map_texts

#: Phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices of the fuzzy search, in words as the scan folds them.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under a creative commons attribution license": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)


#: Length of the grams by which windows are sifted.
GRAM = 3


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``notice`` cut into k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def grams(text: str, a: int, b: int) -> set[str]:
    return {text[i : i + GRAM] for i in range(a, b - GRAM + 1)}


class Notice(NamedTuple):
    label: str
    text: str
    k: int
    pattern: regex.Pattern
    grams: set[str]


@lru_cache(maxsize=1)
def _search() -> tuple[ahocorasick.Automaton, list[Notice]]:
    seeds: dict[str, list[tuple[int, int]]] = {}
    notices = []
    for text, label in NOTICES.items():
        k = max(1, len(text) // CHARS_PER_EDIT)
        for offset, piece in pieces(text, k):
            seeds.setdefault(piece, []).append((len(notices), offset))
        notices.append(Notice(label, text, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}"), grams(text, 0, len(text))))
    automaton = ahocorasick.Automaton()
    for piece, owners in seeds.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    return automaton, notices


def verified(text: str, notice: Notice, starts: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of ``notice``, given where seeds say that it starts; of spans that overlap the one with fewer edits, then the first.

    Seeds that say nearly the same start share a window, too short for two spans side by side. An edit changes GRAM
    grams at most, so a window with too few of the notice's grams holds no span and is not matched.
    """
    length, k = len(notice.text), notice.k
    found, at = [], 0
    starts = sorted(set(starts))
    while at < len(starts):
        stop = bisect_right(starts, starts[at] + 2 * k)
        a, b = max(0, starts[at] - k), min(len(text), starts[stop - 1] + length + k)
        at = stop
        if (exact := text.find(notice.text, a, b)) >= 0:
            found.append((0, exact, exact + length))
        elif len(notice.grams & grams(text, a, b)) >= len(notice.grams) - GRAM * k and (m := notice.pattern.search(text, a, b)):
            found.append((sum(m.fuzzy_counts), m.start(), m.end()))
    kept: list[tuple[int, int, int]] = []  # in order of places, none overlaps another
    for edits, a, b in sorted(found):
        i = bisect_right(kept, (a, b, 0))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
            kept.insert(i, (a, b, edits))
    return kept


def fuzzy_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in ``text`` (folded words joined by single spaces), in order of places.

    Spans of one notice do not overlap, those of different ones may.
    """
    automaton, notices = _search()
    starts: dict[int, list[int]] = {}
    for end, (length, owners) in automaton.iter(text):
        for n, offset in owners:
            starts.setdefault(n, []).append(end + 1 - length - offset)
    found = [(notices[n].label, *span) for n, own in starts.items() for span in verified(text, notices[n], own)]
    return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan_text(text: str | None) -> tuple:
    """The result columns of one text, but for doc_id."""
    words = fold(text).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    flat = b" ".join(words)
    padded = b" " + flat + b" "
    spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)  # word i starts behind spaces[i]
    places, labels = [], set()
    for phrase, label in BASE.items():
        target, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(target, at + 1)) >= 0:
            places.append(at)
            labels.add(label)
    places = np.searchsorted(spaces, np.array(places, np.int64)).tolist()
    base = ",".join(sorted(labels))
    fuzzy = fuzzy_spans(line := flat.decode("utf-8", "replace"))
    spans, best = [], 1.0 if places else 0.0
    ends = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) if fuzzy else spaces
    for label, a, b, edits in fuzzy:
        best = max(best, 1.0 - edits / max(1, b - a))
        first, last = (int(np.searchsorted(ends, x)) for x in (a + (line[a] == " "), b - (line[b - 1] == " ")))
        spans.append({"label": label, "first_word": first, "last_word": last, "edits": edits})
        labels.add(label)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)),
        best, spans,
    )


def scan(docs: DataFrame) -> DataFrame:
    """Licenses of every document: one row per row of ``docs`` (columns doc_id, text; others are ignored).

    Words, phrases and places count in the folded text. ``score`` is 1.0 where a base phrase stands, else the share of
    unedited characters of the best fuzzy match, else 0.0. Null and empty texts have no words and score 0.0; a null
    doc_id stays null; repeated rows are judged each on its own; an empty table gives no rows.
    """

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def judged(texts: list[str | None]) -> dict:
        return dict(zip(names, zip(*map(scan_text, texts))))

    return map_texts(ids_and_texts(docs), judged, SCHEMA)
