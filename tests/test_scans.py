"""Carry-forward in ranges, smallest discriminators and contamination, against plain loops."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import carry, contamination, discriminate
from ledgerloom.sources import outline


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_outlines_are_the_same_for_any_ranges(spark, ranges):
    r = random.Random(4)
    lines, want = [], []
    for doc, n in (("hot", 400), ("b", 30), ("c", 1), (None, 20)):
        stage = segment = None
        for i in range(n):
            kind = r.choice("sgccccx")
            line = {"s": f"[stage {i}]", "g": f"({i})", "c": f"{i} name {i}", "x": "other"}[kind]
            lines.append((doc, i, line))
            if kind == "s":
                stage, segment = f"stage {i}", None
            elif kind == "g":
                segment = str(i)
            elif kind == "c":
                want.append((doc, i, stage, segment, str(i), f"name {i}"))
    df = spark.createDataFrame(lines, "doc string, no int, line string").repartition(5)
    got = sorted((tuple(x) for x in outline.carry_forward(df, "doc", "no", "line", ranges).collect()), key=str)
    assert got == sorted(want, key=str)


def test_carried_values_and_their_places(spark):
    df = spark.createDataFrame([("d", 1, None), ("d", 2, 7), ("d", 3, None), ("e", 1, None), ("e", 9, 5)], "d string, p int, v int")
    got = {(r.d, r.p): (r.last.at, r.last.value) if r.last else None for r in carry.carried(df, "d", "p", {"last": F.col("v")}, 4).collect()}
    assert got == {("d", 1): None, ("d", 2): (2, 7), ("d", 3): (2, 7), ("e", 1): None, ("e", 9): (9, 5)}
    assert carry.carried(df.limit(0), "d", "p", {"last": F.col("v")}).count() == 0


def test_smallest_discriminators_against_all_subsets(spark):
    r = random.Random(2)
    names = ("a", "b", "c", "d")
    rows = [(i, r.choice([1, 1, 1, 2, None]), *[r.choice(["x", "y", "z", "", None, " "]) for _ in names]) for i in range(120)]
    rows += [(200 + i, 3, "same", "same", "same", "same") for i in range(3)] + [(300, 4, "", None, " ", "")]
    df = spark.createDataFrame(rows, "id int, ctx int, a string, b string, c string, d string")
    clean = [(i, c, [v if v is not None else "" for v in vs]) for i, c, *vs in rows]
    want = {}
    for i, c, vs in clean:
        for s in (s for k in (1, 2, 3) for s in combinations(range(4), k)):
            if all(vs[j].strip() for j in s) and sum(c2 == c and all(v2[j] == vs[j] for j in s) for _, c2, v2 in clean) == 1:
                want[i] = (len(s), ",".join(names[j] for j in s))
                break
    got = {x.id: (x.size, x.attributes) for x in discriminate.smallest(df, "id", ["ctx"], names).collect()}
    assert got == want and {s for s, _ in want.values()} == {1, 2, 3}
    assert discriminate.smallest(df.limit(0), "id", ["ctx"], names).count() == 0


def test_shares_against_all_runs(spark):
    r = random.Random(7)
    word = lambda: r.choice("abcdefghij")
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 14)))) for i in range(40)] + [(90, None), (91, " "), (92, "only here never there")]
    texts = []
    for i in range(50):
        parts = [" ".join(word() for _ in range(r.randrange(12)))] + [r.choice(items)[1] or "" for _ in range(r.randrange(3))]
        texts.append((i, "  ".join(parts).upper() if i % 5 == 0 else "\n".join(parts)))
    texts += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    want = {}
    for n, (i, t) in ((3, x) for x in items):
        w = (t or "").split()
        spans = [(p, w[p : p + n]) for p in range(max(len(w) - n + 1, 1 if w else 0))]
        for d, t2 in texts:
            v = (t2 or "").lower().split()
            runs = {tuple(v[p : p + k]) for k in range(1, n + 1) for p in range(len(v) - k + 1)}
            covered = {p + j for p, run in spans if tuple(run) in runs for j in range(len(run))}
            if w and len(covered) >= 0.5 * len(w):
                want[i, d] = (len(w), len(covered))
    df = spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(texts, "doc int, text string")
    got = contamination.contained_share(*df, "item", "doc", run=3).collect()
    assert {(x.item, x.doc): (x.n_words, x.covered) for x in got} == want and len(got) == len(want) > 60
    assert contamination.contained_share(df[0].limit(0), df[1], "item", "doc").count() == 0 == contamination.contained_share(df[0], df[1].limit(0), "item", "doc").count()
