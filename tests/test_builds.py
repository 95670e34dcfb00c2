"""Selection of files, typed records and stored graphs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import snapshots
from ledgerloom.sources import records, selection


@pytest.mark.parametrize(("rule", "name", "text", "want"), [
    (selection.investment, "被投資公司（名稱）、所在 地區", None, "by_name"), (selection.investment, "附表", "投資公司,被投資公司名稱,所在地區\n", "by_content"),
    (selection.investment, "附表", "a\nb\nc\nd\ne\n投資公司,被投資公司名稱,所在地區", "not_target"), (selection.investment, "附表", "被投資公司,所在地區", "by_content"), (selection.investment, None, None, "not_target"),
    (selection.related_parties, "關係人名稱_及關係", "", "by_name"), (selection.related_parties, "關係人名稱及關係_交易", "", "excluded_keyword"), (selection.related_parties, "關係", "", "not_target"),
    (selection.transactions, "應付關係人款項", "", "by_name"), (selection.transactions, "應付關係人款項_facts", "", "excluded_keyword"), (selection.transactions, "x", "", "not_target"),
])
def test_reasons_of_files(spark, rule, name, text, want):
    df = spark.createDataFrame([("/a/x.csv", name, text), ("/a/x.CSV", name, text), ("/a/x.txt", name, text), (None, name, text)], "path string, name string, text string")
    got = [r.reason for r in df.select(rule(F.col("path"), F.col("name"), F.col("text")).alias("reason")).collect()]
    assert got == [want, want, "not_csv", "not_csv"]


def test_kept_and_rejected_files_are_two_outputs(spark):
    df = spark.createDataFrame([("a.csv", "應收關係人款項", ""), ("b.csv", "x", "")], "path string, name string, text string")
    good, bad = selection.selected(df, selection.transactions)
    assert [(r.path, r.reason) for r in good.collect()] == [("a.csv", "by_name")] and [(r.path, r.reason) for r in bad.collect()] == [("b.csv", "not_target")]


def test_typed_rows_and_reasons(spark):
    rows = [
        (["A", "B", "1", "X", "Y", "1,000", "-", "( 5 )", "12.5%", "x", "nan", "note", "e1", "e2"], None), (["A"], "no_investee"), (["", "B"], None), ([], "blank"), (None, "blank"), ([" ", "nan", None], "blank"),
        (["投資公司名稱", "x"], "header"), (["a", "b", "所在地區"], "header"), (["合計", "B"], "total"), (["A", "總計"], "total"), (["合計", ""], "total"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "row int, cells array<string>")
    good, bad = records.investments(df)
    assert {r.row: r.reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(rows) if w}
    got = {r.row: r for r in good.collect()}
    assert set(got) == {0, 2} and bad.columns == ["row", "cells", "reason"]
    assert (got[0].original_investment_end, got[0].original_investment_prior, got[0].shares_held, got[0].ownership_percent, got[0].book_value, got[0].extra) == (1000.0, None, -5.0, 12.5, None, ["e1", "e2"])


def test_filings_give_the_table_of_one_build(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", "d", "e", None]), i, r.choice([None, f"p{i}"]), r.choice([None, f"q{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, p string, q string")
    want = {}
    for k, i, p, q in rows:
        if k is not None:
            old = want.get(k, (None, None, None))
            want[k] = (p if p is not None else old[0], q if q is not None else old[1], i)
    for name, cuts in (("one", [200]), ("three", [20, 150, 200]), ("again", [50, 200])):
        path, start = f"file://{tmp_path}/{name}", 0
        for end in cuts:
            filing = df.where(f"seq >= {start} AND seq < {end}")
            table = snapshots.upsert(filing, path, "key", ["p", "q"], parts=3)
            if name == "again":
                table = snapshots.upsert(filing, path, "key", ["p", "q"], parts=3)
            start = end
        assert {x.key: (x.p, x.q, x.seq) for x in table.collect()} == want


def test_only_changed_partitions_are_written(spark, tmp_path):
    import os

    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(f"k{i}", 1, "x") for i in range(50)], "key string, seq long, p string")
    snapshots.upsert(rows, path, "key", ["p"], parts=8)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "t") for f in fs if f.endswith(".parquet")}
    before = files()
    table = snapshots.upsert(rows.where("key = 'k7'").withColumns({"seq": F.lit(2).cast("long"), "p": F.lit("y")}), path, "key", ["p"], parts=8)
    assert len(before - files()) == 1 and len(before & files()) == len(before) - 1
    assert {x.key: x.p for x in table.collect()} == {f"k{i}": "y" if i == 7 else "x" for i in range(50)}
    assert snapshots.upsert(rows.limit(0), path, "key", ["p"], parts=8).count() == 50


def test_graphs_of_differing_columns(spark):
    a = spark.createDataFrame([("x", "12%")], "source string, ownership_percent string")
    b = spark.createDataFrame([("y", 1)], "source string, n int")
    got = {r._graph_source: (r.source, r.ownership_percent, r.n) for r in snapshots.loaded({"a": a, "b": b}).collect()}
    assert got == {"a": ("x", "12", None), "b": ("y", None, 1)}
