"""What larger and odder tables showed, on small ones."""

import os

import pytest
from compare import connect, rows_of, sql_rows
from pyspark.sql import functions as F

from ledgerloom.jobs import files as file_jobs
from ledgerloom.jobs import registry
from ledgerloom.operators import discriminate, fuzzy, lookup, paths, relax, risks
from ledgerloom.shared import kept
from ledgerloom.sources import files

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, **tables):
    """The query and its SQL on the small tables, with some of them replaced."""
    for f in os.listdir(SF):
        if f.split(".")[0] not in tables:
            os.symlink(f"{SF}/{f}", folder / f)
    for t, rows in tables.items():
        rows.toPandas().to_parquet(folder / f"{t}.parquet", index=False)
    got = rows_of(registry.queries()[name](spark, str(folder)))
    assert got[1] and got == sql_rows(connect(str(folder)), registry.oracle_sql()[name])


@pytest.mark.parametrize(("name", "balance"), [(lambda k: f"S{k}", lambda k: 100.0 * (k % 7 + 3)), (lambda k: f"S{k // 9}", lambda k: 100.0 * k)])
def test_winners_of_equal_ratios_and_of_equal_names(spark, tmp_path, name, balance):
    rows = [(k, name(k), 1, balance(k)) for k in range(40)]
    same_as_sql(spark, "audit_ratios", tmp_path, supplier=spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))


def test_pages_are_filed_in_bundles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_jobs, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    pages = file_jobs._filed_pages(spark, SF)
    assert pages.select("path").distinct().count() == pages.count() == spark.sql(f"SELECT DISTINCT c_nationkey, c_custkey div 40 FROM parquet.`{SF}/customer.parquet`").count()
    assert len([f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".txt")]) < 10


def test_bundled_pages_come_back(spark):
    rows = [("/a/1", "<p>x</p>"), ("/b", "<pre>two\nlines\n</pre>\n"), ("/c", ""), ("/d", "$1 <!-- page: not at a line's start -->")]
    lines = spark.createDataFrame(rows, "name string, html string").coalesce(1).select(files.bundled(F.col("name"), F.col("html")).alias("v"))
    text = lines.groupBy().agg(F.concat(F.array_join(F.collect_list("v"), "\n"), F.lit("\n")).alias("text"))
    assert sorted(map(tuple, files.pages_of(text, "text").collect())) == rows


def test_repeated_questions_on_risks_are_one(spark, monkeypatch):
    tables, keep = {}, risks.kept
    monkeypatch.setattr(risks, "kept", lambda df, name: tables.setdefault(name, keep(df, name)))
    q = spark.range(500).selectExpr("id AS qid", "if(id % 2 = 0, '應付款x', null) AS question", "concat('甲公司股', id % 5) AS company", "'' AS subject", "if(id % 2 = 0, '113Q1', null) AS quarter")
    e = spark.range(900).selectExpr("concat('甲公司股份', id) AS company_name", "if(id % 3 = 0, '應付款 A', '其他') AS item_name", "'113Q1' AS period", "concat('l', id % 2) AS label", "id AS seq")
    got = {r.qid: (r.answer, r.by) for r in risks.item_labels(q, e).collect()}
    assert got == {i: ("l0;l1", "native" if i % 2 == 0 else "company") for i in range(500)}
    assert tables["risk-questions"].count() == 2 and max(t.count() for name, t in tables.items() if name not in ("risk-evidence", "risk-starts")) < 20


def test_codes_are_joined_without_repeating_their_sides(spark):
    rows = [(i, f"COMPANY{i:08}") for i in range(300)]
    known = spark.createDataFrame(rows, "code long, key string")
    got = lookup.company_codes(spark.createDataFrame([(i, n if i % 2 else f"ASIA{n}HK") for i, n in rows] + [(-1, ""), (-2, None)], "qid long, name string"), known)
    assert {r.qid: (r.code, r.tier) for r in got.collect()} == {i: (i, 1 if i % 2 else 2) for i, _ in rows}
    assert got._jdf.queryExecution().sparkPlan().toString().count("Scan") <= 8


def test_questions_meet_no_single_suppliers(spark, tmp_path, monkeypatch):
    met, f = [], relax.relax_filter
    monkeypatch.setattr(relax, "relax_filter", lambda rows, *a: (met.append(rows.count()), f(rows, *a))[1])
    customers, suppliers = spark.range(30).selectExpr("id AS c_custkey", "cast(id % 2 as int) AS c_nationkey"), spark.range(600).selectExpr("id AS s_suppkey", "cast(id % 2 as int) AS s_nationkey", "id * 10D AS s_acctbal")
    same_as_sql(spark, "relax_filters", tmp_path, customer=customers, supplier=suppliers)
    assert max(met) <= 30 * 14


def test_shuffle_files_go_once_a_table_is_written(spark):
    shuffles = lambda: sum(f.startswith("shuffle_") for d, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names)
    before = shuffles()
    made = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    assert shuffles() <= before and made.count() == 7


def test_filed_facts_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_jobs, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    file_jobs._filed(spark, SF)
    made = [f"{d}/{f}" for d, _, names in os.walk(tmp_path) for f in names if ".csv" in f and not f.endswith(".crc")]
    assert made and sum(map(os.path.getsize, made)) < 5 * os.path.getsize(f"{SF}/lineitem.parquet")


def test_characters_of_names_are_numbered_before_names_meet(spark):
    a, b = (spark.createDataFrame([(w,) for w in words], f"{c} string") for c, words in (("a", ["wordbook", "xyz"]), ("b", ["wordbooks", "abc"])))
    made = fuzzy.candidates(a, b, "a", "b", 0.85)
    counted = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_intersect" in line]
    assert counted and not any("sequence" in line for line in counted) and [tuple(r) for r in made.collect()] == [("wordbook", "wordbooks")]


def test_discriminators_in_slices(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id % 390 AS id", "id % 9 AS c", "id % 5 AS x", "id % 7 AS y", "if(id % 4 = 0, null, id % 41) AS z")
    run = lambda: sorted(map(tuple, discriminate.smallest(rows, "id", ["c"], ("x", "y", "z")).collect()))
    whole, tables, keep = run(), [], discriminate.kept
    monkeypatch.setattr(discriminate, "SLICE", 300)
    monkeypatch.setattr(discriminate, "kept", lambda df, name: (tables.append(name), keep(df, name))[1])
    assert run() == whole and len({r[1] for r in whole}) > 1 and tables.count("discriminate-slice") >= 6


def test_paths_of_three_edges_in_slices(spark, monkeypatch):
    edges = spark.range(60).selectExpr("concat('n', id % 30) AS source", "concat('n', (id * 7 + id div 30) % 41) AS target")
    asked = spark.range(200).selectExpr("id AS qid", "concat('n', id % 41) AS a", "concat('n', (id * 3 + 1) % 41) AS b")
    run = lambda: sorted(map(tuple, paths.between(asked, edges, 12).collect()))
    whole, tables, keep = run(), [], paths.kept
    monkeypatch.setattr(paths, "SLICE", 40, raising=False)
    monkeypatch.setattr(paths, "kept", lambda df, name: (tables.append(name), keep(df, name))[1])
    assert run() == whole and any(r[1] == 3 for r in whole) and tables.count("paths-3") > 1
