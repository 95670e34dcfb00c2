"""Operators on small tables: relaxation, gates, graphs, scores, HTML, chunks and fuzzy names."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checked, chunking, evaluate, fuzzy, graph, relax, retrieve, routing
from ledgerloom.sources import html_tables, outline


def test_relaxation_keeps_all_rows_when_none_fits(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, None), (3, None)], "q int, v string")
    got = sorted((r.q, r.v) for r in relax.relax_filter(df, ["q"], F.col("v") == "a").collect() if r.v is not None)
    assert got == [(1, "a"), (2, "b")]
    assert relax.relax_filter(df, ["q"], F.col("v") == "a").where("q = 3").count() == 1


def test_gate_decisions(spark):
    df = spark.createDataFrame([(1, "5"), (1, "5"), (2, "5"), (2, "6"), (3, None)], "q int, v string")
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "q int")
    got = {r.q: (r.decision, r.answer) for r in relax.unique_gate(df, ["q"], "v", keys).collect()}
    assert got == {1: ("hit_unique", "5"), 2: ("ambiguous", None), 3: ("no_candidate", None), 4: ("no_candidate", None)}


def test_tiers_lists_and_last_rows(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3), (2, "z", 9)], "q int, v string, s int")
    assert {r.q: r.v for r in relax.best_tier(df, ["q"], F.when(F.col("v") == "y", 1).when(F.col("v") == "z", 2)).collect()} == {1: "y", 2: "z"}
    assert {r.q: (r.n_values, r.all_values) for r in relax.list_all(df, ["q"], F.col("v"), "s").collect()} == {1: (2, "x ｜ y"), 2: (1, "z")}
    assert {r.q: r.last_value for r in relax.last_row(df, ["q"], F.col("v"), "s").collect()} == {1: "x", 2: "z"}


def test_contained_words_against_brute_force(spark):
    """Short, long, repeated and overlapping words, among them ones that share all but one run of characters."""
    texts = [(1, "report of TSMC Nanjing"), (2, "nothing"), (3, None), (4, ""), (5, "公司 TSMC Nanjing plant 2"), (6, "aaaaaaaaaaaaaaaaaaaa")]
    words = ["TSMC", "TSMC Nanjing", "", None, "TSMC Nanjing plant 1", "TSMC Nanjing plant 2", "公司", "n", "aaaaaaaaa", "a" * 21]
    t, w = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in words], "w string")
    got = sorted((r.id, r.w) for r in checked.contained(t, w, "id", "text", "w").collect())
    assert got == sorted((i, x) for i, s in texts for x in words if s and x and x in s)
    assert checked.contained(t, w.limit(0), "id", "text", "w").count() == 0


def test_longest_word(spark):
    t = spark.createDataFrame([(1, "report of TSMC Nanjing"), (2, "nothing")], "id int, text string")
    w = spark.createDataFrame([("TSMC",), ("TSMC Nanjing",), ("",)], "w string")
    assert [(r.id, r.w) for r in checked.longest_contained(t, w, "id", "text", "w").collect()] == [(1, "TSMC Nanjing")]


def test_graph_merges_and_hops(spark):
    nodes = spark.createDataFrame([("a", 2, "late"), ("a", 1, " "), ("a", 3, "x"), ("b", 1, None)], "id string, seq int, name string")
    assert {r.id: r.name for r in graph.merge_nodes(nodes, ["name"]).collect()} == {"a": "late", "b": None}
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "y", 4)], "source string, target string, edge_id int")
    anchors = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(r.edge_id for r in graph.one_hop(e, anchors).collect()) == [1, 2, 3]
    assert [r.id for r in graph.neighbours(e, anchors).collect()] == ["c"]
    assert sorted((r.a, r.b, r.c) for r in graph.indirect(e).collect()) == [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    named = graph.named(e.where("edge_id = 1"), nodes.groupBy("id").agg(F.max("name").alias("name")), "source").first()
    assert named.source_name == "x"


def test_rules(spark):
    rules = [{"name": "r", "level": "weak", "any": ["b", "a"], "all": [["c"]], "exclude": ["no"]}]
    df = spark.createDataFrame([("a b c",), ("a b",), ("a c no",), (None,)], "t string")
    got = [[(x.name, x["keywords"]) for x in (r[0] or [])] for r in df.select(graph.matched_rules(F.col("t"), rules)).collect()]
    assert got == [[("r", ["a", "b", "c"])], [], [], []]


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(9, "Rare common")], "qid int, text string")
    got = retrieve.ranked(retrieve.bm25(q, docs), ["qid"], "score", "doc_id").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]


def test_budget_ends_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, "aaaaaa"), (1, 2, "bbbbbbbbb"), (1, 3, "cc"), (2, 1, "d" * 20)], "q int, rank int, t string")
    got = sorted((r.q, r["rank"], r.used) for r in retrieve.within_budget(df, ["q"], "t", "rank", 10).collect())
    assert got == [(1, 1, 6), (2, 1, 10)]


def test_label_sets_and_refusals(spark):
    df = spark.createDataFrame([("供應鏈壓力;營運資金壓力", "營運資金壓力;供應鏈壓力"), ("a;b;c", "a;b"), ("( 5 )", "-5")], "a string, g string")
    assert [r[0] for r in df.select(evaluate.exact(F.col("a"), F.col("g"))).collect()] == [True, False, True]


def test_refusals(spark):
    said = [None, "", " ", "[vLLM error] x", "抱歉，找不到相關資料。", "無法回答", "條件不足，請補充", "無法計算的比率為 5%", "未揭露", "12,345"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(said)], "i int, a string")
    assert [r[0] for r in rows.orderBy("i").select(evaluate.refused(F.col("a"))).collect()] == [True] * 7 + [False] * 3


def test_number_matches(spark):
    rows = spark.createDataFrame([("1,234 和 5", "1234"), ("(5.0) 6", "6 5.0"), ("7", "8 7"), ("x", "y"), (None, "1")], "a string, g string")
    m = evaluate.number_matches(F.col("a"), F.col("g"))
    assert [tuple(r) for r in rows.select(m["numeric"], m["contains"], m["partial"]).collect()] == [(False, True, True), (True, True, True), (False, False, True), (False, False, False), (False, False, False)]


def test_intervals_and_mcnemar():
    low, high = evaluate.clopper_pearson_bounds(0, 10)
    assert low == 0 and math.isclose(high, 0.30849710781876083, abs_tol=1e-9)
    low, high = evaluate.clopper_pearson_bounds(5, 10)
    assert math.isclose(low, 0.1870860284474045, abs_tol=1e-9) and math.isclose(low + high, 1, abs_tol=1e-9)
    assert math.isclose(evaluate.mcnemar_p(2, 13), 0.00738525390625, abs_tol=1e-12)
    assert evaluate.mcnemar_p(0, 0) == 1.0
    for b, c in ((1, 9), (30, 12), (700, 640)):
        n = b + c
        assert math.isclose(evaluate.mcnemar_p(b, c), min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n), rel_tol=1e-9)
    for k, n in ((1, 7), (40, 60), (150, 151)):
        low, high = evaluate.clopper_pearson_bounds(k, n)
        tail = lambda p, xs: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in xs)
        assert math.isclose(tail(low, range(k, n + 1)), 0.025, rel_tol=1e-6) and math.isclose(tail(high, range(k + 1)), 0.025, rel_tol=1e-6)


def test_rouge_and_ranks(spark):
    p = spark.createDataFrame([(1, "a b c", "a b d"), (2, "", "x"), (3, "a", "a")], "id int, a string, g string")
    got = {(r.id, r.n): (r.precision, r.f) for r in evaluate.rouge(p, "id", "a", "g", 1, 2).collect()}
    assert got == {(1, 1): (0.6667, 0.6667), (2, 1): (0.0, 0.0), (3, 1): (1.0, 1.0), (1, 2): (0.5, 0.5), (2, 2): (0.0, 0.0), (3, 2): (0.0, 0.0)}
    long = spark.createDataFrame([(1, "a b c d " * 50_000, "d a b c " * 50_000)], "id int, a string, g string")
    assert evaluate.rouge(long, "id", "a", "g", 3).first().f == 1.0
    g = spark.createDataFrame([([0, 2, 1],), ([0, 0],)], "g array<int>")
    rows = g.select(evaluate.ndcg(F.col("g"), 3), evaluate.reciprocal_rank(F.col("g"))).collect()
    assert rows[0][1] == 0.5 and rows[1][0] == 0.0 and rows[1][1] == 0.0 and 0.6 < rows[0][0] < 0.7


def test_html_spans_and_titles():
    html = """<span class="zh">資產負債表</span><table><tr><th rowspan="2">項目</th><th colspan="2">113Q2</th></tr>
    <tr><th>本期</th><th>上期</th></tr><tr><td>商譽<table><tr><td>inner</td></tr></table></td><td>1,000</td><td>( 5 )</td></tr></table><p>no table</p>"""
    (t,) = html_tables.parse(html)
    assert t["title"] == "資產負債表"
    assert t["grid"][:2] == [["項目", "113Q2", "113Q2"], ["項目", "本期", "上期"]]
    assert t["grid"][2][1:] == ["1,000", "( 5 )"]
    assert html_tables.parse(None) == [] and html_tables.unique_headers(["a", "b", "a"]) == ["a", "b", "a_2"]


def test_decoding_cascade():
    assert html_tables.decoded("資產".encode("big5")) == "資產" and html_tables.decoded("資產".encode("utf-8-sig")) == "資產"


def test_chunks_repeat_headers_and_rows():
    head = "| k | v |\n|---|---|\n"
    assert len(chunking.chunks(head + "\n".join(f"| {i} | x |" for i in range(15)))) == 1
    rows = [f"| {i} | {'y' * 60} |" for i in range(50)]
    head, rows = "| k | name | v |\n|---|---|---|\n", [f"| {i} | {'y' * 50} | 1 |" for i in range(50)]
    out = chunking.chunks(head + "\n".join(["| | 流動資產 Current assets | |", *rows]))
    assert len(out) > 1 and all(c.startswith("| k | name | v |") for c in out) and all("流動資產" in c for c in out)
    assert chunking.is_subtotal("| 11XX | 流動資產合計 | 5 |") and not chunking.is_subtotal("| 1100 | 11XX | 5 |")
    seen = [r for c in out for r in c.split("\n") if r in rows]
    assert set(seen) == set(rows) and len(seen) > len(rows)
    assert chunking.chunks(None) == [] and chunking.chunks("") == []


def test_outline_carries_forward(spark):
    lines = ["[上游]", "(IC設計)", "2330 台積電", "note", "[下游]", "1101 無段", "(封測)", "2303 聯電"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, n int, line string").withColumn("n", F.format_string("%05d", "n"))
    got = [(r.stage, r.segment, r.code) for r in outline.carry_forward(df, "doc", "n", "line").orderBy("n").collect()]
    assert got == [("上游", "IC設計", "2330"), ("下游", None, "1101"), ("下游", "封測", "2303")]


def test_fuzzy_names(spark):
    q = spark.createDataFrame([(1, "b", "goodwil"), (2, "b", "zzz")], "id int, block string, asked string")
    n = spark.createDataFrame([("b", "goodwill"), ("b", "good"), ("c", "goodwil")], "block string, name string")
    assert [(r.id, r.name) for r in fuzzy.best_match(q, n, "block", "asked", "name", "id").collect()] == [(1, "goodwill")]


def test_slots(spark):
    df = spark.createDataFrame([(["113Q2", "2024"], "", "x"), (None, "i", "x")], "p array<string>, item string, c string")
    a, b = (r[0] for r in df.select(routing.validated(F.col("p"), F.col("item"), F.col("c"))).collect())
    assert (a.periods, a.violations, a.missing, a.status) == (["113Q2"], ["illegal period: 2024"], ["item"], "needs_clarification")
    assert (b.periods, b.status) == ([], "ok")


def test_windows_over_many_files_lose_no_rows(spark, tmp_path):
    """Two days of events in each of 2,010 files, whose times overlap: the windows count every row, as the batch does."""
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq
    from ledgerloom.streaming import windows

    (tmp_path / "events").mkdir()
    start = datetime(2024, 1, 1)
    times = pa.array([start, start + timedelta(days=2)], pa.timestamp("us", "UTC"))
    for i in range(2010):
        pq.write_table(pa.table({"ts": times, "kind": ["a", "a"]}), tmp_path / "events" / f"{i:04d}.parquet")
    stream = windows.windowed(windows.stream_files(spark, str(tmp_path / "events")), "ts", "kind").select("kind", "n")
    assert [r.n for r in windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()] == [2010]


def test_facts_have_a_total_order(spark):
    from ledgerloom.jobs.tables import facts

    for sf in ("0.001", "0.01", "0.1"):
        f = facts(spark, f"/root/testdata/sf{sf}")
        n, distinct = f.agg(F.count("*"), F.count_distinct("seq")).first()
        assert n == distinct > 0


def test_order_of_facts_over_several_files(spark, tmp_path):
    from ledgerloom.jobs.tables import facts

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(5).write.option("maxRecordsPerFile", 500).parquet(f"{tmp_path}/lineitem.parquet")
    f = facts(spark, str(tmp_path))
    assert f.count() == f.select("seq").distinct().count()


def test_similar_items_against_brute_force(spark):
    """Every question's item by the ratio of matching blocks among all items of its company, then the gate."""
    from difflib import SequenceMatcher

    from ledgerloom.jobs import lookups
    from ledgerloom.jobs.tables import facts

    sf = "/root/testdata/sf0.001"
    rows = facts(spark, sf).collect()
    got = {r.qid: (r.decision, r.answer, r.tier) for r in lookups.lookup_fuzzy(spark, sf).collect()}
    items, values, first = {}, {}, {}
    for r in rows:
        items.setdefault(r.company, set()).add(r.item_name)
        values.setdefault((r.company, r.item_name, r.period), set()).add(r.value_raw)
        first[r.company, r.item_name] = min(first.get((r.company, r.item_name), r.period), r.period)
    for (company, item), period in first.items():
        asked = item[:-2] + "xn"
        best = max(sorted(items[company]), key=lambda n: SequenceMatcher(None, asked, n).ratio())
        found = values.get((company, best, period), set())
        want = ("hit_unique", min(found), 4) if len(found) == 1 else ("no_candidate" if not found else "ambiguous", None, 4 if found else None)
        assert got[f"{company}|{item}"] == want


def test_fuzzy_match_against_brute_force(spark):
    from difflib import SequenceMatcher

    from ledgerloom.jobs import ingest

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    names = {p.p_name for p in parts}
    want = {}
    for p in parts:
        asked = p.p_name[1:] + "x"
        scored = sorted((-round(SequenceMatcher(None, asked, n).ratio(), 9), n) for n in names)
        if len(p.p_name) > 3 and -scored[0][0] >= 0.6:
            want[p.p_partkey] = scored[0][1]
    assert {r.qid: r.match for r in ingest.fuzzy_match(spark, sf).collect()} == want


def test_chunks_of_the_query_keep_every_row(spark):
    from ledgerloom.jobs import ingest

    sf = "/root/testdata/sf0.001"
    texts = {r.id: r.text.split("\n") for r in ingest._markdown(spark, sf).collect()}
    made = {}
    for r in ingest.chunker(spark, sf).orderBy("id", "chunk_index").collect():
        assert r.content.split("\n")[:2] == texts[r.id][:2] and r.chunk_index < r.total_chunks
        made.setdefault(r.id, []).extend(r.content.split("\n")[2:])
    assert {k: list(dict.fromkeys(v)) for k, v in made.items()} == {k: v[2:] for k, v in texts.items()}


def test_names_scan_longest_first(spark):
    from ledgerloom.operators import lookup

    names = spark.createDataFrame([("台積電", "2330"), ("台灣積體電路", "2330"), ("聯電", "2303"), ("群聯電子", "8299"), ("群聯", "8299")], "name string, code string")
    q = spark.createDataFrame([(1, "聯電與群聯電子比較，再看台積電、台灣積體電路"), (2, "無"), (3, None), (4, "群聯電子")], "qid int, text string")
    assert {r.qid: r.names for r in lookup.scanned(q, names).collect()} == {1: ["聯電", "群聯電子", "台積電"], 4: ["群聯電子"]}


def test_company_codes_by_parts(spark):
    from ledgerloom.operators import lookup

    known = spark.createDataFrame([("聯華電子", 2303), ("台灣積體電路製造", 2330), ("群聯電子", 8299)], "key string, code int")
    aliases = spark.createDataFrame([("大聯大", 3702)], "key string, code int")
    asked = [(1, "聯華電子"), (2, "台灣積體電路"), (3, "聯華電子股份"), (4, "大聯大"), (5, "大聯大電子香港"), (6, None), (7, ""), (8, "電子")]
    got = {r.qid: (r.code, r.tier) for r in lookup.company_codes(spark.createDataFrame(asked, "qid int, name string"), known, aliases).collect()}
    assert got == {1: (2303, 1), 2: (2330, 2), 3: (2303, 2), 4: (3702, 1), 8: (2303, 2)}


def test_discriminators_and_triples(spark):
    from ledgerloom.operators import relations

    rows = spark.createDataFrame([("所在地為【香港】", "香港"), ("帳面價值為2,051,269的被投資公司", "2,051,269"), ("沒有", None), (None, None)], "q string, want string")
    got = rows.select(F.coalesce(relations.discriminator(F.col("q"), "所在地為"), relations.discriminator(F.col("q"), "帳面價值為")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)
    t = spark.createDataFrame([("【113Q2】，【A】與【B】之間的【C】交易金額",), ("這份財報裡，甲跟乙之間的貨款交易金額",), ("於113Q2，甲與乙之間的貨款交易金額是",), ("別的",)], "q string")
    assert [r.t and tuple(r.t) for r in t.select(relations.triple(F.col("q")).alias("t")).collect()] == [("A", "B", "C"), ("甲", "乙", "貨款"), ("甲", "乙", "貨款"), None]


def test_notes_and_numbers_of_pages():
    from ledgerloom.sources import files

    page = "<pre class='note x'>a  b\n\n c</pre><table><tr><td><pre class='note'>in</pre></td></tr></table><p>1</p><div><pre class='note'>near</pre></div>" + "<p></p>" * 30 + "<pre class='note'>far</pre><pre class='note'>near</pre>"
    assert files.notes_of(page) == [(1, "table_or_near_table", 1, "in"), (2, "table_or_near_table", 1, "near"), (3, "global_note", None, "a b\nc"), (4, "global_note", None, "far")]
    assert files.notes_of("<ix:nonNumeric>t</ix:nonNumeric>") == [(1, "global_note", None, "t")] and files.notes_of(None) == []
    assert files.numbers_of("<table><tr><td>商譽</td><td><ix:nonFraction contextRef='c'>1,0</ix:nonFraction></td></tr></table>") == [("商譽", "c", "1,0")]


def test_labels_at_their_edges(spark):
    from ledgerloom.functions import labels

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(labels.cut_bytes(F.lit("公司ab"), 7)) == "公司a" and one(labels.cut_bytes(F.lit(""), 7)) == ""
    assert one(labels.file_name(F.lit("公" * 100))) == "公" * 58 + ".csv" and one(labels.file_name(F.lit(" . "))) == "untitled.csv"
    assert one(labels.segments(F.lit("A: 1 ｜ A：2 | b"))) == {"A": "2"} and one(labels.filter_list(F.lit(None).cast("string"))) == []
    assert one(labels.flat_header(F.lit("record_type"))) == "record_type" and one(labels.symbol(F.lit("3x"), "f")) == "f" and one(labels.quarter_of(F.lit("5"))) == 0


def test_headers_with_other_signs_and_words(spark):
    from ledgerloom.functions import periods

    rows = [("113年1月1日～6月30日", "duration", "current"), ("2023年1月1日到2023年6月30日", "duration", "prior"), ("去年同期累計", "relative", "prior_ytd"), ("期末餘額", "relative", "current_end"), ("金額", "unknown", "unknown"), ("2024年6月30日", "instant", "current")]
    h = spark.createDataFrame(rows, "h string, kind string, role string")
    got = h.select("kind", "role", periods.header_kind(F.col("h")).alias("k"), periods.header_role(F.col("h"), F.lit("113Q2")).alias("r")).collect()
    assert all((r.k, r.r) == (r.kind, r.role) for r in got)


def test_chunks_of_long_tables_take_linear_time():
    import time

    rows = ["| |Section %d| |" % i if i % 997 == 0 else f"|{i}|item {i}|{i * 7}|" for i in range(100_000)]
    began = time.process_time()
    made = chunking.chunks("\n".join(["|a|b|c|", "|-|-|-|", *rows]))
    assert time.process_time() - began < 10 and len(made) > 2000
    for c in made[5:2000:97]:
        first = next(l for l in c.split("\n")[2:] if not chunking.is_section(l))
        at = int(first.split("|")[1])
        assert chunking.is_section(c.split("\n")[2]) and f"Section {at // 997 * 997}" in c


def test_labels_of_items_and_what_is_left(spark):
    from ledgerloom.operators import risks

    q = [
        (1, "甲公司的其他應付款被標記為哪類", "甲公司股份", "", "113Q1"), (2, "其他應付款票據是什麼風險", "甲公司股份", "", None), (3, "Other payables?", "甲公司股份", "Other payables", "113Q1"), (4, "x", "甲公司股份", "Receivab", "120Q1"),
        (5, "應收帳款?", "", "", "113Q2"), (6, "x", "沒有的公司", "", "113Q2"), (7, None, None, None, None), (8, "x", "甲公司股份", "paya", "113Q1"),
    ]
    e = [
        ("甲公司股份有限", "其他應付款", "2024Q1", "流動性", 3), ("甲公司股份有限", "其他應付款 Other payables", "113Q1", "信用", 1), ("甲公司股份有限", "其他應付款票據 Notes payable", "2024Q1", "票據", 2), ("甲公司股份有限", "Receivables", "2024Q1", "應收", 4),
        ("乙公司", "應收帳款", "113Q2", "市場", 5), ("乙公司", "應收帳款 A", "2025Q1", "匯率", 6), ("乙公司", None, None, None, 7),
    ]
    got = {r.qid: (r.answer, r.by) for r in risks.item_labels(spark.createDataFrame(q, "qid int, question string, company string, subject string, quarter string"), spark.createDataFrame(e, "company_name string, item_name string, period string, label string, seq int")).collect()}
    everything = "信用;票據;流動性;應收;市場;匯率"
    assert got == {
        1: ("信用;流動性", "native"), 2: ("票據", "native"), 3: ("信用", "subject"), 4: ("應收", "subject"), 5: ("市場", "native"), 6: ("市場", "company"), 7: (everything, "company"), 8: ("信用;票據;流動性;應收", "company"),
    }


def test_amounts_with_and_without_a_payer(spark):
    from ledgerloom.operators import relations

    rows = [("A", "value_2=BC; value_4=貨款x; value_5=1", 1), ("D", "value_2=B; value_4=貨款; value_5=2", 2), ("D", "value_2=B; value_4=貨款; value_5=", 3), (None, "value_2=Q; value_4=r; value_5=9", 4), ("A", "value_2=Z; value_4=貨款; value_5=5", 5)]
    q = [
        (1, "某公司，A與B之間的貨款交易金額？"), (2, "請問跟關係人B之間的貨款交易金額"), (3, "【公司】，【X】與【B】之間的【貨款】交易是多少"), (4, "與【Z】之間的【貨款】交易"), (5, "與【Q】之間的【r】交易金額"), (6, "與【Q】之間的【r】交易"), (7, "nothing"),
    ]
    edges = relations.transactions(spark.createDataFrame(rows, "payer string, summary string, seq int"))
    got = {r.qid: r.answer for r in relations.amounts(spark.createDataFrame(q, "qid int, question string"), edges).collect()}
    whole = "D；value_2=B; value_4=貨款; value_5="
    assert got == {1: "1", 2: whole, 3: whole, 4: "A；value_2=Z; value_4=貨款; value_5=5", 5: "9"}


def test_accounts_with_pairs_and_clauses(spark):
    from ledgerloom.operators import relations

    rows = [("c", "3", "p1", "value_2=X; value_4=Y; k=7", 1), ("c", "3", "p2", "value_2=X; value_4=Y; k=8", 2), ("c", "3", "p3", "value_2=O; value_4=Y", 3), ("c", "3", "", "last", 9), ("d", "3", "p9", "s", 10)]
    q = [(1, "?", "c", "3"), (2, "與【X】之間的【Y】交易", "c", "3"), (3, "與【X】之間的【Y】交易（k為【7】的那筆）", "c", "3"), (4, "與【N】之間的【Y】交易", "c", "3"), (5, "?", "e", "3"), (6, "（k為【8】的那筆）", "c", "3")]
    got = relations.by_account(spark.createDataFrame(q, "qid int, question string, company string, business string"), spark.createDataFrame(rows, "company string, account string, party string, summary string, seq int"))
    assert {r.qid: r.answer.split("；")[0] for r in got.collect()} == {1: "p3", 2: "p2", 3: "p1", 4: "p3", 6: "p2"}


def test_investees_relax_company_and_period(spark):
    from ledgerloom.operators import relations

    edges = [("I", f"t{i}", c, p, i, loc, "b", "10", "5") for i, (c, p, loc) in enumerate([("C", "P", "TW"), ("C", "P", "US"), ("C", "R", "TW"), ("D", "P", "JP"), ("D", "R", "TW")])]
    e = spark.createDataFrame(edges, "investor string, investee string, company string, period string, seq int, location string, main_business string, ownership_percent string, book_value string")
    q = [(1, "C", "P", "所在地為【TW】", False), (2, "C", "P", "", True), (3, "C", "none", "", True), (4, "none", "R", "", True), (5, "none", "none", "所在地為【JP】", True), (6, "D", "P", "所在地為【XX】", True)]
    asked = spark.createDataFrame([(i, t, "I", c, p, x) for i, c, p, t, x in q], "qid int, question string, investor string, q_company string, q_period string, every boolean")
    got = {r.qid: r.answer for r in relations.investees(asked, e).collect()}
    assert got == {1: "t0", 2: "t0 ｜ t1", 3: "t0 ｜ t1 ｜ t2", 4: "t2 ｜ t4", 5: "t3", 6: "t3"}


def test_current_facts_after_any_batches(spark, tmp_path):
    from ledgerloom.operators import facts as fact_ops
    from ledgerloom.streaming import current

    r = __import__("random").Random(8)
    headers = ["2024年1月1日至2024年3月31日", "2023年12月31日", "2024年3月31日", "none", None]
    rows = [(i, r.choice("ab"), r.choice(["x", None]), r.choice(["113Q1", "113Q2"]), r.choice(headers), r.choice([None, str(i)])) for i in range(90)]
    df = spark.createDataFrame(rows, "seq long, company string, item_name string, period string, column_header string, value_raw string")
    want = sorted(map(str, (tuple(x) for x in fact_ops.current_view(df).select("seq", *current.KEY, "value_raw").collect())))
    for split in range(2):
        root = f"file://{tmp_path}/{split}"
        for k in range(3):
            df.where(F.pmod(F.xxhash64("seq", F.lit(split)), F.lit(3)) == k).write.mode("append").parquet(f"{root}/in")
            current.follow(spark.readStream.schema(df.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/state")
        got = current.view(spark, f"{root}/out", current.corrections(df).schema)
        assert sorted(map(str, (tuple(x) for x in got.select("seq", *current.KEY, "value_raw").collect()))) == want


def test_hubs_and_sets_of_anchors_against_plain_loops(spark):
    r = __import__("random").Random(1)
    pairs = {(f"n{r.randrange(25)}", r.choice(["hub", f"n{r.randrange(25)}"])) for _ in range(120)} | {("hub", f"n{i}") for i in range(0, 25, 3)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "source string, target string, edge_id int")
    want = sorted((a, b, c) for a, b in pairs for b2, c in pairs if b == b2 and a != c and (a, c) not in pairs)
    for in_edges in (1, 3, 1000):
        assert sorted((x.a, x.b, x.c) for x in graph.indirect(edges, in_edges).collect()) == want
    sets = {k: {f"n{i}" for i in range(25) if i % 4 == k} for k in range(3)}
    anchors = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k int, id string")
    assert sorted((x.k, x.edge_id) for x in graph.hops_of(edges, anchors, "k").collect()) == sorted((k, i) for k, s in sets.items() for i, (a, b) in enumerate(pairs) if a in s or b in s)
    near = sorted((x.k, x.id) for x in graph.neighbours_of(edges, anchors, "k").collect())
    assert near == sorted({(k, y) for k, s in sets.items() for a, b in pairs for x, y in ((a, b), (b, a)) if x in s and y not in s})


def test_shortest_paths_against_a_search(spark):
    from ledgerloom.operators import paths

    r = __import__("random").Random(5)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(55)} | {("hub", f"n{i}") for i in range(0, 40, 4)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = [(i, f"n{r.randrange(40)}", r.choice(["hub", "nobody", *(f"n{r.randrange(40)}" for _ in range(8))])) for i in range(80)]
    want = set()
    for i, a, b in asked:
        level = [[a]] if a != b else []
        for length in (1, 2, 3):
            level = [[*p, x] for p in level for x in near.get(p[-1], ()) if x not in p]
            hits = [p for p in level if p[-1] == b]
            level = [p for p in level if p[-1] != b and len(near[p[-1]]) <= 6]
            if hits:
                want |= {(i, length, ">".join(p)) for p in hits}
                break
    df = spark.createDataFrame(asked, "qid int, a string, b string"), spark.createDataFrame(sorted(pairs), "source string, target string")
    got = [(x.qid, x.length, x.path) for x in paths.between(*df, hub=6).collect()]
    assert set(got) == want and len(got) == len(want) and {n for _, n, _ in got} == {1, 2, 3}
    assert paths.between(df[0].limit(0), df[1]).count() == 0
