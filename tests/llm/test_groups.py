"""Operators on whole tables: exact and near duplicates, mixing, search, URL rules and the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, rows_of, sql_rows
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, near_dedup, queries, topk, url_rules
from ledgerloom.llm.common import written

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, file string, row string, digest string, key string, place string, doc string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    assert rows_of(queries.queries()[name](spark, SF)) == sql_rows(con, queries.oracle_sql()[name])


COPIES = [(5, "a  b", "s"), (3, "a b", "s"), (3, "a b", "s"), (None, "a\tb", None), (9, None, "s"), (8, "", "t"), (7, " ", "t"), (1, "long " * 50_000, "t"), (2, "x", None), (4, "y", None)]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string"), lambda c: F.lit("one")])
def test_copies_with_strong_and_weak_digests(spark, digest):
    got = exact_dedup.decide(table(spark, COPIES), digest).collect()
    groups = defaultdict(list)
    for i, t, _ in COPIES:
        groups[normal(t)].append(i)
    want = sorted((str(i), str(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)])) for i, t, _ in COPIES)
    assert sorted((str(r.doc_id), str(r.keep.doc_id), r.group_size) for r in got) == want


def test_only_texts_of_repeated_digests_are_compared(spark):
    """Unique texts do not reach the check of bytes; a clash of weak digests among many rows does."""
    rows = [(i, f"only once {i} " * 50, "s") for i in range(300)] + [(1000 + i, "", "s") for i in range(40)] + [(2000 + i, f"same length {i % 3}", "s") for i in range(30)]
    got = exact_dedup.decide(table(spark, rows), lambda c: F.length(c).cast("string")).collect()
    size = Counter(normal(t) for _, t, _ in rows)
    text = {i: normal(t) for i, t, _ in rows}
    assert len(got) == len(rows) and all(r.group_size == size[text[r.doc_id]] and r.keep.doc_id == min(i for i in text if text[i] == text[r.doc_id]) for r in got)


def test_bits_of_hits(spark):
    """Every digest that was hit again has its bit; of the others hardly any has."""
    state = spark.range(4000).selectExpr("concat('d', id) AS digest", "1 + id % 2 AS group_size")
    bits = exact_dedup.hit_bits(state)
    rows = state.join(bits, F.bitmap_bucket_number(exact_dedup._place()) == F.col("bucket"), "left").withColumn("hit", F.coalesce(exact_dedup._bit(), F.lit(False)))
    n = {(r.group_size, r.hit): r["count"] for r in rows.groupBy("group_size", "hit").count().collect()}
    assert n[2, True] == 2000 and n[1, False] >= 1990 and (2, False) not in n


def test_one_row_of_each_group_stays(spark):
    got = exact_dedup.exact_dedup(table(spark, COPIES)).collect()
    assert sum(r.kept for r in got) == len({normal(t) for _, t, _ in COPIES})
    assert all(r.text_sha256 in {hashlib.sha256(normal(t).encode()).hexdigest() for _, t, _ in COPIES} for r in got)
    docs = table(spark, COPIES)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([("d", i, "f", i) for i in ids], exact_dedup.STREAMED)
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows([5, 7]).write.mode("append").parquet(source)
    exact_dedup.stream_keepers(exact_dedup.read_stream(spark, source), out, state)
    rows([3]).write.mode("append").parquet(source)
    exact_dedup.stream_keepers(exact_dedup.read_stream(spark, source), out, state)
    (r,) = exact_dedup.keepers(spark, out).collect()
    assert (r.keep.doc_id, r.group_size) == (3, 3)


def weighted_sets(texts):
    text, element, count = near_dedup.counted(texts)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(element[a:b], near_dedup.weight_of(count[a:b])) for a, b in zip(cuts, cuts[1:])]


def brute_components(texts, threshold=0.8):
    sets = weighted_sets(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i][0]) and len(sets[j][0]) and near_dedup.similarity(sets[i], sets[j]) >= threshold:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = brute_components([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    assert got == {r.doc_id: rows[k].doc_id for r, k in zip(rows, want)}


def test_chains_of_near_copies_and_odd_rows(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[i * 12 : i * 12 + 150]) for i in range(12)]  # neighbours are near, ends are not
    other = [" ".join(f"v{i}" for i in range(90)), None, "", "...", "two words", "two words"]
    texts = chain + other
    docs = table(spark, [(i if i != 13 else None, t, "s") for i, t in enumerate(texts)])
    want = brute_components(texts)
    got = near_dedup.near_dedup(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and by_id[14].class_id == 14 and by_id[15].kept and by_id[17].class_id == 16
    assert all(by_id[i].class_id == want[i] for i in by_id if i is not None and i not in (14, 15))
    assert near_dedup.near_dedup(table(spark, [])).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def edited(seed, n, most, words=200):
    """n copies of one text with up to ``most`` words replaced: a loose group, whose members are at most similarities."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        t = [f"w{i}" for i in range(words)]
        for i in rng.choice(words, rng.integers(0, most + 1), replace=False):
            t[i] = f"x{rng.integers(1000)}"
        texts.append(" ".join(t))
    return texts


def linked_pairs(texts, threshold=0.8):
    sets = weighted_sets(texts)
    return [(i, j, s) for i, j in itertools.combinations(range(len(texts)), 2) if (s := near_dedup.similarity(sets[i], sets[j])) >= threshold]


def test_small_buckets_are_compared_in_full(spark):
    """With one bucket of all texts, as many rounds as texts find every link."""
    texts = edited(4, 40, 9)
    docs = written(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), "stray")
    reps = near_dedup.representatives(near_dedup.sketched(docs)).withColumn("bands", F.array(F.lit(1).cast("long")))
    roots = {r.node: r.root for r in near_dedup.links(docs, reps, rounds=40).collect()}
    ids = {r.fp: r.id for r in reps.collect()}
    own = [ids[r["fp"]] for r in near_dedup.sketched(docs).orderBy("doc_id").collect()]
    got = [roots.get(i, i) for i in own]
    want = brute_components(texts)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def roots_in_one_bucket(spark, texts, rounds):
    """The groups of texts that all stand in one bucket, by the leaders' rounds alone."""
    docs = written(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), "stray")
    reps = near_dedup.representatives(near_dedup.sketched(docs)).withColumn("bands", F.array(F.lit(1).cast("long")))
    roots = {r.node: r.root for r in near_dedup.links(docs, reps, rounds=rounds).collect()}
    ids = {r.fp: r.id for r in reps.collect()}
    return [roots.get(i, i) for i in (ids[r["fp"]] for r in near_dedup.sketched(docs).orderBy("doc_id").collect())]


def test_a_round_without_pairs_is_no_end(spark):
    """Whichever text leads first: one is four times as long as the two near copies, so that a round can give no pair."""
    for seed in range(2):
        a = edited(seed, 2, 1)
        long = " ".join(f"z{seed}x{i}" for i in range(800))
        got = roots_in_one_bucket(spark, [long, *a], near_dedup.ROUNDS)
        assert got[1] == got[2] != got[0]


def test_rounds_without_a_bound_are_exact(spark):
    """A loose bucket: strangers, strangers of other sizes and two groups, one of them a chain."""
    words = [f"w{i}" for i in range(300)]
    texts = edited(9, 6, 3) + [" ".join(words[i * 12 : i * 12 + 150]) for i in range(4)] + [" ".join(f"q{k}x{i}" for i in range(20 * 2**k)) for k in range(3)]
    random.Random(3).shuffle(texts)
    got, want = roots_in_one_bucket(spark, texts, None), brute_components(texts)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def loose_bucket():
    """Fourteen pairs and a chain, strangers to each other but for a passage that all have: more than four leaders can join."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + t.replace("w", f"w{k}x") for k in range(14) for t in edited(k, 2, 2)]
    words = [f"c{i}" for i in range(300)]
    texts += [" ".join(words[i * 12 : i * 12 + 150]) for i in range(4)]
    random.Random(8).shuffle(texts)
    return texts


@pytest.mark.parametrize("rounds", [0, 1, near_dedup.ROUNDS])
def test_what_the_rounds_leave_is_joined_exactly(spark, rounds):
    texts = loose_bucket()
    got, want = roots_in_one_bucket(spark, texts, rounds), brute_components(texts)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) == 15


def test_dedup_of_a_loose_bucket_is_exact(spark, monkeypatch):
    """The pipeline's stage: of every group in one bucket of all texts one row stays."""
    texts, plain = loose_bucket(), near_dedup.representatives
    monkeypatch.setattr(near_dedup, "representatives", lambda rows: plain(rows).withColumn("bands", F.array(F.lit(1).cast("long"))))
    assert near_dedup.deduplicated(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).count() == 15


def test_recall_in_a_loose_group(spark):
    """300 copies at 0.3 to 1.0 of each other: rounds of leaders keep at least 0.99 of the links, and add none."""
    texts = edited(5, 300, 16)
    pairs = linked_pairs(texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    want = brute_components(texts)
    assert np.mean([got[i] == got[j] for i, j, _ in pairs]) >= 0.99 and len(pairs) > 2000
    assert all(len({want[i] for i in got if got[i] == c}) == 1 for c in set(got.values()))
    assert len(set(want)) > 20


def test_counts_weigh_by_their_logarithm(spark):
    """A line that stands a hundred times in two texts that share nothing else makes them no near copies."""
    line = "one line of ten words that stands here very often "
    texts = [line * 100 + " ".join(f"{c}{i}" for i in range(150)) for c in "ab"] + [" ".join(f"c{i}" for i in range(150)) + " " + line * k for k in (3, 4)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for n in (5, 60, 3000):
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        wa = rng.integers(1, 6, n).astype(float)
        wb = np.where(rng.random(n) < 0.3, rng.integers(1, 9, n), wa).astype(float)
        v = near_dedup.signatures(np.repeat([0, 1], n), np.concatenate([a, a]), np.concatenate([wa, wb]), 2, 4000)
        assert abs((v[0] == v[1]).mean() - near_dedup.similarity((a, wa), (a, wb))) < 0.04


def test_components_of_long_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(70, 80), (90, 90)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[80] == 70 and 90 not in got


def fill(sizes, weights, most=3):
    """Water-filling by the definition: clamp, share the excess anew by weight, repeat."""
    capped = set()
    total = sum(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [most * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))]
        new = {i for i in range(len(sizes)) if i not in capped and target[i] > most * sizes[i]}
        if not new:
            return target
        capped |= new


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    names = ["b", "a", None, "é", "z", "", "empty"]
    scale = [400, 30, 5, 60, 2, 20, 0]
    rows, doc = [], itertools.count()
    for name, n in zip(names, scale):
        rows += [(next(doc), " ".join(["w"] * int(rng.integers(1, 40))), name) for _ in range(n)]
    rows += [(next(doc), None, "empty"), (None, "a b", "b")]
    got = mixing.mix(table(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, fill([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    by_source = defaultdict(list)
    source = {i: s for i, _, s in rows}
    for r in got:
        by_source[source[r.doc_id]].append(r)
        assert r.taken <= 3 * r["size"]
    for s, rs in by_source.items():
        assert abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s]) and rs[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in rs) - want[s]) <= 20
    assert sorted(got, key=str) == sorted(mixing.mix(table(spark, rows)).collect(), key=str)
    mixed = mixing.mixed(table(spark, rows))
    assert mixed.count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(1 for _ in ()) + mixed.where("text IS NULL").count()
    assert mixing.mix(table(spark, [])).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[10:20] = x[9]  # ties
    x[60:100] = x[200] * 3  # more ties than ranks, over the borders of blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [2.0] * 3), (None, [1.0] * 16), (905, []), (40, x[7].tolist()), (40, x[7].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    got = topk.top_k(v, F.expr("vec_id % 20 = 0 OR vec_id >= 900"), 20, query_block=4, block=64).collect()
    all_ids = [*range(300), None, 40, 40]
    ints = np.floor(64 * np.concatenate([x, np.ones((1, 16)), x[7:8], x[7:8]]).astype(float)).astype(np.int64)
    for q in range(0, 300, 20):
        mine = sorted((r["rank"], r.vec_id if r.vec_id is not None else 10**6, r.score) for r in got if r.query_id == q)
        want = []
        for own in [q] if q != 40 else [40, 301, 302]:
            s = ints @ ints[own]
            ids = [10**6 if i is None else i for i in all_ids]
            best = sorted((i for i in range(len(s)) if i != own), key=lambda i: (-s[i], ids[i]))[:20]
            want += [(n, ids[i], s[i]) for n, i in enumerate(best, 1)]
        assert mine == sorted(want)
    assert [(r.query_id, r.vec_id) for r in got if r.query_id in (903, 904)] in ([(903, 904), (904, 903)], [(904, 903), (903, 904)])
    assert topk.top_k(v.limit(0), F.lit(True)).count() == 0


def test_search_in_very_long_and_very_large_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**24), 2**24, (12, 3000)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_k(v, F.expr("vec_id < 2"), 5, scale=1, block=4).collect()
    for q in (0, 1):
        s = {i: sum(int(a) * int(b) for a, b in zip(x[q], x[i])) for i in range(12) if i != q}
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == sorted(s.items(), key=lambda e: (-e[1], e[0]))[:5]


def test_copied_blocks_are_never_broadcast(spark):
    """Files of blocks are small, their copies for all blocks of the other side are not: no broadcast may gather them in the driver."""
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    rows = topk.scaled(v, F.expr("vec_id % 20 = 0"))
    pairs = topk.paired(topk.packed(rows.where("asked"), 3, 1), topk.packed(rows, 5, 2), 3, 5)
    assert pairs.count() == 15
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {r.width for r in pairs.select("width").collect()} == {2}


def test_components_travel_in_few_bytes():
    for top, width in ((127, 1), (128, 2), (2**15, 4), (2**31, 8), (-(2**63), 8)):
        made = topk.narrow(np.array([[top, 0], [1, -1]], np.int64))
        assert made.itemsize == width and made.tolist() == [[top, 0], [1, -1]]
    assert topk.narrow(np.zeros((0, 3), np.int64)).itemsize == 1


def test_url_rules(spark):
    urls = [
        "https://A.Example.COM/de/x?y#z", "https://example.net/en/1", "http://sub.example.net/fr/1", "https://x.org/fr/", "https://x.org/FR/", "no scheme", None, "a://b://c/d", "https://example.com?x=/de/", "http://casino-win.example.com/en/1",
    ]
    urls += ["http://" + "x" * 100_000 + ".com/" + "y/" * 20_000, urls[0]]
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)] + [(100 + i, f"https://casino-w{i % 2}.example.com/en/{i}", "", "", "") for i in range(30)] + [(200 + i, f"https://news{i % 3}.example.com/en/{i}", "", "", "") for i in range(60)], "page_id long, url string, tokens string, host string, mined string")
    labels = spark.createDataFrame([(i, i < 200) for i in [*range(100, 112), *range(200, 260)]] + [(4, None), (None, True), (9, False), (9, True)], "page_id long, blocked boolean")
    got = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    assert [got[i].rule for i in range(9)] == ["example.com/de/", "example.net/en/", "net/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert (got[0].host, got[0].path, got[7].host, got[7].path, got[5].host, got[6].path) == ("a.example.com", "/de/x", "b:", "//c/d", "", "")
    assert got[9].verdict == "block" and got[9].rule is None and got[120].verdict == "block" and got[4].verdict == "allow"
    assert (len(got[10].host), got[10].verdict, got[11].rule, len(got)) == (100_004, "allow", "example.com/de/", 102)
    assert url_rules.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_rules.judge(pages.where("page_id > 11"), labels.limit(0)).collect()} == {"allow"}


def test_given_labels_make_url_rules(spark):
    """All labelled pages of a host are bad, most of its pages have no label: the host is blocked, one with mixed labels is not.
    With the labels turned round the rules turn too."""
    hosts = {"murk.example.org": 0, "plain.example.org": 1}
    pages = spark.createDataFrame([(100 * k + i, f"https://{h}/en/{i}") for h, k in hosts.items() for i in range(50)], "page_id long, url string")
    for bad, ok in ((0, 100), (100, 0)):
        labels = spark.createDataFrame([(bad + i, True) for i in range(12)] + [(ok + i, i % 2 == 0) for i in range(12)], "page_id long, blocked boolean")
        got = {r.verdict: r.host for r in url_rules.judge(pages, labels).select("host", "verdict").distinct().collect()}
        assert got["block"] == ("murk.example.org", "plain.example.org")[bad // 100] and len(set(got.values())) == 2


def test_url_support_is_a_count_of_labelled_pages(spark):
    """A bad host of six labelled pages among 3,000: no bar that grows with the table allows it."""
    urls = [f"https://news{i % 7}.example.com/en/{i}" for i in range(3000)] + [f"https://a.mu-rk{i % 2}.example.org/en/{i}" for i in range(12)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, False) for i in range(3000)] + [(3000 + i, True) for i in range(0, 12)], "page_id long, blocked boolean")
    got = url_rules.judge(pages, labels).where("verdict = 'block'")
    assert sorted(r.page_id for r in got.collect()) == list(range(3000, 3012))
    hosts = spark.createDataFrame([(i, f"https://{'x.y' if i % 2 else 'x-y'}.example.com/en/") for i in range(200)], "page_id long, url string")
    judged = url_rules.judge(hosts, spark.createDataFrame([(i, i % 2 == 1) for i in range(100)], "page_id long, blocked boolean"))
    assert {(r.host, r.verdict) for r in judged.collect()} == {("x.y.example.com", "block"), ("x-y.example.com", "allow")}


def test_urls_of_pages_against_brute_force(spark):
    """Whole table: base rules by hand, and rules of up to three tokens from counting all combinations."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labels = written(url_rules.evidence(pages), "labels")
    assert labels.select("page_id").distinct().count() > 200
    spoilt = pages.select("page_id", (F.crc32(F.split("url", "/")[2]) % 4 == 0).alias("blocked")).where("blocked")  # whole hosts
    labels = labels.unionByName(spoilt)
    bad = {}
    for r in labels.collect():
        bad[r.page_id] = bad.get(r.page_id, False) or r.blocked
    got = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    tokens = {r.page_id: frozenset(r.tokens) for r in url_rules.parsed(pages).collect()}
    n, hits = Counter(), Counter()
    ruled = {i for i, r in got.items() if r.rule is not None}
    for i, t in tokens.items():
        if i in bad and i not in ruled:
            for k in (1, 2, 3):
                for c in itertools.combinations(sorted(t), k):
                    n[c] += 1
                    hits[c] += bad[i]
    rules = [set(c) for c, x in hits.items() if x >= url_rules.MIN_COUNT and x / n[c] >= url_rules.MIN_CONFIDENCE]
    for r in pages.select("page_id", "url").collect():
        host, path = "", ""
        if m := re.match(r".*?://([^/?#]*)([^?#]*)", r.url or "", re.S):
            host, path = m[1].lower(), m[2]
        fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        x = got[r.page_id]
        assert (x.host, x.path, x.rule) == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert x.verdict == max(fit)[2]
        elif x.mined is None:
            assert x.verdict == "allow" and not any(c <= tokens[r.page_id] for c in rules)
        else:
            assert x.verdict == "block"
    assert len(got) == pages.count() and rules


def test_url_items_make_the_same_rules(spark):
    """Merged and set-apart tokens leave the pages that plain mining's rules match."""
    rng = random.Random(5)
    drawn = [(["all", *[t for t in "abcd" if rng.random() < 0.5]], rng.random()) for _ in range(300)]
    data = [(t + ["a2"] * ("a" in t) + ["p", "p2"] * (x < 0.1), x < 0.1 or ("a" in t and "b" in t and x < 0.9)) for t, x in drawn]
    rows = spark.createDataFrame(data, "tokens array<string>, blocked boolean")
    words = url_rules.vocabulary(rows)
    plain = [set(r.tokens) for r in url_rules.mine(rows).collect()]
    same = {r.token: r.item for r in words.collect()}
    ours = [set(r.tokens) for r in url_rules.rules_of(rows, words).collect()]
    probes = [set(t) for t, _ in data] + [set(c) for k in range(4) for c in itertools.combinations(["all", "a", "a2", "b", "c", "d", "p", "p2"], k)]
    hit = [any(r <= t for r in plain) for t in probes]
    assert hit == [any(r <= {same.get(x) for x in t} for r in ours) for t in probes] and any(hit) and not all(hit)


def test_mined_rules_match_brute_force(spark):
    sets = [({"a", "b"}, True)] * 8 + [({"a"}, False)] * 10 + [({"b", "c"}, False)] * 3 + [({"c"}, True)] * 2
    rows = spark.createDataFrame([(sorted(t), y) for t, y in sets], "tokens array<string>, blocked boolean")
    rules = {r.rule_id: (round(r.confidence, 6), r.n) for r in url_rules.mine(rows, 0.7, 2).collect()}
    assert rules == {"b": (round(8 / 11, 6), 8), "a b": (1.0, 8)}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p
    import public_tokenizers
    from ledgerloom.llm import bpe, quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = written(p.STAGES[0][1](spark, docs, ""), "t0")
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.select("doc_id").collect()} == {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    second = written(p.STAGES[1][1](spark, first, ""), "t1")
    best = {}
    for r in first.collect():
        best[normal(r.text)] = min(best.get(normal(r.text), r.doc_id), r.doc_id)
    assert {r.doc_id for r in second.select("doc_id").collect()} == set(best.values())
    third = written(p.STAGES[2][1](spark, second, ""), "t2")
    rows = second.orderBy("doc_id").collect()
    assert {r.doc_id for r in third.select("doc_id").collect()} == {rows[k].doc_id for k in set(brute_components([r.text for r in rows]))}
    fourth = written(p.STAGES[3][1](spark, third, ""), "t3")
    plan = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({k: n for k, n in plan.items() if n})
    last = p.STAGES[4][1](spark, fourth, "").collect()
    codec = bpe.Codec(bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text for r in third.collect()}
    assert Counter((r.doc_id, r.n_tokens) for r in last) == Counter((i, len(codec.encode(texts[i]))) for i, n in plan.items() for _ in range(n))
    assert p.run(spark, "/root/testdata/sf0.001").count() == len(last)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash, and an empty table."""
    import corpus_pipeline as p

    long = " ".join(f"word{i}" for i in range(30_000))
    text = " ".join(f"plain{i % 60} words" for i in range(80))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " and more of it", None, None), (3, None, None, None), (4, "", "en", "a"), (5, long, "en", "b"), (6, long + " end", "en", "b"), (None, None, None, None)]
    rows += [(10 + i, f"a sentence of some words number {i} that stands here once and is good", "en", "c") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, file string, row string, fp string, id string, _0 string, doc string, place string, key string"
    docs = spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    first = p.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), "")
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} >= {1, 10, 49}
    got = p.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in got}
    assert {10 + i for i in range(40)} <= ids | {None} | set(range(10, 50)) and not ids & {3, 4} and len(ids & {5, 6}) <= 1
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(words), " ".join(words[:58_000] + ["x"] * 10), " ".join(words[30_000:])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_mix_of_very_long_texts(spark):
    rows = [(0, "w " * 400_000, "a"), (1, "w " * 10, "a"), (2, "w " * 500, "b"), (3, None, "b")]
    got = {r.doc_id: r for r in mixing.mix(table(spark, rows)).collect()}
    assert got[0]["size"] == 400_000 and got[3]["size"] == 0 and got[2].target == 1500.0 and got[2].taken == 1500
