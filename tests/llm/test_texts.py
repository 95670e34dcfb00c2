"""Operators on single texts: BPE, licenses, quality, toxicity and language, with odd rows throughout."""

import gc
import hashlib
import random
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, language, licenses, quality, toxicity
from ledgerloom.llm.common import Words, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, _metadata string"
ODD = [None, "", " \t\n", "x", "word " * 60_000, "<|endoftext|> mix <|startoftext|>", "É e\u0301 \x1c\x00 ΣΑΣ İ ﬁ 漢字 😀", "same text here", "same text here"]


def table(spark, texts, schema=SCHEMA):
    rows = [(i if i != 2 else None, t, "en", "s", None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    decoded = reference.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(decoded)


def test_bpe_equals_the_library(spark, reference):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("aéΣ'sßtł0 \n\x1d .,!ñ汉字🙂\u0301가İ<|>") for _ in range(80)) for _ in range(200)]
    got = bpe.round_trip(table(spark, texts), VOCABULARY, limit=50).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected(reference, t) for t in texts)
    assert bpe.round_trip(table(spark, texts).limit(0), VOCABULARY).count() == 0


def test_bpe_on_the_documents(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, VOCABULARY).collect()}
    assert got == {r.doc_id: expected(reference, r.text) for r in docs.select("doc_id", "text").collect()}


def test_bpe_leaves_no_chunks_in_workers(spark):
    def held(batches):
        list(batches)
        codecs = [x for x in gc.get_objects() if isinstance(x, bpe.Codec)]
        yield pa.RecordBatch.from_pydict({"n": [sum(len(d) for c in codecs for d in vars(c).values() if isinstance(d, dict))]})

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    assert bpe.round_trip(docs, VOCABULARY).where("n_tokens > 0").count()
    bpe.encode(docs, VOCABULARY).collect()
    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_bpe_caches_are_bounded(reference, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    letters = "abcdefghij"
    words = [a + b + c for a in letters for b in letters for c in letters]
    text = " ".join(words + [w + "," for w in words] + ["x" * 100_000 + "!"] + words[:30])
    v = bpe.Vocabulary(VOCABULARY)
    bpe.save_lexicon(bpe.compile_lexicon({w: v.merge(w) for w in words[:30]}), tmp_path / "l")
    for lexicon, most in ((None, 100), (bpe.Lexicon(tmp_path / "l"), 30)):
        codec = bpe.Codec(v, lexicon)
        assert codec.encode(text) == reference.encode(text, add_special_tokens=False).ids
        caches = [d for d in vars(codec).values() if isinstance(d, dict)]
        assert 30 <= sum(map(len, caches)) <= most and max(len(c) for d in caches for c in d) <= 64


def test_bpe_codes_words_together(reference, tmp_path, monkeypatch):
    """Few Python calls a word, and the library's ids: ties, words of many bytes, blocks of every size, runs with marks."""
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 2000)
    rnd, v = random.Random(5), bpe.Vocabulary(VOCABULARY)
    words = {"".join(rnd.choices("etaoinsé漢ß", k=rnd.randint(1, 16))) for _ in range(9_000)}
    words |= {x * n for x in ("a", "é", "ab", "!", "'s") for n in (1, 2, 31, 32, 33, 63, 64, 65, 200)}
    words = sorted(words | {w + m for w in sorted(words)[::5] for m in (".", "!!", "'s", "'", ",'ve", "7", "--9")})
    alike = [w for w in words if w.isalpha() and w.isascii()][::3]
    bpe.save_lexicon(bpe.compile_lexicon({w: v.merge_long(w) for w in alike}), tmp_path / "l")
    text = " ".join(words)
    for lexicon in (None, bpe.Lexicon(tmp_path / "l")):
        codec, calls = bpe.Codec(v, lexicon), Counter()
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            got = codec.encode(text)
        finally:
            sys.setprofile(None)
        assert got == reference.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == got and calls["call"] < 2 * len(words)
        assert [codec.encode(w) for w in words[::50]] == [reference.encode(w, add_special_tokens=False).ids for w in words[::50]]


def test_bpe_keeps_ids_and_texts(spark, reference):
    docs = table(spark, ODD[:4] + ["hello world"]).select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert {r.text: r.decoded for r in coded.collect() if r.text} == {t: reference.decode(reference.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in (" \t\n", "x", "hello world")}


def test_lexicon_is_minimal_and_exact(tmp_path):
    v = bpe.Vocabulary(VOCABULARY)
    words = sorted({"".join(random.Random(i).choices("abc", k=1 + i % 7)) for i in range(400)})
    arrays = bpe.compile_lexicon({w: v.merge(w) for w in words})
    bpe.save_lexicon(arrays, tmp_path / "l")
    found = bpe.Lexicon(tmp_path / "l")
    assert all(found.find(w) == v.merge(w) == v.merge_long(w) for w in words)
    assert all(found.find(w) is None for w in ("", "abcabcabcabc", "z"))
    assert len(bpe.compile_lexicon({w: [1] for w in ("tap", "taps", "top", "tops")})["final"]) == 5  # suffixes are shared
    assert bpe.compile_lexicon({})["final"].tolist() == [0]


def test_licenses(spark):
    texts = ODD + [
        "Released under the MIT License, and CC BY-NC 4.0; the mit license.", "licensed under the apachee licence version 2.0", "mitlicense", "Permission is hereby granted, free of chrge, to any person obtaining a copy",
    ]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    n = len(ODD)
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels, got[0].score) == (0, 0, None, "", "", 0.0)
    assert (got[n].n_words, got[n].n_base, got[n].first_word, got[n].last_word, got[n].base_labels) == (14, 3, 3, 12, "cc-by,mit")
    assert got[n + 1].base_labels == "" and got[n + 1].labels == "apache" and 0.8 < got[n + 1].score < 1
    assert got[n + 2].labels == "" and got[n + 3].labels == "mit" and got[n + 3].spans[0].edits == 1
    assert got[4].n_words == 60_000 and licenses.scan(table(spark, [])).count() == 0


def test_license_base_against_brute_force(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) | {""}


def test_fuzzy_seeds_lose_nothing():
    import regex

    rnd = random.Random(5)
    notice, k = "released under the mit license", 2
    for _ in range(200):
        t = list(notice)
        for _ in range(k):
            t[rnd.randrange(len(t))] = rnd.choice("xyz ")
        text = "before " + "".join(t) + " after"
        hit = regex.search(f"(?b)(?:{notice}){{e<={k}}}", text)
        assert hit and any(label == "mit" for label, *_ in licenses.fuzzy_spans(text))


def test_neighbouring_and_repeated_notices():
    spans = licenses.fuzzy_spans("released under teh mit license released under the mit license")
    assert [(label, edits) for label, _, _, edits in spans] == [("mit", 2), ("mit", 0)]
    began = time.monotonic()
    n, places, first, last, _, labels, score, _ = licenses.scan_text("cc by " * 500_000)
    assert (n, places, first, last, labels, score) == (1_000_000, 500_000, 0, 999_998, "cc-by", 1.0)
    assert licenses.scan_text("under the " * 20_000)[5] == ""
    assert len(licenses.scan_text("released under the mit licence " * 2000)[7]) == 2000
    assert time.monotonic() - began < 60


def test_fuzzy_labels_against_brute_force(spark):
    """Every notice searched for over whole texts, without seeds, gives the same labels as the scan."""
    import regex

    rnd = random.Random(8)
    letters = "abcdefgh mnost"
    texts = []
    for notice in licenses.NOTICES:
        for edits in (0, 1, 2, 4, 7):
            t = list(notice)
            for _ in range(edits):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], [rnd.choice(letters)], [t[i], rnd.choice(letters)]])
            texts.append(f"some words before {''.join(t)} and words behind")
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text and len(r.text) < 3000]
    for text in texts + docs[:40]:
        line = " ".join(licenses.fold(text).decode().split())
        want = {label for notice, label in licenses.NOTICES.items() if regex.search(f"(?:{notice}){{e<={max(1, len(notice) // licenses.CHARS_PER_EDIT)}}}", line)}
        assert {label for label, *_ in licenses.fuzzy_spans(line)} == want


def test_quality_handles_odd_rows(spark):
    got = {r.doc_id: r for r in quality.classify(table(spark, ODD)).collect()}
    assert got[0].score == 0.0 and not got[0].kept and not got[1].kept and len(got) == len(ODD)
    assert quality.classify(table(spark, [])).count() == 0
    assert quality.classify(table(spark, [None, ""])).where("kept").count() == 0
    kept = quality.good_documents(table(spark, ODD))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_quality_finds_the_accuracies():
    rnd = np.random.default_rng(0)
    good = rnd.random(20_000) < 0.8
    right, caught = np.array([0.98, 0.95, 0.99, 0.97]), np.array([0.6, 0.5, 0.7, 0.4])
    votes = np.where(good[:, None], np.where(rnd.random((20_000, 4)) < right, 1, -1), np.where(rnd.random((20_000, 4)) < caught, -1, 1))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, n.astype(float), 500)
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.good - right).max() < 0.03 and np.abs(model.bad - caught).max() < 0.12


def test_quality_against_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.25


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    t, c = np.array([r.score for r in rows if r.toxic == 1]), np.array([r.score for r in rows if r.toxic == 0])
    assert np.mean(t >= 0.5) > 0.8 and np.mean(c >= 0.5) < 0.01


def test_toxicity_handles_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 7)], "doc_id long, toxic int")
    for l in (empty, labels):
        got = toxicity.score(table(spark, ODD), toxicity.train(table(spark, ODD), l)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(table(spark, []), toxicity.train(table(spark, []), labels)).count() == 0


def test_machine_learns_a_pair():
    """Insult and group alone are clean, together toxic: no additive weights can do that."""
    rows = [np.array(x) for x in ([0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2])] * 60
    y = np.array([float(0 in r and 1 in r) for r in rows])
    w0, w, v = toxicity.fit(rows, y, 3, epochs=300)
    text = np.repeat(np.arange(4), [1, 1, 2, 1])
    z, _ = toxicity.raw_scores(text, np.array([0, 1, 0, 1, 2]), 4, w0, w, v)
    assert list(z > 0) == [False, False, True, False]


def test_language_fuses_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language.identify(pages, docs).collect()
    assert len(rows) == pages.count() and np.mean([r.lang == r.declared for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (None, "", "<script>"), (3, "https://a.example.com/fr/1", "<html lang='fr'>"), (3, "x", "<p>&amp;</p>" * 20000)], "page_id long, url string, html string")
    got = language.identify(pages.unionByName(odd), docs).where("page_id = 3").collect()
    assert any(r.lang == "fr" and r.declared == "fr" for r in got)
    assert language.identify(odd, docs.limit(0)).where("lang IS NULL AND score = 0").count() == 4
    assert language.identify(odd.limit(0), docs).count() == 0


def test_rare_language_is_kept(spark, monkeypatch):
    """One document of 300 has its own language; blocks of languages give what one table gives."""
    rare = "zyx qwv kjq xzz vqk jwx " * 20
    rows = [("the house and the garden are here", "en")] * 200 + [("la maison et le jardin sont ici", "fr")] * 99 + [(rare, "zz")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    pages = spark.createDataFrame([(1, "https://a.org/x", f"<p>{rare}</p>"), (2, "https://b.org/x", "<p>the garden and the house</p>"), (3, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text_lang, r.lang, round(r.score, 9)) for r in language.identify(pages, docs).collect())
    assert [x[1:3] for x in got[:2]] == [("zz", "zz"), ("en", "en")]
    monkeypatch.setattr(language, "BLOCK", 2)
    assert sorted((r.page_id, r.text_lang, r.lang, round(r.score, 9)) for r in language.identify(pages, docs).collect()) == got


def test_words_and_runs():
    w = Words(["One two-three", None, "", "ÉTÉ x", "a b c d e f"])
    assert w.counts.tolist() == [3, 0, 0, 2, 6]
    h = w.hashes()
    assert len(set(h.tolist())) == 11 and Words(["x two"]).hashes()[1] == h[1]
    text, _ = shingles(w, 5)
    assert text.tolist() == [0, 3, 4, 4]


def test_language_against_brute_force(spark):
    """Counts, posteriors, smoothed priors and their product by plain loops over all pages and documents."""
    import math
    import re
    from collections import Counter, defaultdict

    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None and r.lang is not None]
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumns({"host": F.lit("clash"), "p": F.lit("clash"), "lang": F.lit("clash")})
    langs = sorted({x for _, x in docs})

    def grams(t):
        b = (" " + " ".join(t.lower().split()) + " ").encode()
        return [((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(b) - 2)]

    counts = {x: Counter() for x in langs}
    for t, x in docs:
        counts[x].update(grams(t))
    totals = {x: sum(c.values()) + 0.5 * language.BUCKETS for x, c in counts.items()}
    rows = []
    for r in pages.collect():
        g = grams(language.visible(r.html))
        logs = [sum(math.log((counts[x][b] + 0.5) / totals[x]) for b in g) * min(len(g), language.EFFECTIVE) / max(len(g), 1) for x in langs]
        post = [math.exp(x - max(logs)) for x in logs]
        host = m[1].lower() if (m := re.match(r"[^:]*://([^/?#]*)", r.url or "")) else ""
        code = m[1].lower() if (m := re.match(r"[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", r.url or "")) else ""
        told = m[1].lower() if (m := re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", r.html or "")) else ""
        parts = host.split(".")
        rows.append((r.page_id, host, ".".join(parts[-2:]), parts[-1], told, code, logs, [x / sum(post) for x in post]))
    k = range(len(langs))
    every = [0.99 * sum(r[7][i] for r in rows) / len(rows) + 0.01 / len(langs) for i in k]

    def priors(at, wider):
        groups = defaultdict(list)
        for r in rows:
            groups[r[at]].append(r)
        return {key: [(sum(r[7][i] for r in own) + language.SMOOTHING * wider(own[0])[i]) / (len(own) + language.SMOOTHING) for i in k] for key, own in groups.items()}

    suffix = priors(3, lambda r: every)
    domain = priors(2, lambda r: suffix[r[3]])
    host, told, code = priors(1, lambda r: domain[r[2]]), priors(4, lambda r: every), priors(5, lambda r: every)
    got = {r.page_id: r for r in language.identify(pages, spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in rows:
        logs = [r[6][i] + math.log(host[r[1]][i]) + math.log(told[r[4]][i]) + math.log(code[r[5]][i]) - 2 * math.log(every[i]) for i in k]
        post = [math.exp(x - max(logs)) for x in logs]
        best = max(k, key=lambda i: post[i])
        assert got[r[0]].lang == langs[best] and abs(got[r[0]].score - post[best] / sum(post)) < 1e-6 and got[r[0]].text_lang == langs[max(k, key=lambda i: r[6][i])]


def test_quality_measures_and_scores_against_brute_force(spark):
    """The eight measures, the votes, the posterior of the votes and the linear score by plain loops over each text."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}

    def measures(text):
        data = (text or "").encode()
        words = data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
        symbol = lambda b: not (b >= 128 or chr(b).isalnum() or chr(b) in ".,;:!?'\"()-/")
        ink = b"".join(words)
        letters = [b for b in data if b < 128 and chr(b).isalpha()]
        n, few = len(words), len(words) < 5
        if not n:
            return [None] * 8
        return [
            sum(map(symbol, ink)) / len(ink), sum(any(map(symbol, w)) for w in words) / n, sum(chr(b).isupper() for b in letters) / len(letters) if len(letters) >= 20 else None,
            sum(b"!!" in w or b"??" in w for w in words) / n, None if few else sum(a == b for a, b in zip(words, words[1:])) / n, None if few else sum(a == b == c for a, b, c in zip(words, words[1:], words[2:])) / n,
            None if few else 1 - len(set(words)) / n, None if few else sum(all(map(symbol, w)) for w in words) / n,
        ]

    for r in docs.collect():
        votes = ["-" if m is None else "b" if m >= bad else "g" if m <= good else "-" for m, (_, bad, good) in zip(measures(r.text), quality.LABELLERS)]
        odds = math.log(model.accuracies.prior / (1 - model.accuracies.prior))
        for v, good, bad in zip(votes, model.accuracies.good, model.accuracies.bad):
            odds += math.log(good / (1 - bad)) if v == "g" else math.log((1 - good) / bad) if v == "b" else 0.0
        x = got[r.doc_id]
        assert x.pattern == "".join(votes) and abs(x.weak - 1 / (1 + math.exp(-odds))) < 1e-9
        p = quality.parts_of([r.text])
        _, bucket, value = quality.features(p, quality._word_hashes(p.data, p.starts, p.ends))
        z = model.scorer.bias + sum(model.scorer.weights[b] * v for b, v in zip(bucket, value))
        assert abs(x.score - (1 / (1 + math.exp(-z)) if len(p.starts) else 0.0)) < 1e-9 and x.kept == (x.score >= 0.5)


def test_toxicity_scores_against_brute_force(spark):
    """The machine's sum over all pairs of terms, one by one, for every document."""
    import math
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(model.w) > 3
    for r in docs.select("doc_id", "text").collect():
        _, term = toxicity.terms([r.text])
        own = [model.place[t] for t in term if model.place[t] >= 0]
        z = model.w0 + sum(model.w[i] for i in own) + sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(own) for b in own[:k])
        x = got[r.doc_id]
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-9 and x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize(("page", "want"), [("a < b", "a < b"), ("<p>x</p> 1 < 2 <!-- cut", " x  1 < 2  "), ("<b>y< <script>z", " y z"), ("<<<", "<<<"), ("a<!-- b > c", "a "), ("<STYLE>p{}", " ")])
def test_unclosed_markup(page, want):
    assert language.visible(page) == want


def test_unclosed_markup_is_linear():
    import time

    began = time.process_time()
    assert language.visible("<p>" + "<" * 1_000_000) == " " + "<" * 1_000_000
    assert time.process_time() - began < 1
