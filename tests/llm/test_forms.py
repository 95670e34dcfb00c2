"""Fill-in-the-middle, repair of conversations and main texts of pages, against plain loops and brute force."""

import hashlib
import heapq
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import conversation_repair, fill_middle, main_text

SF = "/root/testdata/sf0.01"

# --- fill in the middle ---------------------------------------------------------------------------------------------

ODD = ["", None, "a", "é", "日本語のテキスト" * 7, "x<P>y", "<S", "a<", "<M><", "😀" * 50 + "é", " \n\t", "long ñ " * 40_000, "plain words " * 9]


def plainly(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_fill_middle_against_plain_loops(spark):
    rows = [(i if i % 17 else None, t, "clash", 1, "clash") for i, t in enumerate(ODD * 12)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, form string, n int, cut1 string")
    got = fill_middle.transform(docs, outputs=True).collect()
    want = [plainly(r[0], r[1]) for r in rows + rows[:5]]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(str, want))
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for t in ODD}
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 in texts
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_restored_from_output_and_form_alone():
    random.seed(4)
    for _ in range(2000):
        text = "".join(random.choice("<>PSM é") for _ in range(random.randrange(14)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted(random.randrange(len(text) + 1) for _ in range(2))
        raw = text.encode()
        first, second = fill_middle.byte_places(raw, a, b)
        cut = fill_middle.PieceTable(raw).cut(second).cut(first)
        assert cut.to_bytes() == raw and len(cut.pieces) == 3
        for form in ("psm", "spm"):
            output = cut.arranged(form).to_bytes()
            assert output.decode() == {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
            assert fill_middle.parsed(output, form).restored(form).to_bytes() == raw
    for output, form in ((b"no mark", "psm"), (b"<P>x<S>y", "psm"), (b"<P>x", "spm")):
        with pytest.raises(ValueError):
            fill_middle.parsed(output, form)


# --- repair of conversations ----------------------------------------------------------------------------------------

CODES = "suaxSUAX1234"


def ways(code):
    """(cost, letter, initial or nothing) of the edits of a row."""
    if code.isdigit():
        return [(4, "D", "")]
    more = 3 if code.isupper() else 0
    return [(4, "D", ""), (3 + more, "R", "u"), (3 + more, "R", "a")] + ([(more, "K", code.lower())] if code.lower() != "x" else [])


def exhaustive(codes):
    """The cheapest (cost, audit) over all choices, with up to two insertions in each gap."""
    gaps = ["", *"ua", "uu", "ua", "au", "aa"]
    best = None
    for inserted in itertools.product(gaps, repeat=len(codes) + 1):
        for edits in itertools.product(*map(ways, codes)):
            cost = 3 * sum(map(len, inserted)) + sum(e[0] for e in edits)
            if best is not None and cost > best[0]:
                continue
            roles = "".join(i + e[2] for i, e in zip(inserted, edits)) + inserted[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(i) + e[1] for i, e in zip(inserted, edits)) + "I" * len(inserted[-1])
                best = min(best or (10**9,), (cost, audit))
    return best


MOVES = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def searched(codes):
    """(cost, audit, roles) by Dijkstra over (place, state of a finite automaton), whole audits as tie-breakers."""
    heap, done = [(0, "", 0, "0", "")], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(codes) and state in "03":
            return cost, audit, kept
        if (at, state) in done:
            continue
        done.add((at, state))
        for r in "ua":
            if (state, r) in MOVES:
                heapq.heappush(heap, (cost + 3, audit + "I", at, MOVES[state, r], kept + r))
        if at < len(codes):
            for c, letter, r in ways(codes[at]):
                if not r or (state, r) in MOVES:
                    heapq.heappush(heap, (cost + c, audit + letter, at + 1, MOVES[state, r] if r else state, kept + r))


def repaired_roles(codes):
    cost, edits, last = conversation_repair.repair(codes)
    rows = conversation_repair.lines(edits, last, [c.lower() for c in codes], [""] * len(codes))
    audit = "".join(map(conversation_repair.audit_of, edits)) + conversation_repair.audit_of(last)
    return cost, audit, "".join(r[0] for r in rows)


def test_repair_against_all_choices():
    for n in range(3):
        for codes in itertools.product(CODES, repeat=n):
            want = exhaustive(codes)
            assert repaired_roles("".join(codes))[:2] == want == searched("".join(codes))[:2], codes


def test_long_repairs_against_a_search():
    random.seed(12)
    for _ in range(1500):
        codes = "".join(random.choice(random.choice((CODES, "ua", "sua", "SUA12", "x1"))) for _ in range(random.randrange(26)))
        assert repaired_roles(codes) == searched(codes), codes
    cost, audit, _ = repaired_roles("sx1U" * 50_000)
    assert len(audit) >= 200_000 and cost > 0 and len(conversation_repair._frontiers) < 3000


def damage(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        made = by_conv[conv]
        if n == 0:
            continue
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        made += [(turn, role, text)] * (2 if n == 3 else 1)
    return by_conv


def expected(rows):
    out = {}
    for conv, made in damage(rows).items():
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, codes, faults = set(), "", [0, 0, 0]
        for _, role, text in made:
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            body = text.strip("\t\n\x0b\x0c\r ")
            if not body or (role, text) in seen:
                faults[1 if body else 0] += 1
                c = "1234"["suax".index(c)]
            elif body[-1] not in ".!?":
                faults[2] += 1
                c = c.upper()
            seen.add((role, text))
            codes += c
        initials = [r[1][:1] for r in made]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = searched(codes)
        lines, at, i = [], 0, 0
        for letter in audit:
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[kept[i]])
            elif letter != "D":
                lines.append((made[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[kept[i]]) + ":" + made[at][2])
            i += letter != "D"
            at += letter != "I"
        turns = {r[0] for r in made if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_against_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversation_repair.repaired(table).collect()} == want
    assert len({w[5] for w in want.values()}) > 4 and sum(w[1] for w in want.values()) and sum(w[2] for w in want.values())


@pytest.mark.parametrize("bounds", [(20_000, 8 << 20), (30, 1 << 20), (0, 0), (3, 40)])
def test_odd_conversations_and_large_ones_in_segments(spark, bounds):
    random.seed(5)
    roles = ["user", "assistant", "system", None, "", "tool", "User", "émile"]
    texts = ["Yes.", "no", None, "", " \t\n", "Why?  \n", "é!", "\xa0", "word " * 400, "same.", "same."]
    rows = [(c, random.choice([None, 0, 1, 2, 3, 9, 40, -5]), random.choice(roles), random.choice(texts)) for c in (1, 2, None) for _ in range(60)]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(300)] + [(8, 3, "user", "again.")] * 100
    rows += [(c, 0, "user", "alone.") for c in range(100, 160)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, file string, code int").repartition(5)
    got = conversation_repair.repaired(table, *bounds).collect()
    want = expected(rows)
    assert len(got) == len(want) and {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == want
    assert any(w[6] == "" for w in want.values())
    assert conversation_repair.repaired(table.limit(0), *bounds).count() == 0


# --- main text of pages ---------------------------------------------------------------------------------------------


def article_of(page):
    """The given pages are all of one form: the paragraphs of the article element."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<b>|<br>", "", p)).split()) for p in re.split("</?h1>|</?p>", body)]
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert all(got[r.page_id].text == article_of(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url for r in rows)


AROUND = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="sidebar"><header><h1>Site</h1></header>
<nav><ul><li>Home<li>News</ul></nav><div class="cookieNotice">We use cookies</div><form>Search <input></form><main>
<article><header><h1>The &lt;title&gt; &amp; more</h1></header><p>One  <b>two</b><br>three&nbsp;four<p>Caf&eacute; &#233;<aside>Aside</aside>
<div class='ad'>Buy <p>now</div><table><tr><td>cell<td>next</table><span class="share">Tweet</span><footer>Filed under</footer></article>
<section id="comments"><article class="comment"><p>First!</p></article></section></main><div class="related-posts"><article>Other</article></div>
<!-- <article>no</article> --><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize(("page", "want"), [
    (AROUND, "The <title> & more\nOne two three four\nCafé é\ncell\nnext"),
    (None, ""), ("", ""), ("just text", "just text"), ("a < b & c", "a < b & c"), ("<p>a<p>b", "a\nb"), ("<nav>menu", ""), ("<script>x", ""), ("a<!-- x", "a"),
    ("<div><a href=x>One</a> <a href=y>two</a></div><div>Text with a <a href=z>link</a>.</div>", "Text with a link."),
    ("<form><article>In a form</article></form>", "In a form"), ("<div class=ad><article>x</article></div><p>Text</p>", "x"),
    ('<div class="related"><article>Other</article></div><article>Own</article>', "Own"), ("<article><p>" + "word " * 100_000 + "</article>", ("word " * 100_000).strip()),
    ("<p title='a > b'>x</p>", "x"), ('<p title="a>x</p>', "x"), ("<noscript>on</noscript><svg/><p>y</p><template>z</template>", "y"),
    ("<div role=main>A<div role=search>B</div></div>C", "A"), ("<div class=entry-content>A</div><div>C</div>", "A"), ("<b><div>x</b>y</div><p>z", "xy\nz"),
])
def test_odd_pages(page, want):
    parsed = main_text.Page(page)
    assert main_text.joined(parsed.blocks, parsed.main) == want


@pytest.mark.parametrize("page", ["<" * 500_000, "<a " * 300_000 + ">", '<a "' * 200_001 + ">", "<!--" * 200_000, "<ol>" + "<div>" * 3000 + "<li>x</li>" * 20_000, "<b><p>" * 50_000 + "</b>" * 50_000])
def test_scan_is_linear(page):
    import time

    began = time.process_time()
    main_text.Page(page)
    assert time.process_time() - began < 8


def test_suffix_array_against_sorting():
    random.seed(8)
    for length in (1, 2, 5, 8):
        pages = [[random.randrange(3) for _ in range(random.randrange(12))] for _ in range(9)]
        tokens = np.array([t for p in pages for t in p], np.uint64)
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        order, rank = main_text.suffix_array(tokens, page, length)
        suffix = [tuple(p[i : i + length]) for p in pages for i in range(len(p))]
        assert [suffix[i] for i in order] == sorted(suffix)
        assert all((rank[i] == rank[j]) == (suffix[i] == suffix[j]) for i, j in itertools.combinations(range(len(suffix)), 2))


def plain_words(text):
    return [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text).split(" ") if w]


def host_texts(pages):
    """What stays of pages without an article, by counting runs of tokens in sets."""
    where, streams = defaultdict(set), []
    for _, url, page in pages:
        parsed = main_text.Page(page)
        around = [(s, t) for s, t in parsed.blocks if parsed.main == main_text.OPEN or s != parsed.main]
        stream = [(w, b) for b, (_, t) in enumerate(around) for w in [*plain_words(t), None]]
        host = url.split("/")[2] if url else ""
        runs = [tuple(w for w, _ in stream[i : i + main_text.RUN]) for i in range(max(len(stream) - main_text.RUN + 1, min(len(stream), 1)))]
        for r in runs:
            where[host, r].add(tuple(t for _, t in parsed.blocks))
        streams.append((parsed, around, stream, host, runs))
    out = []
    for parsed, around, stream, host, runs in streams:
        if parsed.main != main_text.OPEN:
            out.append(main_text.joined(parsed.blocks, parsed.main))
            continue
        covered = {i + j for i, r in enumerate(runs) if len(where[host, r]) > 1 for j in range(main_text.RUN)}
        words = Counter(b for w, b in stream if w is not None)
        hit = Counter(b for i, (w, b) in enumerate(stream) if w is not None and i in covered)
        open_ = [(b, t) for b, (s, t) in enumerate(around) if s == main_text.OPEN]
        out.append("\n".join([t for b, t in open_ if hit[b] < main_text.COVERED * max(words[b], 1)] or [t for _, t in open_]))
    return out


def test_pages_without_an_article_against_counting(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    bare = lambda page: re.sub("<(/?)(nav|article|footer|li)>", r"<\1div>", page.replace('<div class="ad">', "<div>")).replace("<a ", "<i ").replace("</a>", "</i>")
    pages = [(r.page_id, r.url, bare(r.html) if r.page_id % 3 else r.html) for r in rows]
    pages += [(None, None, "<div>Same words on two pages of the empty host, are they not?</div><p>One</p>"), (None, None, "<div>Same words on two pages of the empty host, are they not?</div><p>Two</p>")]
    pages += [(9000, "http://copy.example/1", "<p>A page and its copy are one page, so that nothing of it goes.</p>")] * 3 + [(9001, None, None)]
    table = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, text string, row int").repartition(7)
    got = sorted(map(str, ((r.page_id, r.url, r.text) for r in main_text.extract(table).collect())))
    want = host_texts(pages)
    assert got == sorted(map(str, ((p[0], p[1], w) for p, w in zip(pages, want))))
    assert {"One", "Two"} <= set(want) and sum(w != host_texts([p])[0] for p, w in zip(pages, want)) > 50
    assert main_text.extract(table.limit(0)).count() == 0


def repeated_blocks(pages):
    """(blocks outside main text, those that runs of other pages of the host cover) of each page, by counting in sets."""
    where, streams = defaultdict(set), []
    for _, url, page in pages:
        parsed = main_text.Page(page)
        around = [t for s, t in parsed.blocks if parsed.main == main_text.OPEN or s != parsed.main]
        stream = [(w, b) for b, t in enumerate(around) for w in [*plain_words(t), None]]
        host = url.split("/")[2] if url else ""
        runs = [(host, tuple(w for w, _ in stream[i : i + main_text.RUN])) for i in range(max(len(stream) - main_text.RUN + 1, min(len(stream), 1)))]
        for r in runs:
            where[r].add(tuple(t for _, t in parsed.blocks))
        streams.append((around, stream, runs))
    out = []
    for around, stream, runs in streams:
        hit = {i + j for i, r in enumerate(runs) if len(where[r]) > 1 for j in range(main_text.RUN)}
        words = Counter(b for w, b in stream if w is not None)
        found = Counter(b for i, (w, b) in enumerate(stream) if w is not None and i in hit)
        out.append((len(around), sum(found[b] >= main_text.COVERED * max(words[b], 1) for b in range(len(around)))))
    return out


def test_every_page_goes_through_the_arrays_of_its_host(spark):
    """Pages with an article too, whose markup decides in the end: what their host repeats is found, and the article stays."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    menu = "<div>Home and news and all that a menu of ten words has</div>"
    pages += [(9000 + i, "http://a.example/", f"{menu}<article><p>Text {i}</p>{menu}</article>") for i in range(3)] + [(9010, "http://a.example/", menu + "<p>Open</p>"), (9011, None, None)]
    got = {r.page_id: r for r in main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert {p[0]: (got[p[0]].n_around, got[p[0]].n_repeated) for p in pages} == dict(zip([p[0] for p in pages], repeated_blocks(pages)))
    assert (got[9000].text, got[9000].n_repeated) == ("Text 0\nHome and news and all that a menu of ten words has", 1)
    assert got[9010].text == "Open" and sum(got[p[0]].n_repeated > 0 for p in pages) > 50
