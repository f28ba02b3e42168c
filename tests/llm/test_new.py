"""HTML extraction, spelling variants and collocations against brute force, on small inputs with every odd case."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("crawlq.llm")

from crawlq.llm import collocations, fm_index, html_blocks, html_extract, min_cut, queries, spelling  # noqa: E402
from crawlq.llm.words import Words  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, n long, prefix string, salt int, next string, rank long"
LONG = " ".join(f"palabra{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(4000))
TEXTS = ["Running running RUNNING, runing. The running man; runnning! ", LONG, LONG, None, "", " \t\n", "a", "x" * 9000 + " " + "x" * 9000,
         "été Étés étés été × ÷ naïve naive naïves a.b.c 1abcdef2 déjàvu déjavu", "one two three four five. one two three four\tfive",
         "one two\x0bthree four five ,, one two", "\0 nul \0 nul\u0085x"]


def _documents(spark, repeats=12):
    rows = [(None if i == 3 else i % 7, t, None if i % 3 == 0 else "en", "w", 1, "p", 2, "x", 3)
            for _ in range(repeats) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1], r[2]) for r in rows]


# ---- 11 HTML extraction ----------------------------------------------------------

def test_min_cut_equals_enumeration():
    rnd = random.Random(3)

    def cost(gains, edges, side):
        return (sum(g for g, on in zip(gains, side) if g > 0 and not on) - sum(g for g, on in zip(gains, side) if g < 0 and on)
                + sum(w for i, j, w in edges if side[i] != side[j]))

    for _ in range(400):
        n = rnd.randint(1, 8)
        gains = [rnd.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, w) for i, j, w in ((rnd.randrange(n), rnd.randrange(n), rnd.randint(0, 8)) for _ in range(12)) if i != j]
        side = min_cut.content_side(gains, edges)
        assert (cost(gains, edges, side), sum(side)) == min((cost(gains, edges, s), sum(s)) for s in itertools.product([False, True], repeat=n))
    assert min_cut.content_side([], []) == []


PAGE = """<!doctype html><html><head><title>Not this</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Site</a>
<form><input><button>Go</button></form></header><div id="cookie-notice">We use cookies, please accept them all now, thank you.</div>
<ul class=menu><li><a href=a>Home</a><li><a href=b>News</a></ul><div class="content"><h1>A headline &amp; more</h1>
<p>First   paragraph,\n long <b>enough</b> to be text &lt;here&gt;.<p>Second<br>with a <a title="x>y" href=x>link</a> in it. <script>var s="</p>no";</script>
<div class="advertisement">Buy our soap today, it is cheap and clean.</div><ul><li>point one of it</li><li>point two</li></ul></div>
<aside><h3>Related</h3><a href=q>Another story of the day</a></aside><section id="comments"><h2>3 comments</h2>
<article class=comment><p>I think that this text is quite wrong, and I can tell you why it is so.</p></article></section>
<footer>&copy; 2024 Site. All rights reserved.</footer><!-- <p>never</p> --></body></html>"""


def test_page_with_all_parts():
    want = "A headline & more\nFirst paragraph, long enough to be text <here>.\nSecond with a link in it.\npoint one of it\npoint two"
    assert html_extract.main_text(PAGE, html_extract.PRIOR) == want


@pytest.mark.parametrize("html", [None, "", "   ", "plain", "<", "<<<", "<p", "<p>a<p", "</p></div>", "<!--", "<!-- x", "<script>never ends", "<a href='x>y",
                                  "<a <a <a " * 3000, "<div>" * 3000 + "x", "&#0;&bogus;&amp", "<b><div></b></div><td>x<li>y<tr>", "<svg><p>in</p>", "\0<p>\0"])
def test_broken_markup_never_raises(html):
    assert isinstance(html_extract.main_text(html, html_extract.PRIOR), str)


def test_long_page_is_read_whole():
    body = "".join(f"<p>Paragraph number {i} of a very long article, with some words in it.</p>" for i in range(20_000))
    text = html_extract.main_text(f"<nav><a href=x>Home</a></nav><article>{body}</article><footer>&copy; me</footer>", html_extract.PRIOR)
    assert text.count("\n") == 19_999 and "Home" not in text and "©" not in text


def test_extract_equals_the_article_of_every_page(spark):
    """The given pages hold their text in one article element of headings and paragraphs."""
    from html import unescape

    got = {r.page_id: r for r in queries.op11_min_cut_html(spark, SF).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, html in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        text = "\n".join(x for x in lines if x)
        assert tuple(got[page_id]) == (page_id, url, text, len(text))


def test_extract_odd_rows(spark):
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, None, None, None), (2, None, "", "", 2), (None, "v", "<p>é</p>", "", 3)]
    schema = "page_id long, url string, html string, text string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=repr)
    assert len(got) == 5 and got.count((None, None, "", 0)) == 1 and [len(t[2]) for t in got] == [t[3] for t in got]
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []
    assert html_blocks.parse("<p>a&nbsp; b</p>").blocks[0].text == "a b"


# ---- 12 spelling variants ---------------------------------------------------------

def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _search_all(words: list[str], asked: list[str]) -> set:
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
    index = fm_index.BidirectionalIndex(np.array([alphabet[c] for w in words for c in w]), np.array([len(w) for w in words]))
    codes, lengths = np.array([alphabet.get(c, -1) for w in asked for c in w]), np.array([len(w) for w in asked])
    out = set()
    for forward in (True, False):
        q, v = fm_index.one_error(index, codes, np.cumsum(lengths) - lengths, lengths, lengths // 2, forward)
        out |= {(asked[a], words[b]) for a, b in zip(q, v)}
    return out


def test_searches_with_one_error_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(80):
        letters = "abcde"[:rnd.choice([2, 3, 5])]
        words = sorted({"".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(rnd.randint(1, 60))})
        asked = words + sorted({"".join(rnd.choices(letters + "z", k=rnd.randint(2, 8))) for _ in range(30)} - set(words))
        assert _search_all(words, asked) == {(a, b) for a in asked for b in words if _near(a, b)}


def _spelling(docs) -> set:
    counts = Counter()
    for doc_id, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    near, form = {}, {}
    for w, n in words.items():
        cands = set().union(*(holes[w[:i] + w[i + 1:]] | {w[:i] + w[i + 1:]} for i in range(len(w))), holes.get(w, ()))
        near[w] = [x for x in cands if x in words and x != w and _near(x, w)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


@pytest.mark.parametrize("shard", [spelling.SHARD_CHARS, 120])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, shard):
    """``shard=120``: many shards, and halves that fill several of them."""
    monkeypatch.setattr(spelling, "SHARD_CHARS", shard)
    df, docs = _documents(spark)
    docs += [(9, w, "en") for w in ("bbbbbb",) * 6 + ("bbbbbbb",) * 41 + ("bbbbbbbb",) * 300 + ("aaaaabb",) * 2000]
    df = df.unionByName(spark.createDataFrame([(9, t, "en", "w", 1, "p", 2, "x", 3) for _, t, _ in docs[-2347:]], SCHEMA))
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _spelling(docs)
    assert any(r[1] != r[2] and r[1] is not None for r in got)


def test_spelling_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in queries.op12_fm_index_spelling(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == _spelling(docs)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- 13 collocations ----------------------------------------------------------------

def _collocations(docs, top=collocations.TOP) -> set:
    counts, totals = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    often = {p: a for p, a in counts.items() if a >= 30}
    rows = defaultdict(list)
    for (lang, *p), a in often.items():
        if len(p) < 2:
            continue
        if any(100 * f >= 80 * a and lang == q[0] and any(list(q[i:i + len(p)]) == p for i in range(1, len(q) - len(p) + 1))
               for q, f in often.items() if len(q) > len(p) + 1):
            continue
        score, _, left, right = min((2_000_000 * a // (counts[(lang, *p[:k])] + counts[(lang, *p[k:])]), k,
                                     counts[(lang, *p[:k])], counts[(lang, *p[k:])]) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
            for lang, best in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])}


@pytest.mark.parametrize("chunk, bits, top", [(collocations.CHUNK, 32, 2000), (100, 1, 5)])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk, bits, top):
    """``bits=1``: a filter that lets nearly everything through changes nothing."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    df, docs = _documents(spark, 40)
    df, docs = df.where("text is null or length(text) < 300"), [d for d in docs if d[1] is None or len(d[1]) < 300]
    got = [tuple(r) for r in collocations.collocations(df, top).collect()]
    assert len(got) == len(set(got)) and set(got) == _collocations(docs, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hashes_of_words_follow_their_bytes():
    buf = b"ab abc ab abcdefgh abcdefghi " + b"y" * 300 + b" " + b"y" * 300 + b" ab\0 a"
    text = np.frombuffer(buf, np.uint8)
    words = Words(buf, text != 32)
    one, two = words.hashes()
    number, names = words.numbered(np.arange(len(words)), one, two)
    assert [names[i] for i in number] == buf.split(b" ") and len(set(one.tolist())) == len(set(buf.split(b" "))) == len(set(two.tolist()))
    # Equal first hashes of different words are told apart by the second.
    number, names = words.numbered(np.arange(len(words)), np.zeros_like(one), two)
    assert [names[i] for i in number] == buf.split(b" ")
