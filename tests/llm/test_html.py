"""Main text of pages: made pages with a known article, a plain second version, broken and deep markup."""

import math
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from provena.llm import html_text
from provena.llm.html_text import extract


class Plain(HTMLParser):
    """Blocks of well-formed pages with their elements' labels, tags and attributes."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.text, self.count, self.links, self.raw, self.link = [], [], "", 0, 0, 0, 0

    def cut(self):
        words = " ".join(self.text.split())
        if words:
            self.blocks.append((tuple(self.stack), words, self.links))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attributes):
        if tag in html_text.RAW:
            self.raw += 1
        elif tag == "a":
            self.link += 1
        elif tag == "br":
            self.text += " "
        elif tag not in html_text.INLINE:
            self.cut()
            if tag not in html_text.VOID:
                self.count += 1
                named = dict(attributes)
                label = tag + "".join((".%s" if k == "class" else "#%s") % named[k] for k, _ in attributes if k in ("class", "id"))
                self.stack.append((self.count, tag, label, " ".join(named.get(k) or "" for k in ("class", "id"))))

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.raw -= 1
        elif tag == "a":
            self.link -= 1
        elif tag not in html_text.INLINE and tag not in html_text.VOID:
            self.cut()
            self.stack.pop()

    def handle_data(self, data):
        if not self.raw:
            self.text += data
            self.links += len(data) if self.link else 0


def plainly(page):
    """The operator's definition, block by block and element by element, without any shortcut."""
    parser = Plain()
    parser.feed(page)
    parser.cut()
    blocks = parser.blocks
    if not blocks:
        return ""
    labels = [tuple(e[2] for e in s) for s, _, _ in blocks]
    order = list(dict.fromkeys(labels))
    mine = {p: [(t, n) for q, (_, t, n) in zip(labels, blocks, strict=True) if q == p] for p in order}
    length = [np.mean([len(t) for t, _ in mine[p]]) for p in order]
    marks = [np.mean([len(html_text._PUNCTUATION.findall(t)) for t, _ in mine[p]]) for p in order]
    smooth = lambda v, i: (v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)]) / 4
    score = {}
    for i, p in enumerate(order):
        linked = sum(min(n, len(t)) for t, n in mine[p]) / sum(len(t) for t, _ in mine[p])
        score[p] = [math.log1p(a) * (1 + math.log1p(b)) * (1 - 0.8 * linked) for a, b in ((smooth(length, i), smooth(marks, i)), (length[i], marks[i]))]

    def held(element, weights):
        return sum(w for (s, _, _), w in zip(blocks, weights, strict=True) if element in s)

    raw = [score[p][0] * len(t) for p, (_, t, _) in zip(labels, blocks, strict=True)]
    final = []
    for p, (stack, _, _) in zip(labels, blocks, strict=True):
        factor, inside = 1.0, False
        for e in stack:
            own = 1.0
            _, tag, _, names = e
            wrapping = {"form": 0.5, "fieldset": 0.5}.get(tag, html_text.WHOLE)
            if tag in html_text.OUTSIDE_TAGS:
                own, wrapping = html_text.MUCH, 2
            if tag in ("form", "fieldset") or (tag == "header" and not inside):
                own = html_text.MUCH
            if tag not in ("html", "body", "article", "main"):
                own = min(own, html_text.name_factor(names))
            if held(e, raw) >= wrapping * sum(raw):
                own = 1.0
            if tag in html_text.MAIN:
                own *= 1 if inside else html_text.WITHIN
                inside = True
            factor *= own
        final.append((score[p][factor < 1] * factor, factor))
    if max(f for _, f in final) <= html_text.MUCH * html_text.WITHIN:
        return ""
    weights = [f * len(t) for (f, _), (_, t, _) in zip(final, blocks, strict=True)]
    elements = sorted({e for s, _, _ in blocks for e in s})
    enough = [e for e in elements if held(e, weights) >= html_text.HOLD * sum(weights)]
    chosen = None
    if enough:
        stack = next(s for s, _, _ in blocks if enough[-1] in s)
        stack = stack[: stack.index(enough[-1]) + 1]
        chosen = next((e for e in reversed(stack) if e[1] in html_text.MAIN), stack[-1])
    into = [chosen is None or chosen in s for s, _, _ in blocks]
    limit = html_text.THRESHOLD * sum(w for w, i in zip(weights, into, strict=True) if i) / sum(len(b[1]) for b, i in zip(blocks, into, strict=True) if i)
    start = into.index(True)
    return "\n".join(
        t for k, ((s, t, _), (f, factor), i) in enumerate(zip(blocks, final, into, strict=True))
        if f >= limit and (i or (k < start and s and s[-1][1] == "h1" and factor >= 1))
    )


def sentence(rng, n):
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def made(rng, outer, wrap, names):
    """(page, article) of a page of menus, adverts, an article in ``outer``, comments and a footer."""
    name = lambda c: f' class="{c}"' if names else ""
    paragraphs = [" ".join(sentence(rng, rng.integers(5, 20)) for _ in range(rng.integers(2, 6))) for _ in range(rng.integers(3, 8))]
    title = sentence(rng, 6)[:-1]
    menu = "".join(f'<li><a href="/{k}">{sentence(rng, 1)[:-1]}</a></li>' for k in range(6))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    inner = f"<{outer}{name('post-body')}>{body}</{outer.split()[0]}>"
    comments = "".join(f"<div{name('comment')}><p>{sentence(rng, 12)}</p></div>" for _ in range(3)) if names else ""
    page = f"<html><head><title>x</title></head><body><div{name('menu')}><ul>{menu}</ul></div><div{name('ad')}>{sentence(rng, 4)}</div>{wrap[0]}{inner}{wrap[1]}<div{name('comments')}>{comments}</div><div{name('footer')}>{sentence(rng, 6)}</div></body></html>"
    return page, "\n".join([title, *paragraphs])


@pytest.mark.parametrize("outer", ["article", "main", "div", "section"])
@pytest.mark.parametrize("wrap", [("", ""), ("<div><div>", "</div></div>"), ("<form><div>", "</div></form>")])
@pytest.mark.parametrize("names", [True, False])
def test_made_pages(outer, wrap, names):
    rng = np.random.default_rng(7)
    for _ in range(15):
        page, article = made(rng, outer, wrap, names)
        assert extract(page) == article == plainly(page)


def test_pages_match_the_plain_version(spark, sf_dir):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    whole = {k: h.replace("<br><p>", "<br></p><p>").replace("<b>", "").replace("</b>", "") for k, h in rows.items()}
    for h in whole.values():
        if h.count("<p") == h.count("</p"):
            assert extract(h) == plainly(h)
    got = html_text.op7_main_text(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == {k: extract(h) for k, h in rows.items()}
    assert all(r.n_chars == len(r.text) > 0 and "var t=" not in r.text and "©" not in r.text for r in got)


LONG = "This paragraph is long enough to be read, and it has marks, too; more follows, as in any text. " * 3


def test_no_name_alone_drops_a_block():
    long = LONG.strip()
    page = lambda inner: f"<body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>"
    for inner in (f'<div id="social-history"><p>{LONG}</p></div>', f'<section id="notice-of-copyright-law"><p>{LONG}</p></section>'):
        assert extract(page(inner)) == "\n".join(["Head", long, long, long])
    assert extract(f'<body><div class="entry-content-share"><p>{LONG}</p><p>{LONG}</p></div></body>') == f"{long}\n{long}"
    assert extract(f'<body><div class="comments"><p>{LONG}</p><p>{LONG}</p></div></body>') == f"{long}\n{long}"
    assert extract(page('<div class="share">Share this</div><div class="ad">Buy this, it is good.</div><div id="user-comments"><p>I agree, very much so, all of it.</p></div>')) == "\n".join(["Head", long, long])


def test_teaser_article_does_not_hide_the_body():
    long = LONG.strip()
    page = f"<body><article><h2>Other</h2><p>A short teaser.</p></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert extract(page).endswith("\n".join([long] * 4))


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is a very long advert, longer than all else, really.</div>
    <article class="post"><header><h1>A &amp;  B&nbsp;&#8217;s</h1></header><p><b>Bold. x<br><p>Two&lt;p&gt; <i>it</i>alic</p><ul><li>one<li><a href=y>two</a></ul>
    <aside>side</aside><div class="comments"><p>I agree, with this long comment, very much so.</p></div><form><p>mail</p></form></article>
    <div class=sidebar>more</div><footer>&copy; x</footer></body></html>"""
    assert extract(page) == "A & B ’s\nBold. x\nTwo<p> italic\none\ntwo"
    plain = '<html><body><div id="menu"><a href="a">One</a> <a href="b">Two</a></div><div id="main-text"><h2>Head</h2><p>Some sentence, that is long enough. And more.</p><p>Another, with marks.</p></div><div class="footer">(c)</div></body></html>'
    assert extract(plain) == "Head\nSome sentence, that is long enough. And more.\nAnother, with marks."
    assert [extract(x) for x in (None, "", "<", "<p", "<nav>x</nav>", "<p>a < b</p>", "just text")] == ["", "", "<", "<p", "", "a < b", "just text"]
    assert extract("""<p title="a > b" class='x'>one</p><p title=it's>two</p><p a="b>three""") == "one\ntwo\nthree"


@pytest.mark.parametrize("piece", ["<div>", "<ul><li>", "<div></x></p>", '<a "', '<a ">', "<p><table><tr><td>", "<", "<!x", "<head>", "<li><ul>", "<div class='ad'>"])
def test_time_grows_with_the_page_not_its_square(piece):
    began = time.process_time()
    extract(piece * (1_000_000 // len(piece)) + "x")
    assert time.process_time() - began < 20


def test_tables(spark):
    rows = [(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None), (2, "v", ""), (3, None, "<p>x</p>" + "<p>long text, indeed. </p>" * 50_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "'a' AS n_chars")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html_text.extract_pages(frame).collect())
    want = sorted((str(i), u, extract(h), len(extract(h))) for i, u, h in rows)
    assert got == want and len(got[3][2]) > 500_000
    assert html_text.extract_pages(frame.limit(0)).count() == 0
