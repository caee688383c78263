"""Main text of HTML pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf path of block tags
and their names. Per path, text length, punctuation and characters in links are
summed and divided by the number of blocks; the ratios of length and punctuation
are smoothed along the page and fused, less the share of links. What elements
are called is one more factor of a block's score, never a verdict: a name lowers
the scores of what is in the element, a compound with foreign words hardly, and
not at all where the element holds nearly all there is.

The innermost element that holds nearly all of the score is the article (its
enclosing ``<article>`` or ``<main>`` if it has one). Its blocks are the text, but
for those whose score falls below a threshold, and with the ``<h1>`` before it.

All steps take time in proportion to the page, however deep its elements nest.

Defined results: null or empty html, or a page without content, gives the empty
text; repeated rows give repeated results; broken or unclosed markup is read as
far as it goes; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provena.runtime import integer_id, ship

_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTE = re.compile("[\"']")
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never read as markup or text.
RAW = frozenset("script style noscript template svg math iframe object canvas head title textarea select audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements beyond which an open paragraph is not closed.
BOUNDS_P = frozenset("td th li article section div blockquote body".split())
#: An end is implied for an open element of the same kind; containers begin anew.
KIND = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"}
FRESH = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("tr", "td"), "tr": ("td",)}
#: Elements that are never the article, and those that may be wrapped around it: they do not count if they hold this share of the page.
OUTSIDE_TAGS = frozenset("nav footer aside button menu dialog".split())
WRAPPING_TAGS = {"form": 0.5, "fieldset": 0.5, "header": 0.9}
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of what surrounds articles: those that tell much, those that tell something,
#: words that change nothing beside them, and words that speak for the article.
HARD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer"
    " comment comments commentlist reply replies respond disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription masthead pagination pager".split()
)
SOFT = frozenset("banner notice notices alert share sharing social related recommended recommendations widget toolbar copyright legal login signin signup search header skip".split())
PLAIN = frozenset(
    "a area bar block blog body bottom box btn button buttons center col column container content custom entry fixed form global group header holder home inner item items js left link links list"
    " main message messages middle mobile module new news outer page panel post posts primary reader readers region right row secondary section separator side site story sticky text the thread title"
    " top unit user users view widgets wrap wrapper x xs sm md lg".split()
)
ARTICLE = frozenset("article content entry story".split())
#: Factors of a name that tells much, tells something, or stands beside foreign words; and of article and main.
MUCH, SOME, LITTLE, WITHIN = 0.01, 0.1, 0.5, 2.0
MAIN = frozenset(["article", "main"])
#: A name does not count for an element that holds this share of the page.
WHOLE, NEVER = 0.9, 2.0
#: Share of the page's score that the article's container must hold.
HOLD = 0.85
#: Blocks below this part of the container's mean score are left out.
THRESHOLD = 0.08


class _Node:
    __slots__ = ("factor", "first", "held", "paragraph", "parent", "path", "scope", "tag", "wrapping")

    def __init__(self, tag: str, parent: _Node | None, path: int, factor: float = 1.0, wrapping: float = WHOLE):
        self.tag, self.parent, self.path, self.factor, self.wrapping = tag, parent, path, factor, wrapping
        self.held = 0.0
        self.paragraph: _Node | None = None if parent is None or tag in BOUNDS_P else self if tag == "p" else parent.paragraph
        scope = parent.scope if parent else {}
        if tag in FRESH:
            scope = {k: v for k, v in scope.items() if k not in FRESH[tag]}
        if tag in KIND:
            scope = scope | {KIND[tag]: self}
        self.scope = scope


def name_factor(value: str) -> float:
    """What a class or an id says: the least factor of its names."""
    least = 1.0
    for name in value.split():
        tokens = {t.lower() for t in _TOKEN.findall(name)}
        hard, soft = tokens & HARD, tokens & SOFT
        if not hard and not soft:
            continue
        if tokens & ARTICLE and len(tokens) > 2:  # entry-content-share
            continue
        foreign = tokens - HARD - SOFT - PLAIN
        least = min(least, LITTLE if foreign else MUCH if hard else SOME)
    return least


def _open(tag: str, attributes: str, parent: _Node, paths: dict) -> _Node:
    """A block element, its path, and what tag and names say of it."""
    names, factor, wrapping = "", 1.0, WHOLE
    free = tag in ("html", "body", "article", "main")
    if tag in OUTSIDE_TAGS:
        factor, wrapping = MUCH, NEVER
    elif tag in WRAPPING_TAGS and not (tag == "header" and "main" in parent.scope):
        factor, wrapping = MUCH, WRAPPING_TAGS[tag]
    if attributes and not attributes.isspace():
        for m in _NAMES.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += ("." if key == "class" else "#") + value
                if not free:
                    factor = min(factor, name_factor(value))
            elif (key == "role" and value.lower() in OUTSIDE_ROLES) or key == "hidden" or (key == "style" and "display:none" in value.lower().replace(" ", "")) or (key == "aria-hidden" and value.lower() == "true"):
                factor, wrapping = MUCH, NEVER
    path = paths.setdefault((parent.path, tag + names), len(paths) + 1)
    return _Node(tag, parent, path, factor, wrapping)


def _tag_end(page: str, at: int, last: dict) -> int:
    """Where the tag whose name ends at ``at`` is closed, quoted values passed over; -1 if it is not."""
    if at > last[">"]:
        return -1
    first = stop = page.find(">", at)
    while True:
        quote = _QUOTE.search(page, at, stop)
        if not quote or quote.start() >= last[quote[0]]:
            return stop
        at = page.find(quote[0], quote.end()) + 1
        if at > stop:
            if at > last[">"]:
                return first
            stop = page.find(">", at)


def read(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All block elements in page order, and (element, text, characters in links) of every text block."""
    root = here = _Node("", None, 0)
    nodes, paths, open_ = [root], {}, {}
    found: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    links, in_link, at = 0, False, 0
    last = {c: page.rfind(c) for c in "<>\"'"}
    ends: dict[str, re.Pattern] = {}

    def close_block():
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((here, text, links))
            parts.clear()
        links = 0

    def leave(node):
        """Close elements up to and including ``node``."""
        nonlocal here
        while True:
            open_[here.tag] -= 1
            done = here is node
            here = here.parent
            if done:
                return

    while at < len(page):
        match = _MARKUP.search(page, at)
        begin = match.start() if match else len(page)
        if begin > at:
            parts.append(page[at:begin])
            links += begin - at if in_link else 0
        if not match:
            break
        comment, section, other, closing, name = match.groups()
        if not name:
            mark = "-->" if comment else "]]>" if section else ">"
            stop = page.find(mark, match.end())
            if stop < 0 and other:
                parts.append(page[begin : match.end()])
                at = match.end()
            else:
                at = len(page) if stop < 0 else stop + len(mark)
            continue
        stop = _tag_end(page, match.end(), last)
        if stop < 0:  # no tag is closed from here on
            parts.append(page[begin:])
            break
        attributes, at, tag = page[match.end() : stop], stop + 1, name.lower()
        if tag == "br":
            parts.append(" ")
        elif tag in RAW:
            if not closing:
                if tag in ("head", "title", "noscript", "template"):
                    close_block()
                if tag not in ends:
                    ends[tag] = re.compile(f"</{tag}\\b[^>]*>" + ("|(?=<body\\b)" if tag == "head" else ""), re.IGNORECASE)
                end = ends[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag in INLINE:
            if tag == "a":
                in_link = not closing
        elif tag in VOID:
            close_block()
        elif closing:
            if open_.get(tag):
                close_block()
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            elif tag == "p":
                close_block()
            in_link = False
        else:
            close_block()
            if tag in CLOSES_P and here.paragraph is not None:
                leave(here.paragraph)
            if tag in KIND and KIND[tag] in here.scope:
                leave(here.scope[KIND[tag]])
            node = _open(tag, attributes, here, paths)
            if tag in MAIN and "main" not in node.scope:
                node.scope = node.scope | {"main": node}
            nodes.append(node)
            if not (attributes.endswith("/") and tag not in CLOSES_P):
                here = node
                open_[tag] = open_.get(tag, 0) + 1
    close_block()
    return nodes, found


def _smooth(values: list[float]) -> list[float]:
    """Weights 1, 2, 1 along the page."""
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * v + values[min(n - 1, i + 1)]) / 4 for i, v in enumerate(values)]


def ratios(found: list[tuple[_Node, str, int]]) -> dict[int, tuple[float, float]]:
    """The fused scores of every path: length and punctuation a block, less the share in links; smoothed, and its own."""
    sums: dict[int, list[int]] = {}
    for node, text, links in found:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += min(links, len(text))
    length = [s[1] / s[0] for s in sums.values()]
    marks = [s[2] / s[0] for s in sums.values()]
    fused = lambda s, a, b: math.log1p(a) * (1 + math.log1p(b)) * (1 - 0.8 * s[3] / s[1])
    places = zip(sums.items(), _smooth(length), _smooth(marks), length, marks, strict=True)
    return {p: (fused(s, a, b), fused(s, c, d)) for (p, s), a, b, c, d in places}


def _hold(nodes: list[_Node], weights: list[tuple[_Node, float]]) -> float:
    """Sum up what every element holds; return all."""
    for node in nodes:
        node.held = 0.0
    for node, w in weights:
        node.held += w
    for node in reversed(nodes[1:]):  # parents come before children
        node.parent.held += node.held
    return nodes[0].held


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds."""
    nodes, found = read(page or "")
    if not found:
        return ""
    path_score = ratios(found)
    total = _hold(nodes, [(node, path_score[node.path][0] * len(text)) for node, text, _ in found])
    inside = {id(nodes[0]): False}
    for node in nodes[1:]:
        own = 1.0 if node.held >= node.wrapping * total else node.factor
        inside[id(node)] = inside[id(node.parent)] or node.tag in MAIN
        if node.tag in MAIN and not inside[id(node.parent)]:
            own *= WITHIN
        node.factor = own * node.parent.factor
    # neighbours vouch for a short block only where no name speaks against it
    scores = [path_score[node.path][node.factor < 1] * node.factor for node, _, _ in found]
    # what is only ever menus or footers is no article
    if max(node.factor for node, _, _ in found) <= MUCH * WITHIN:
        return ""
    total = _hold(nodes, [(node, score * len(text)) for (node, text, _), score in zip(found, scores, strict=True)])
    container = nodes[0]
    for node in nodes:  # the last one in page order that holds enough is the innermost
        if node.held >= HOLD * total:
            container = node
    up = container
    while up is not None and up.tag not in MAIN:
        up = up.parent
    container = up or container
    within = {id(container)}
    for node in nodes[1:]:
        if id(node.parent) in within:
            within.add(id(node))
    own = [(score, len(text)) for (node, text, _), score in zip(found, scores, strict=True) if id(node) in within]
    limit = THRESHOLD * sum(s * n for s, n in own) / sum(n for _, n in own)
    kept, before = [], True
    for (node, text, _), score in zip(found, scores, strict=True):
        if id(node) in within:
            before = False
        if score >= limit and (id(node) in within or (before and node.tag == "h1" and node.factor >= 1)):
            kept.append(text)
    return "\n".join(kept)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches):
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row; one pass over the rows, no shuffle."""
    ship(pages.sparkSession)
    rows = pages.select(integer_id(pages, id_col).alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
