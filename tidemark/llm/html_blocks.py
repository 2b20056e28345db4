"""Main text of web pages: flat text blocks, classified by a decision tree over a block and its neighbours.

A page becomes a flat list of text blocks, cut at block-level tags. A block's features are its own and its neighbours' word counts
and link densities, whether it is a heading or an item of a list, and two that tell of markup: whether it lies in what the page
marks as its article, and how surely an element around it is marked as something else (by tag names and by words in class,
id and role). A CART tree decides; it is grown from blocks of a small table of labelled pages in this module. Gains of splits on
markup count less, so that the text decides where it can, on every page.

Tags are read as browsers read them: attributes may be bare, quoted or empty, and as many as they like. If a tag is
never closed outside quotes, it and those after it end at the next >.

Defined results: null and empty pages have an empty text, as have pages without a content block. Elements that are never
closed end where their parent ends, or with the page. Repeated rows and null ids stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of
from .store import text_map

#: A tag's attributes: names, each with no value, a quoted one, a bare one (which may have quotes in it) or an empty one.
INSIDE = r"""((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+)*+)"""
TAG = r"<(/?)([a-zA-Z][^\s/>]*+)"
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
TOKEN = re.compile(COMMENT + "|" + TAG + "(?:" + INSIDE + r"(>))?|<[!?/][^>]*+>?", re.S)
#: The same after a tag that is never closed outside quotes.
LOOSE_TOKEN = re.compile(COMMENT + "|" + TAG + r"(?:([^>]*+)(>))?|<[!?/][^>]*+>?", re.S)
#: Elements that hold raw text, no part of the page's, up to their own end tag.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in "script style textarea title iframe noscript noembed noframes".split()}
#: Elements whose contents, parsed like others, are not shown as text. A slash closes one at once.
UNSEEN = {"svg", "template", "object", "canvas", "select", "datalist", "audio", "video", "annotation", "annotation-xml"}
QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
#: The end of a tag's inside that is a value without quotes: a slash there belongs to the value.
BARE_VALUE = re.compile(r'=\s*[^\s"]\S*\Z')
XHTML = re.compile(r"\s*<\?xml\b|<!doctype[^>]*\bxhtml\b|<html\b[^>]*\bxmlns\b", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-label|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "mi", "mn", "mo", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "semantics"}
#: Opening one of these ends a paragraph that is still open.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select", "datalist"}}

#: What an element says about its contents, by tag.
ARTICLE_TAGS = {"article": 3, "main": 2}
TAG_KIND = {"nav": "menu", "menu": "menu", "header": "frame", "footer": "frame", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "dialog": "notice", "head": "frame"}
#: The same, by words in class, id, role and label.
WORD_KIND = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip sitemap",
    "frame": "header footer masthead banner topbar bottombar copyright colophon contentinfo site legal",
    "side": "sidebar aside complementary widget widgets related recommended recommendations trending popular archive archives tags tagcloud blogroll",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog toast warning disclaimer newsletter subscribe subscription signup paywall",
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner-ad adsbygoogle dfp outbrain taboola",
    "comment": "comment comments commentlist disqus reply replies respondents discussion reader-comments feedback reviews",
    "form": "form search searchbox login signin register share sharing social",
}
#: Words that mark an article, surely or perhaps; what is marked most surely on a page is its article.
ARTICLE_WORDS = {w: 3 for w in "articlebody article-body entry-content post-content post-body story-body".split()} | {w: 1 for w in "content article post entry story blog-post".split()}
KIND_OF_WORD = {w: kind for kind, words in WORD_KIND.items() for w in words.split()}
#: With one of these words, an element is a layout that has such a part beside others.
WHOLE = {"with", "has", "no", "open", "closed", "layout"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Words of kinds that name parts of articles, too: alone they are a weak mark.
WEAK = set("warning disclaimer discussion feedback reviews archive archives popular trending legal site tags social".split())
#: Words that say no more than that an element is one; beside them a mark stays as sure as it is.
FILLER = set("bar box block list item items link links section area container wrapper wrap inner outer panel content contents main top bottom left right primary secondary global page posts post articles stories news module unit slot text title heading body row col column group form button thread reader user site nav menu".split())
#: Kinds that hold whatever part of the page they cover. What is marked as another kind, outside an article, and covers more of the page's words than WHOLE_PAGE is the page itself.
ALWAYS = {"ad", "comment"}
WHOLE_PAGE = 0.8

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "list_item", "article", "unwanted"]
#: What a split's gain is multiplied by: markup counts less.
TRUST = np.array([1, 1, 1, 1, 1, 1, 1, 1, 0.4, 0.4])


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    level: int  # how surely it lies in the page's article
    marks: tuple[tuple[int, int, bool], ...]  # of elements around it: number, strength (1: weak, 2: sure), whether it holds for whole pages
    heading: bool
    list_item: bool

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _strength(token: str) -> list[tuple[str, int]]:
    """The kinds that a class, id or role names, weakly (1) or surely (2): surely if it says nothing else."""
    whole = token.lower()
    parts = [x.lower() for x in NAME_PART.findall(token)]
    if not WHOLE.isdisjoint(parts):
        return []
    if whole in KIND_OF_WORD and whole not in parts:
        return [(KIND_OF_WORD[whole], 2)]
    sure = all(x in KIND_OF_WORD or x in FILLER or x.isdigit() for x in parts) and not all(x in WEAK or x in FILLER for x in parts)
    return [(KIND_OF_WORD[x], 2 if sure else 1) for x in parts if x in KIND_OF_WORD]


def _marks(tag: str, attributes: str, inside_article: bool) -> tuple[str | None, int, int]:
    """What an element says that it holds: another kind than an article, how surely (0 to 2), and how surely an article (0 to 3). Kind "hidden": it is not shown."""
    level = ARTICLE_TAGS.get(tag, 0)
    if attributes:
        tokens = []
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hidden", 2, 0
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                tokens += value.split()
        if tag in ("html", "body"):  # their classes tell of what the page has somewhere
            return None, 0, 0
        words = {t.lower() for t in tokens} | {x.lower() for t in tokens for x in NAME_PART.findall(t)}
        if "main" in words and tag not in ("article", "nav", "header", "footer", "aside"):
            level = max(level, 2 if re.search(r"role\s*=\s*[\"']?main", attributes, re.I) else 1)
        found = [x for t in tokens for x in _strength(t)]
        if tag in ARTICLE_TAGS:
            found = [x for x in found if tag == "article" and x[0] in ALWAYS]
        if inside_article or level:
            found = [x for x in found if x[0] != "frame"]
        kind, sure = max(found, key=lambda x: x[1], default=(None, 0))
        if sure == 2:
            return kind, 2, 0
        level = max([level, *(ARTICLE_WORDS[w] for w in words if w in ARTICLE_WORDS)])
        if kind and tag not in TAG_KIND:
            return kind, 1, level
    kind = TAG_KIND.get(tag)
    if kind and not (tag == "header" and inside_article):  # an article's own header has its title
        return kind, 2, level
    return None, 0, level


def _self_closed(inside: str) -> bool:
    return inside.endswith("/") and not BARE_VALUE.search(QUOTED.sub('""', inside))


@dataclass(slots=True)
class Element:
    tag: str = ""
    level: int = 0
    marks: tuple[tuple[int, int, bool], ...] = ()
    own: bool = False  # an inline element whose text is a block of its own
    unseen: bool = False
    heading: bool = False
    list_item: bool = False


PAGE = Element()


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order; blocks without text are left out."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked: list[str] = []
    anchors = serial = 0
    opened: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                links = sum(len(unescape(x).split()) for x in linked)
                top = stack[-1] if stack else PAGE
                out.append(Block(text, len(text.split()), links, top.level, top.marks, top.heading, top.list_item))
            parts.clear()
        linked.clear()

    def pop(to: int) -> None:
        nonlocal anchors
        while len(stack) > to:
            tag = stack.pop().tag
            opened[tag] -= 1
            if tag == "a":
                anchors -= 1

    def take(raw: str) -> None:
        if not (stack and stack[-1].unseen):
            parts.append(raw)
            if anchors:
                linked.append(raw)

    at = look = 0
    token, xhtml = TOKEN, XHTML.search(html[:2000]) is not None
    while m := token.search(html, look):
        tag, inside, look = m[2], m[3], m.end()
        if tag and not m[4]:  # closed nowhere outside quotes
            token = LOOSE_TOKEN
            end = html.find(">", m.end(2))
            if end < 0:  # no tag can end any more: text
                break
            inside, look = html[m.end(2) : end], end + 1
        if m.start() > at:
            take(html[at : m.start()])
        tag = tag.lower() if tag else None
        if tag in RAW and not m[1]:
            if not (xhtml and _self_closed(inside)):
                end = RAW[tag].search(html, look)
                look = end.end() if end else len(html)
            tag = None
        at = look
        if not tag:  # a comment, or raw text
            continue
        if tag == "br":
            take(" ")
            continue
        if tag not in INLINE and not (tag in UNSEEN or stack and stack[-1].unseen):
            flush()
        elif tag in ("img", "wbr"):
            continue
        if m[1]:
            if not opened.get(tag):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if any(e.own for e in stack[i:]):
                        flush()
                    pop(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID or (tag in UNSEEN or tag == "math") and _self_closed(inside):
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in ENDS_SELF:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if stack[i].tag in ENDS_SELF[tag] or stack[i].tag == "table":
                    break
        up = stack[-1] if stack else PAGE
        kind, sure, level = _marks(tag, inside.strip(), up.level > 0) if tag not in INLINE or inside else (None, 0, 0)
        own = tag in INLINE and (sure == 2)  # an inline advert, say
        if own:
            flush()
        if tag == "a":
            anchors += 1
        opened[tag] = opened.get(tag, 0) + 1
        serial += 1
        marks = (*up.marks, (serial, sure, kind in ALWAYS or up.level > 0)) if sure and kind != "hidden" else up.marks
        stack.append(Element(tag, max(up.level, level), marks, own, up.unseen or kind == "hidden" or tag in UNSEEN, up.heading or tag in HEADINGS, up.list_item or tag in ("li", "dd", "dt")))
    if at < len(html):
        take(html[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """FEATURES of each block. article: 1 within what the page marks most surely as its article, -1 outside or in what it surely marks as something else, 0 if it marks neither; unwanted: 0 to 2."""
    words = np.array([b.words for b in found], float)
    links = np.array([b.links for b in found], float)
    covered: dict[int, int] = {}
    for b in found:
        for number, _, _ in b.marks:
            covered[number] = covered.get(number, 0) + b.words
    most_words = WHOLE_PAGE * words.sum()
    unwanted = np.array([max((s for n, s, always in b.marks if always or covered[n] <= most_words), default=0) for b in found], float)
    level = np.array([b.level for b in found])
    most = level[unwanted < 2].max(initial=0)
    article = np.where(unwanted == 2, -1.0, np.where(level == most, 1.0, -1.0) if most else 0.0)
    zero = np.zeros(1)
    around = [np.concatenate((zero, words[:-1])), np.concatenate((zero, links[:-1])), np.concatenate((words[1:], zero)), np.concatenate((links[1:], zero))]
    return np.column_stack([words, links, *around, np.array([b.heading for b in found], float), np.array([b.list_item for b in found], float), article, unwanted])


#: The labelled pages. {n} stands for n words; a block that begins with + is content.
MENU = "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav>"
LABELLED_PAGES = [
    # an article element between menus, adverts, sidebars, comments and footers
    f"<header><h2>{{4}}</h2><p>{{18}}</p></header>{MENU}<div class=ad>{{9}}</div><article><h1>+{{8}}</h1><p>+{{60}}</p><p>+{{3}}</p><p>+{{80}}</p><ul><li>+{{5}}<li>+<a>{{2}}</a></ul><blockquote>+{{9}}</blockquote>"
    "<p>+{1}</p><div class=advert><p>{16}</p></div><p>+{30} <a>{9}</a></p></article><aside><h3>{2}</h3><p>{25}</p></aside><section id=comments><h3>{2}</h3><p>{22}</p><p>{40}</p></section><footer><p>{20}</p></footer>",
    f"{MENU}<div class=ad>{{12}}</div><article><h1>+{{6}}</h1><p>+{{70}}<p>+{{2}}<p>+{{45}}<p>+{{4}}<p>+{{90}}</article><footer>{{14}}</footer>",
    f"{MENU}<article><p>+{{5}}</p><p>+{{6}}</p></article><div class=sidebar><ul><li><a>{{6}}</a><li><a>{{7}}</a></ul><p>{{30}}</p></div><form><label>{{3}}</label><button>{{1}}</button></form><footer>{{12}}</footer>",
    # other marks of an article, and chrome that nothing marks
    f"<p>{{8}}</p>{MENU}<main><h1>+{{7}}</h1><p>+{{50}}</p><aside>{{28}}</aside><p>+{{2}}</p><p>+{{35}}</p></main><p>{{25}}</p><h3>{{3}}</h3><p>{{12}}</p>",
    f"<div id=cookie-consent><p>{{24}}</p></div>{MENU}<div class=entry-content><h2>+{{5}}</h2><p>+{{40}}</p><h2>+{{2}}</h2><p>+{{65}}</p><div class=newsletter-signup><p>{{15}}</p></div><p>+{{18}}</p></div><div class=related-posts><h3>{{2}}</h3><p>{{24}}</p></div><p>{{40}}</p>",
    f"<div class=post><h1>+{{6}}</h1><p>+{{55}}</p><ul class=share><li><a>{{1}}</a><li><a>{{1}}</a></ul><p>+{{8}}</p></div><div class=comments><article><p>{{26}}</p></article></div><div><p>{{7}}</p></div>",
    # sections of articles whose names also name other things
    f"{MENU}<article><h1>+{{7}}</h1><p>+{{40}}</p><section id=related-work><h2>+{{2}}</h2><p>+{{70}}</p></section><div class=warning><p>+{{20}}</p></div><section class=feedback-loops><p>+{{35}}</p></section><section class=social-history><p>+{{45}}</p></section><div class=tags><a>{{1}}</a> <a>{{1}}</a></div></article><footer>{{16}}</footer>",
    f"<div class=story-archive>{MENU}<h1>+{{6}}</h1><p>+{{45}}</p><div class=discussion-of-results><p>+{{30}}</p></div><p>+{{50}}</p><div class=popular-now><a>{{4}}</a> <a>{{5}}</a></div></div>",
    # nothing is marked: the text decides
    "<div><a>{1}</a> | <a>{1}</a> | <a>{2}</a></div><div>{2}</div><h1>+{7}</h1><p>+{60}</p><p>+{70}</p><p>+{4}</p><p>+{55}</p><p>+{12}</p><p>+{40}</p><div><a>{3}</a> <a>{4}</a></div><div>{5}</div>",
    "<table><tr><td><a>{2}</a><td><a>{1}</a><td><a>{1}</a></table><h2>+{5}</h2><p>+{30}</p><ul><li>+{18}<li>+{22}<li>+{14}</ul><p>+{35} <a>{8}</a></p><h2>+{3}</h2><p>+{28}</p><p>+{45}</p><table><tr><td><a>{5}</a><td>{3}<td><a>{2}</a></table>",
    "<div><a>{6}</a></div><div><a>{9}</a> {1}</div><div><a>{8}</a></div><p>+{90}</p><p>+{16}</p><p>+{120}</p><div>{4} <a>{6}</a></div><div><a>{7}</a></div><div><a>{10}</a> {2}</div>",
    "<div>{3}</div><div><a>{1}</a></div><div>{9}</div><div><a>{2}</a></div><p>+{24}</p><p>+{26}</p><p>+{20}</p><div><a>{2}</a></div><div>{6}</div><div><a>{12}</a> {3}</div>",
    "<p>+{90}</p>",
    f"{MENU}<article><h1>+{{5}}</h1><p>+{{64}}</p><ul><li>+<a>{{3}}</a><li>+<a>{{2}}</a><li>+<a>{{6}}</a></ul><p>+{{58}}</p><p>+<a>{{4}}</a></p><p>+{{2}}</p><p>+{{31}}</p><dl><dt>+{{1}}<dd>+{{8}}</dl><p>+<a>{{9}}</a></p></article><div>{{16}}</div><p>{{34}}</p><div><a>{{4}}</a></div>",
    "<article><h1>+{4}</h1><p>+<a>{5}</a></p><p>+{20}</p></article>",
    "<article><p>+{1}</p><p>+{1}</p><p>+{2}</p><p>+{1}</p></article>",
    "<article><p>+{2}</p></article><p>{1}</p>",
    "<div class=entry-content><p>+{3}</p><p>+{8}</p><p>+{2}</p></div><div>{4}</div>",
    "<article><h1>+{1}</h1><p>+{4}</p><p>+{12}</p><p>+{3}</p></article><footer>{6}</footer>",
    "<article><p>+{25}</p><ul><li>+{1}<li>+<a>{1}</a></ul></article>",
    "<article><p>+{14}</p><blockquote>+{7}</blockquote><p>+<a>{4}</a></p></article>",
    f"{MENU}<article><h1>+{{3}}</h1><p>+{{9}}</p><p>+{{2}}</p><ul><li>+{{2}}<li>+<a>{{2}}</a></ul></article>",
    "<main><p>+<a>{3}</a></p><p>+{2}</p><p>+<a>{6}</a></p><p>+{30}</p></main><div><a>{2}</a></div>",
    f"{MENU}<div role=main><p>+{{36}}</p><p>+<a>{{2}}</a></p><p>+{{5}}</p><div class=sharing><a>{{1}}</a> <a>{{1}}</a></div><p>+{{21}}</p><div class=ad><p>{{38}}</p></div><p>+{{44}}</p></div><p>{{52}}</p><p>{{3}}</p>",
    f"{MENU}<div class=sidebar><p>{{42}}</p></div><p>+{{39}}</p><p>+{{2}}</p><p>+{{66}}</p><div class=popup><p>{{33}}</p></div><p>+{{29}}</p><p>+{{71}}</p><div class=tags><a>{{1}}</a> <a>{{2}}</a></div><div class=legal>{{4}}</div>",
    "<h1>+{5}</h1><p>+{33}</p><p>+{6}</p><h2>+{3}</h2><p>+{48}</p><p>+{7}</p><p>+{52}</p>",
    "<div><a>{8}</a> {5}</div><h3>{4}</h3><div><a>{7}</a> {6}</div><h3>{5}</h3><div><a>{12}</a></div><div>{4}</div><div><a>{3}</a></div>",
    # marks of other things, but none of an article; a form around the whole page
    "<div class=sidebar><p>{32}</p><p>{12}</p></div><h1>+{6}</h1><p>+{44}</p><p>+{58}</p><div class=cookie-notice><p>{26}</p></div><p>+{5}</p><p>+{37}</p><div class=footer><p>{19}</p></div>",
    f"<form id=page-form>{MENU}<h1>+{{6}}</h1><p>+{{62}}</p><p>+{{48}}</p><p>+{{3}}</p><p>+{{41}}</p><div class=footer>{{13}}</div></form>",
]


#: Each page counts at several sizes: what is said of a block of 20 words holds for one of 14 or 30, too.
SIZES = (0.7, 1.0, 1.5)


def labelled(pages: list[str], sizes: tuple[float, ...] = SIZES) -> list[tuple]:
    """FEATURES and label (1: content) of all blocks of labelled pages."""
    rows = []
    for page, size in product(pages, sizes):
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(1, round(size * int(m[1])))), page))
        rows += [(*x, float(b.text.startswith("+"))) for x, b in zip(features(found).tolist(), found, strict=True)]
    return rows


LABELLED = labelled(LABELLED_PAGES)


@dataclass
class DecisionTree:
    """CART by Gini impurity; gains are weighed by `trust`, one for each column. node i sends rows with value <= threshold[i] to left[i], others to right[i]; leaves have column -1 and a verdict."""

    column: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    verdict: list[bool]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trust: np.ndarray, depth: int = 10, least: int = 1) -> DecisionTree:
        tree = cls([], [], [], [], [])
        tree._grow(x, y, trust, depth, least)
        return tree

    def _grow(self, x: np.ndarray, y: np.ndarray, trust: np.ndarray, depth: int, least: int) -> int:
        at = len(self.column)
        for values, v in ((self.column, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.verdict, bool(2 * y.sum() > len(y)))):
            values.append(v)
        if depth and 0 < y.sum() < len(y):
            best = (1e-12, 0, 0.0)
            whole = _gini(y.sum(), len(y))
            for c in range(x.shape[1]):
                values = np.unique(x[:, c])
                for v in (values[1:] + values[:-1]) / 2:
                    low = x[:, c] <= v
                    if not least <= low.sum() <= len(y) - least:
                        continue
                    gain = trust[c] * (whole - _gini(y[low].sum(), low.sum()) - _gini(y[~low].sum(), (~low).sum()))
                    if gain > best[0] + 1e-12:
                        best = (gain, c, float(v))
            gain, c, v = best
            if gain > 1e-9:
                low = x[:, c] <= v
                self.column[at], self.threshold[at] = c, v
                self.left[at] = self._grow(x[low], y[low], trust, depth - 1, least)
                self.right[at] = self._grow(x[~low], y[~low], trust, depth - 1, least)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        column, threshold, left, right = (np.array(v) for v in (self.column, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := column[at] >= 0).any():
            at = np.where(inner, np.where(x[rows, column[at]] <= threshold[at], left[at], right[at]), at)
        return np.array(self.verdict)[at]


def _gini(ones: float, n: float) -> float:
    return 2 * ones * (n - ones) / n if n else 0.0


def train(labelled: list[tuple] = LABELLED) -> DecisionTree:
    table = np.array(labelled, float)
    return DecisionTree.fit(table[:, :-1], table[:, -1], TRUST)


def main_text(html: str | None, tree: DecisionTree) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    return "\n".join(b.text for b, ok in zip(found, tree.predict(features(found)).tolist(), strict=True) if ok)


def extract(pages: DataFrame, labelled: list[tuple] = LABELLED) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    tree = train(labelled)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pages_ = [blocks(h) if h else [] for h in part.column(2).to_pylist()]
                sizes = [len(p) for p in pages_]
                verdict = iter(tree.predict(np.concatenate([features(p) for p in pages_ if p])).tolist() if any(sizes) else [])
                texts = ["\n".join([b.text for b in p if next(verdict)]) for p in pages_]
                yield batch_of(schema, part.column(0), part.column(1).cast(pa.string()), texts, [len(t) for t in texts])

    return text_map(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, "page_id bigint, url string, text string, n_chars bigint")
