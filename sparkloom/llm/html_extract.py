"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of tokens, words and tags. A word scores by where it stands, most often positive,
a tag by its kind, never positive; the weights are log odds of lying inside the main text, from labelled
pages. One linear scan finds the contiguous run of tokens with the greatest sum: the content region. Its
blocks, without what belongs to menus, forms, adverts and the like inside it, are the text.

A name alone doesn't set aside what the page is about: an element that holds the page's article, or most of its
running words, is a wrapper, whatever it is called (see `_freed`).
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, read
from sparkloom.llm.labelled_pages import LABELLED_PAGES

_TOKEN = re.compile(r"<!--(.*?)(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content is no markup: all up to the end tag is skipped.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    *("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd"),
    *("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "blockquote", "figure", "figcaption", "address", "hr"),
    *("header", "footer", "nav", "aside", "form", "fieldset", "legend", "details", "summary", "menu", "center", "head", "dialog", "hgroup", "search"),
}
#: Elements that never hold main text.
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "svg", "template", "object", "canvas", "audio", "video", "map", "search", "datalist"}
#: Words of class, id and role names that mark what is not main text.
BESIDE = {
    *("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "topbar", "masthead", "toolbar", "skip", "pagination", "pager", "search"),
    *("footer", "contentinfo", "colophon", "copyright", "sidebar", "aside", "complementary", "rail", "widget", "widgets"),
    *("ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner"),
    *("cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "alertdialog", "dialog", "popup", "modal", "overlay", "disclaimer", "paywall"),
    *("newsletter", "subscribe", "subscription", "signup", "login", "register", "form"),
    *("comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "teaser", "teasers", "trending", "popular"),
}
#: First words of class names that tell of a state or layout, not of what an element holds: has-sidebar, no-comments.
STATES = {"has", "no", "with", "without", "is", "js", "hide", "show"}
#: Of BESIDE, what readers write. It may be longer than the main text, so its length tells nothing.
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
#: Of BESIDE, what a section of a text may be about; as its id, these mark it only outside the main text or where it is mostly links.
TOPICS = {"discussion", "related", "search", "navigation", "menu", "register", "subscription", "promotion", "advertising", "consent", "gdpr", "form", "social", "sharing", "popular", "trending", "rail"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of NEVER that may wrap a whole page.
WRAPPERS = {"form", "fieldset"}
#: A wrapper without an article in it has so many times the running words that stand outside all marked elements.
MOST = 4
#: The innermost element with this share of the running words is the content of a page without an article or main.
CONTENT = 0.9
#: What may be the content; a paragraph, list item or the like never is, however long.
CONTAINERS = {"html", "body", "div", "section", "center", "form", "fieldset", "table", "tbody", "thead", "tr", "td", "details", "dialog", "search", "hgroup"}
#: Words that say nothing of what an element holds: a compound name marks an element inside the content only if all its words are of
#: BESIDE or of these, so share-bar does and share-price doesn't.
PLAIN = {
    *("area", "bar", "block", "body", "box", "bottom", "button", "buttons", "card", "cards", "col", "column", "container", "content", "cta", "desktop", "entry", "global", "google", "grid", "group", "header", "heading", "icon", "icons", "inline", "inner"),
    *("item", "items", "label", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "placeholder", "post", "posts", "right", "row", "section", "site", "slot", "stories", "story", "strip", "text", "title", "tools", "top", "unit", "wrap", "wrapper"),
    *("article", "articles", "primary", "secondary", "tertiary", "small", "large", "medium", "wide"),
}
#: What a menu, form or the like may stand in outside the content; of any other element only a whole name tells.
BOXES = CONTAINERS | {"ul", "ol", "dl", "article", "aside", "header", "footer", "nav"}
#: Elements of NEVER that text may hold where no form is around them.
IN_TEXT = {"label"}
#: A page's header, but not an article's.
HEADERS = {"header"}
#: An end is implied by the start of these.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, BLOCKS),
}
_HOLDS = BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


def _mark(name: str, attributes: str, inside: bool) -> tuple[str, str]:
    """How an element's kind, classes, id or role mark it as no main text, and the words that do; inside: it stands in an article or main.

    '' not at all, 'hard' by its kind or as hidden, 'soft' by a name, 'readers' by a name of what readers write, 'topic' by a section's id alone.
    """
    if inside and name in IN_TEXT:
        return "", ""
    if name in NEVER or name == "header" and not inside:
        return "soft" if name in WRAPPERS else "hard", name
    if not attributes or name in ("html", "body", "main"):
        return "", ""
    parts: set[str] = set()
    anchor: set[str] = set()
    whole = inside or name not in BOXES
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key in ("class", "id", "role"):
            if key == "id" and name in HEADINGS:  # made from the heading's words
                continue
            for one in value.split():
                names = _NAME_PART.findall(_CAMEL.sub("-", one).lower())
                if names and names[0] not in STATES and (not whole or all(x in BESIDE or x in PLAIN or len(x) == 1 for x in names)):
                    (anchor if key == "id" else parts).update(names)
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hard", "hidden"
    section = name == "section" or name == "div" and "section" in parts
    if (parts | anchor) & HEADERS and not inside:
        return "soft", "header"
    beside = {"comment", "comments", "teaser", "related", "ad", "ads", "advert", "promo", "sponsored"} if name == "article" else BESIDE
    found = (parts | anchor) & beside
    if not found:
        return "", ""
    if section and not parts & beside and found <= TOPICS:
        return "topic", " ".join(sorted(found))
    return "readers" if found & READERS else "soft", " ".join(sorted(found))


class _Page:
    """A page's tokens, and its elements by number in the order of their start tags; 0 is the page."""

    def __init__(self):
        self.tokens: list[tuple[str, str, int]] = []  # 'text', 'break', 'label' or a tag's feature, its text, the element it stands in
        self.name, self.attributes, self.parent, self.mark, self.by = [""], [""], [0], [""], [""]
        self.inside, self.link = [False], [False]  # in an article or main, in a link
        self.words, self.linked = [0], [0]  # running words and words of links, directly in it

    def open(self, name: str, attributes: str, parent: int) -> int:
        mark, by = _mark(name, attributes, self.inside[parent])
        self.name.append(name)
        self.attributes.append(attributes)
        self.parent.append(parent)
        self.mark.append(mark)
        self.by.append(by)
        self.inside.append(self.inside[parent] or name in ("article", "main"))
        self.link.append(self.link[parent] or name == "a")
        self.words.append(0)
        self.linked.append(0)
        return len(self.name) - 1

    def text(self, raw: str, element: int) -> None:
        text = references.unescape(raw)
        self.tokens.append(("text", text, element))
        (self.linked if self.link[element] else self.words)[element] += len(text.split())

    def sums(self, counts: list[int], skipped: list[bool]) -> list[int]:
        """Of each element the counts of it and of all below that isn't in a skipped element."""
        out = counts[:]
        for i in range(len(out) - 1, 0, -1):
            if not skipped[i]:
                out[self.parent[i]] += out[i]
        return out

    def above(self, element: int) -> list[int]:
        out = []
        while element:
            element = self.parent[element]
            out.append(element)
        return out[:-1] if out else out


def _freed(page: _Page) -> set[int]:
    """The marked elements that are wrappers of main text.

    These hold the page's main, or an article that has as many running words as stand outside all marked elements (MOST
    times as many where another article stands there). Else they bear a name that has most of the page's running
    words, and MOST times those outside; outside the main and articles they are looked for only where these have no words.
    """
    marked = [bool(m) and m != "topic" for m in page.mark]
    if not any(marked):
        return set()
    freed: set[int] = set()

    def free(elements: Iterable[int]) -> None:
        for i in elements:
            if marked[i] and page.by[i] != "hidden":
                marked[i] = False
                freed.add(i)

    def below() -> list[bool]:
        """Of each element whether it is marked or in a marked one."""
        out = marked[:]
        for i in range(1, len(out)):
            out[i] = out[i] or out[page.parent[i]]
        return out

    everything = page.sums(page.words, [False] * len(marked))
    if mains := [i for i, name in enumerate(page.name) if name == "main" and everything[i]]:
        free(page.above(max(mains, key=lambda i: (everything[i], -i))))
    held, aside = page.sums(page.words, marked), below()
    articles = [i for i, name in enumerate(page.name) if name == "article" and held[i] and not marked[i]]
    if not mains and (hidden := [i for i in articles if aside[i]]):
        best = max(hidden, key=lambda i: (held[i], -i))
        if held[best] > MOST * held[0] if len(hidden) < len(articles) else held[best] >= held[0]:
            free(page.above(best))
            held, aside = page.sums(page.words, marked), below()
    found = any(page.name[i] in ("article", "main") and held[i] and not aside[i] for i in range(len(marked)))
    groups: dict[str, list[int]] = {}
    for i, mark in enumerate(page.mark):
        if marked[i] and (mark == "soft" or mark == "readers" and not held[0]) and (page.inside[i] or not found):
            groups.setdefault(page.by[i], []).append(i)
    total = held[0] + sum(n for n, m in zip(held, marked) if m)
    for name, group in groups.items():
        n = sum(held[i] for i in group)
        if 2 * n > total and n > MOST * held[0]:
            # page builders call every block a widget; else a wrapper and what it is named after may share a name
            for i in [i for i in group if name == "widget" or 2 * held[i] > n]:
                free([i, *(k for k in page.above(i) if page.mark[k] != "hard")])
            break
    return freed


def _content(page: _Page, out: list[bool]) -> int:
    """The innermost container with nearly all running words outside the elements set beside, and all titles; 0 where that is the body or the page."""
    held = page.sums(page.words, out)
    titles = page.sums([int(name == "h1") for name in page.name], out)
    best = 0
    for i in range(1, len(held)):  # a child comes after its parent
        if page.parent[i] == best and not out[i] and page.name[i] in CONTAINERS and held[i] and held[i] >= CONTENT * held[0] and titles[i] == titles[best]:
            best = i
    return 0 if page.name[best] in ("", "html", "body") else best


def page_tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(feature, text, counts) in page order: tags with '' as text (br with a space), text nodes with their text, 'break' where a block begins or ends.

    A feature of text: word:out (in an element set beside), word:link (outside the article, main or content), word:main (in article or main),
    word:beside (the page has an article or main, elsewhere) or word:plain. counts: whether its text can be main text.
    A tag inside the article, main or content has the feature held, before its own: how that is marked up, as a list of short items, say, tells nothing.
    What is set beside there has the feature bridge, words and tags alike: it is left out
    of the text anyway and so can't tell where the text ends.
    The comments main and /main of labelled pages come as 'label'.
    """
    read = _read(page)
    structured = bool(re.search(r"<(?:article|main)[\s>]", page.lower()))
    freed, n = _freed(read), len(read.name)
    out = [bool(m) and m != "topic" and i not in freed for i, m in enumerate(read.mark)]
    content = 0 if structured else _content(read, out)
    within = read.inside[:]
    for i in range(1, n):
        within[i] = within[i] or i == content or within[read.parent[i]]
        if content and out[i] and i != content and within[i] and (read.mark[i] in ("soft", "readers") and read.name[i] not in NEVER | HEADERS or read.name[i] in IN_TEXT):
            read.mark[i], read.by[i] = _mark(read.name[i], read.attributes[i], True)  # known to stand in the content, as in an article
            out[i] = bool(read.mark[i]) and read.mark[i] != "topic"
    topics = [i for i, m in enumerate(read.mark) if m == "topic"]
    if topics:
        running, linked = read.sums(read.words, out), read.sums(read.linked, out)
        for i in topics:
            out[i] = not within[i] or linked[i] >= running[i]
    bridge = [False] * n
    for i in range(1, n):
        above = read.parent[i]
        bridge[i] = bridge[above] if out[above] else out[i] and within[above]
        out[i] = out[i] or out[above]
    for feature, text, i in read.tokens:
        if bridge[i] and feature not in ("break", "label"):
            yield "bridge", "", False
        elif feature == "text":
            kind = "out" if out[i] else "link" if read.link[i] and not within[i] else "main" if read.inside[i] else "beside" if structured else "plain"
            yield f"word:{kind}", text, not out[i]
        elif within[i] and not out[i] and feature not in ("break", "label"):
            yield f"held:{feature}", text, False
        else:
            yield feature, text, False


def _read(page: str) -> _Page:
    lower = page.lower()
    read = _Page()
    tokens = read.tokens
    stack: list[tuple[str, int]] = [("", 0)]  # name, element
    at = 0

    def close(to: int) -> None:
        del stack[to:]

    while found := _TOKEN.search(page, at):
        if found.start() > at:
            read.text(page[at : found.start()], stack[-1][1])
        at = found.end()
        comment, end, name, attributes = found.groups()
        if name is None:
            if comment in ("main", "/main"):
                tokens.append(("label", comment, stack[-1][1]))
            continue
        name = name.lower()
        if name in RAW and not end:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]").search(lower, at)
            tokens.append(("tag:" + name, "", stack[-1][1]))
            if stop is None:
                return read
            at = lower.find(">", stop.start()) + 1 or len(page)
            continue
        if name == "br":
            tokens.append(("tag:br", " ", stack[-1][1]))
            continue
        if name in BLOCKS:
            tokens.append(("break", "", stack[-1][1]))
        tokens.append(("tag:" + end + name, "", stack[-1][1]))
        if name in VOID:
            continue
        if end:
            barrier = _HOLDS if name not in _HOLDS else {"table"} if name not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main") else set()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in barrier:
                    break
            continue
        if name in _CLOSES:
            ends, within = _CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    if name != "tr":
                        break
                elif stack[i][0] in within:
                    break
        elif name in BLOCKS:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _HOLDS:
                    break
        if not attributes.rstrip().endswith("/") or name in BLOCKS or name == "a":
            stack.append((name, read.open(name, attributes, stack[-1][1])))
    if at < len(page):
        read.text(page[at:], stack[-1][1])
    return read


_GROUPS = {"p": "paragraph", "br": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "li": "list", "dl": "list", "dt": "list", "dd": "list"}
_GROUPS |= dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table")
_GROUPS |= dict.fromkeys(("b", "i", "em", "strong", "span", "code", "sub", "sup", "u", "small", "mark", "q", "cite", "abbr", "time", "pre", "blockquote", "figure", "figcaption", "img", "kbd", "var", "samp", "del", "ins", "s"), "inline")
_GROUPS |= {"a": "link", "div": "block", "section": "block", "article": "article", "main": "article"} | dict.fromkeys(NEVER | {"header"}, "beside")


def _feature(feature: str) -> str:
    if feature.startswith("held:"):
        return "held"
    return "tag:" + _GROUPS.get(feature[4:].lstrip("/"), "other") if feature.startswith("tag:") else feature


def learn_weights(labelled: Iterable[str] = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of lying inside the main text, by feature, with one count added to either side.

    Words are kept within 2 of zero; tags are at most -0.05, so that no run of tags gains by itself, and at least -2.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in labelled:
        main = False
        for feature, text, _ in page_tokens(page):
            if feature == "label":
                main = text == "main"
            elif feature not in ("break", "bridge"):
                n = len(text.split()) if feature.startswith("word:") else 1
                for f in {_feature(feature), _feature(feature.removeprefix("held:"))}:  # a tag in the content tells of its kind, too
                    (inside if main else outside)[f] += n
    weights = {}
    for f in inside | outside:
        odds = math.log((inside[f] + 1) / (outside[f] + 1))
        weights[f] = max(-2.0, min(2.0, odds)) if f.startswith("word:") else max(-2.0, min(-0.05, odds))
    return weights


@cache
def _default_weights() -> dict[str, float]:
    return learn_weights()


def extract(page: str, weights: dict[str, float] | None = None) -> str:
    """The main text: blocks joined by line feeds, white space inside a block turned into one space."""
    weights = weights or _default_weights()
    nodes: list[tuple[str, bool] | None] = []  # text with whether it counts; None at a block's edge
    score = best = 0.0
    begin = first = last = 0
    known: dict[str, float] = {}
    for feature, text, counts in page_tokens(page):
        if feature == "break":
            nodes.append(None)
            continue
        if feature in ("label", "bridge"):
            continue
        if feature not in known:
            known[feature] = weights.get(_feature(feature), 0.0 if feature == "word:plain" else -0.3)
        if feature.startswith("word:"):
            n = len(text.split())
            nodes.append((text, counts))
            gain = n * known[feature]
        else:
            if text:
                nodes.append((text, True))
            gain = known[feature]
        if score <= 0:
            score, begin = 0.0, len(nodes) - 1 if feature.startswith("word:") else len(nodes)
        score += gain
        if score > best:
            best, first, last = score, begin, len(nodes)
    # a block that the region cuts is taken whole
    while first > 0 and nodes[first - 1] is not None:
        first -= 1
    while last < len(nodes) and nodes[last] is not None:
        last += 1
    blocks, block = [], []
    for node in [*nodes[first:last], None]:
        if node is None:
            if line := " ".join("".join(block).split()):
                blocks.append(line)
            block = []
        elif node[1]:
            block.append(node[0])
    return "\n".join(blocks) if best > 0 else ""


def extract_pages(pages: DataFrame, labelled: Iterable[str] = LABELLED_PAGES) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points).

    Null and empty html, and pages without a region that gains, have an empty text; of regions that gain the same the first counts. Repeated
    rows give a row each, and rows don't depend on each other. Very long pages are taken whole, one at a time. An empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    weights = learn_weights(labelled)

    def make(cols: dict) -> dict:
        texts = [extract(x, weights) for x in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    kept = pages.select("page_id", F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    return by_batch(kept, make, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long", rows=500)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
