"""Raw HTML pages to structured documents.

A page becomes a small tree with the standard library's tokeniser. There is no implied end tag: an element stays open
until its own end tag or that of one around it, so a second <p> nests in an unclosed first. Elements without content never open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements and classes that are no content, and the void elements.
NOISE_TAGS = {"nav", "aside", "header", "footer", "script", "style", "noscript", "svg", "iframe"}
NOISE_CLASSES = re.compile("headerlink|viewcode-link|copybutton|prev-next|sphx-glr-footer|sphx-glr-download|toctree-wrapper", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "pre", "table", "ul", "ol", "dt", "dd"}

SCHEMA = (
    "doc_id string, source_url string, title string, category string, version string, headings array<string>, "
    "sections array<struct<title: string, level: int, content: string>>, content string, char_count int, word_count int, error string"
)


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This element's inner elements in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack += reversed(node.children)

    def text(self) -> str:
        return "".join(self.strings())

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    @property
    def classes(self) -> str:
        return " ".join((self.attrs.get("class") or "").split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            node, self.at = self.at, self.at.parent
            self.open[node.name] -= 1
            if node.name == tag:
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str, references: tuple[str, ...] | None = None) -> Node:
    """The page's tree. All character references are read as HTML has them, or only the named ones with their semicolons."""
    tree = _Tree()
    tree.feed(page if references is None else re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", page))
    tree.close()
    return tree.root


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\s#¶]+$", "", text)).strip()


def _without_noise(node: Node) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        at.children = [c for c in at.children if isinstance(c, str) or not (c.name in NOISE_TAGS or any(NOISE_CLASSES.search(x) for x in c.classes.split()))]
        stack += [c for c in at.children if isinstance(c, Node)]


def _table(node: Node) -> str | None:
    rows = [r for r in node.walk() if r.name == "tr"]
    if not rows:
        return ""
    cells = [[clean(c.text()) for c in r.walk() if c.name in ("th", "td")] for r in rows]
    lines = ["| " + " | ".join(c) + " |" for c in cells if c]
    if not lines:
        return None
    if len(lines) > 1:
        lines.insert(1, "| " + " | ".join(["---"] * len(cells[0])) + " |")
    return "\n\n" + "\n".join(lines) + "\n\n"


def markdown(top: Node) -> str:
    """The element as Markdown, from the leaves up, without recursion: pages may nest deeply."""
    done: dict[int, str] = {}
    stack: list[tuple[Node, bool]] = [(top, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        inner = [c if isinstance(c, str) else done.pop(id(c)) for c in node.children]
        done[id(node)] = _rendered(node, inner)
    return done[id(top)]


def _rendered(node: Node, inner: list[str]) -> str:
    name, body = node.name, "".join(inner)
    if name in NOISE_TAGS:
        return ""
    if re.fullmatch("h[1-6]", name):
        return f"\n\n{'#' * int(name[1])} {clean(node.text())}\n\n"
    if name == "p":
        return f"\n\n{body.strip()}\n\n" if body.strip() else ""
    if name == "pre" or name == "div" and "highlight" in node.classes:
        code = (node.first("pre") or node) if name == "div" else node
        return f"\n\n```python\n{code.text().strip()}\n```\n\n"
    if name == "code":
        return f"`{node.text()}`"
    if name == "li":
        return f"- {body.strip()}\n"
    if name in ("ul", "ol"):
        return "\n\n" + "".join(x for c, x in zip(node.children, inner) if isinstance(c, Node) and c.name == "li") + "\n"
    if name == "dt":
        return f"\n\n**{clean(' '.join(s.strip() for s in node.strings() if s.strip()))}**\n"
    if name == "dd":
        return f": {body.strip()}\n\n"
    if name == "table" and (drawn := _table(node)) is not None:
        return drawn
    if name == "div" and "admonition" in node.classes:
        head = next((n for n in node.walk() if "admonition-title" in n.classes), None)
        rest = "".join(x for c, x in zip(node.children, inner) if c is not head).strip()
        return f"\n\n> **{clean(head.text()) if head else 'Note'}:** {rest}\n\n"
    if name == "blockquote":
        return f"\n\n> {body.strip()}\n\n"
    return body


def _sections(article: Node) -> tuple[list[str], list[dict]]:
    """Headings h1 to h4, and the text under each. White space of a section before another is collapsed; the last keeps its lines."""
    headings: list[str] = []
    sections: list[dict] = []
    title, level, lines = "Introduction", 1, []
    inside: set[int] = set()  # elements in a block
    for node in article.walk():
        within = id(node.parent) in inside
        if within or node.name in BLOCKS:
            inside.add(id(node))
        if node.name in ("h1", "h2", "h3", "h4"):
            name = clean(node.text())
            if not name:
                continue
            headings.append(name)
            if lines and (body := clean("\n".join(lines))):
                sections.append({"title": title, "level": level, "content": body})
            title, level, lines = name, int(node.name[1]), []
        elif node.name in BLOCKS and not within and (body := markdown(node).strip()):
            lines.append(body)
    if body := "\n\n".join(lines).strip():
        sections.append({"title": title, "level": level, "content": body})
    return headings, sections


def clean_page(doc_id: str, url: str | None, category: str | None, page: str, references: tuple[str, ...] | None = None) -> dict:
    root = parse(page, references)
    version = next((n.attrs["content"] for n in root.walk() if n.name == "meta" and re.search("docsearch:version|version", n.attrs.get("name", ""), re.I) and n.attrs.get("content")), "stable")
    article = next((n for n in root.walk() if n.name == "article" and "bd-article" in n.classes.split()), None) or root.first("main") or root.first("body") or root
    _without_noise(article)
    heading = article.first("h1")
    headings, sections = _sections(article)
    content = re.sub(r"\n{3,}", "\n\n", markdown(article)).strip()
    return {
        "doc_id": doc_id,
        "source_url": url,
        "title": clean(heading.text()) if heading else doc_id.replace("_", " ").title(),
        "category": category,
        "version": version,
        "headings": headings,
        "sections": sections,
        "content": content,
        "char_count": len(content),
        "word_count": len(content.split()),
        "error": None,
    }


def clean_pages(pages: DataFrame, doc_id: str = "page_id", url: str = "url", html: str = "html", category: str | None = None, references: tuple[str, ...] | None = None) -> DataFrame:
    """Structured documents, one a page. A page that can't be read has only doc_id, source_url, category and error. references: as in `parse`."""
    rows = pages.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(url).cast("string").alias("url"), (F.col(category).cast("string") if category else F.lit(None).cast("string")).alias("category"), F.col(html).alias("html"))
    spark_schema = pages.sparkSession.createDataFrame([], SCHEMA).schema
    arrow_types = {
        **dict.fromkeys(("doc_id", "source_url", "title", "category", "version", "content", "error"), pa.string()),
        **dict.fromkeys(("char_count", "word_count"), pa.int32()),
        "headings": pa.list_(pa.string()),
        "sections": pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("content", pa.string())])),
    }

    def read(row: dict) -> dict:
        if row["html"] is None or row["doc_id"] is None:
            return {"doc_id": row["doc_id"], "source_url": row["url"], "category": row["category"], "error": "no content" if row["html"] is None else "no id"}
        return clean_page(row["doc_id"], row["url"], row["category"], row["html"], references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = [read(r) for r in batch.slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], arrow_types[n]) for n in spark_schema.names], names=spark_schema.names)

    return rows.mapInArrow(run, spark_schema)
