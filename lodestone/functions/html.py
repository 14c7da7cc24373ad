"""HTML pages: text, links, language, robots directives, main article and markdown, by the parser of the standard library.

Browsers repair broken HTML in more ways than this parser does; where a page is broken, results may differ from theirs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.urls import canonical, joined

# Elements whose text is none, and elements that end a line.
SKIPPED = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset(
    "p div section article header footer aside nav main blockquote pre figure figcaption ul ol li dl dt dd table tr td th br hr h1 h2 h3 h4 h5 h6".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACES = re.compile(r"\s+")


class _Scan(HTMLParser):
    """One pass over a page, collecting what any of the functions below need."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.marked: list[str] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.language = self.base = ""
        self.robots: set[str] = set()
        self.open: list[str] = []
        self.paragraphs: list[tuple[str, str]] = []
        self.href: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and not self.language:
            self.language = a.get("lang", "")
        elif tag == "base" and not self.base:
            self.base = a.get("href", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "meta" and a.get("name", "").lower() == "robots":
            self.robots |= {w.strip() for w in a.get("content", "").lower().split(",")}
        if tag in ("br", "hr"):
            self.text.append("\n")
            self.marked.append("\n---\n" if tag == "hr" else "\n")
        elif tag not in _VOID:
            self.open.append(tag)
            if not SKIPPED & set(self.open):
                if tag[0] == "h" and tag[1:].isdigit():
                    self.marked.append("\n\n" + "#" * int(tag[1:]) + " ")
                elif tag in ("strong", "b", "em", "i", "code"):
                    self.marked.append({"strong": "**", "b": "**", "code": "`"}.get(tag, "*"))
                elif tag == "a":
                    self.href.append(a.get("href", ""))
                    self.marked.append("[")
                elif tag == "li":
                    lists = [x for x in self.open if x in ("ul", "ol")]
                    self.marked.append("\n" + "  " * max(len(lists) - 1, 0) + ("1. " if lists[-1:] == ["ol"] else "- "))
                elif tag == "blockquote":
                    self.marked.append("\n\n> ")
                elif tag in BLOCKS:
                    self.marked.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if last in BLOCKS:
                self.text.append("\n")
            if last in ("strong", "b", "em", "i", "code"):
                self.marked.append({"strong": "**", "b": "**", "code": "`"}.get(last, "*"))
            elif last == "a":
                self.marked.append(f"]({self.href.pop() if self.href else ''})")
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if "title" in self.open and "svg" not in self.open:
            self.title.append(data)
        if SKIPPED & set(self.open):
            return
        shown = data.replace("\n", " ")
        self.text.append(shown)
        if "title" not in self.open:
            self.marked.append(_SPACES.sub(" ", shown))
            block = next((x for x in reversed(self.open) if x in BLOCKS), "")
            path = "/".join(x for x in self.open if x in BLOCKS)
            if shown.strip() and not {"nav", "header", "footer", "aside"} & set(self.open):
                self.paragraphs.append((path if block else "", _SPACES.sub(" ", shown).strip() if "a" not in self.open else ""))


def _scan(body: str) -> _Scan:
    s = _Scan()
    s.feed(body)
    s.close()
    return s


def flattened(body: str | None) -> str | None:
    """Text of a page: a line for each block, spaces collapsed, empty lines left out."""
    if body is None:
        return None
    lines = ("".join(_scan(body).text)).split("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def two_letters(lang: str) -> str | None:
    m = re.match(r"^([a-z]{2})(?:-.*)?$", lang.strip().lower())
    return m.group(1) if m else None


def extracted(url: str | None, body: str | None) -> dict | None:
    """Title, language, counts of distinct local and external links, the links, and whether the page refuses indexing or following."""
    if url is None or body is None:
        return None
    s = _scan(body)
    base = joined(url, s.base) or url if s.base else url
    links = list(dict.fromkeys(x for x in (joined(base, link) for link in s.links) if x))
    host = (canonical(url) or "").split("/")[2:3]
    local = sum(x.split("/")[2:3] == host for x in links)
    return {
        "title": " ".join("".join(s.title).split()), "language": two_letters(s.language), "local_links": local, "external_links": len(links) - local, "links": links,
        "refuses_indexing": bool({"noindex", "none"} & s.robots), "refuses_following": bool({"nofollow", "none"} & s.robots),
    }


def markdown(body: str | None) -> str | None:
    """A page as markdown: headings, emphasis, links, lists, quotes; paragraphs parted by an empty line."""
    if body is None:
        return None
    text = "".join(_scan(body).marked)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*(?![ \t]*[-1]\.? )", "\n", text)).strip()


class _Node:
    """An element, with its text and elements in order."""

    __slots__ = ("tag", "attrs", "parent", "inside")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []


class _Tree(HTMLParser):
    """The elements of a page. An end tag closes what is open within its element; one that opens nothing is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", [], None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "p" and self.here.tag == "p" or tag == "li" and self.here.tag == "li":
            self.here = self.here.parent  # these end where the next begins
        node = _Node(tag, attrs, self.here)
        self.here.inside.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_endtag(self, tag: str) -> None:
        at = self.here
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.here = at.parent

    def handle_data(self, data: str) -> None:
        self.here.inside.append(data)


#: Elements that are never of an article, attributes that stay, and characters of a paragraph that count.
_ASIDE = SKIPPED | {"nav", "header", "footer", "aside", "form", "button", "iframe", "svg", "head"}
_KEPT_ATTRIBUTES = {"a": ("href",), "img": ("src", "alt")}
_LEAST_PARAGRAPH, _LEAST_ARTICLE = 25, 25


def _weights(node: _Node, score: dict[int, float], in_link: bool = False) -> tuple[int, int]:
    """Characters and those in links below a node. A paragraph gives its container its text, and the next one out half of it."""
    text = links = 0
    for x in node.inside:
        if isinstance(x, str):
            n = len(x.strip())
            text += n
            links += n * in_link
        elif x.tag not in _ASIDE:
            a, b = _weights(x, score, in_link or x.tag == "a")
            text += a
            links += b
            if x.tag in ("p", "pre", "blockquote", "li", "td") and a - b >= _LEAST_PARAGRAPH:
                score[id(node)] = score.get(id(node), 0.0) + a - b
                if node.parent is not None:
                    score[id(node.parent)] = score.get(id(node.parent), 0.0) + (a - b) / 2
    return text, links


def _written(node: _Node, out: list[str]) -> None:
    for x in node.inside:
        if isinstance(x, str):
            out.append(html.escape(x, quote=False))
        elif x.tag not in _ASIDE:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in x.attrs if k in _KEPT_ATTRIBUTES.get(x.tag, ()))
            out.append(f"<{x.tag}{kept}>")
            if x.tag not in _VOID:
                _written(x, out)
                out.append(f"</{x.tag}>")


def readable(body: str | None) -> str | None:
    """The article of a page as HTML: the element whose paragraphs hold most text outside of links; null if there is none.

    Navigation, headers, footers, side boxes, forms and scripts are left out; of the attributes links and images stay.
    """
    if body is None:
        return None
    tree = _Tree()
    tree.feed(body)
    tree.close()
    score: dict[int, float] = {}
    try:
        _weights(tree.root, score)
        best, open_ = None, [tree.root]
        while open_:
            node = open_.pop()
            if score.get(id(node), 0.0) > (score[id(best)] if best is not None else 0.0):
                best = node
            open_ += [x for x in reversed(node.inside) if isinstance(x, _Node)]
        if best is None or score[id(best)] < _LEAST_ARTICLE:
            return None
        out: list[str] = []
        _written(best, out)
    except RecursionError:  # nested beyond all measure: nothing to read
        return None
    return f"<article>{''.join(out).strip()}</article>"


def decoded(data: bytes | None, content_type: str | None) -> str | None:
    """Text of a body by the charset of its type, its own declaration, or UTF-8."""
    if data is None:
        return None
    m = re.search(r"charset=[\"']?([\w\-]+)", content_type or "", re.IGNORECASE) or re.search(r"<meta[^>]+charset=[\"']?([\w\-]+)", data[:1024].decode("latin-1"), re.IGNORECASE)
    try:
        return data.decode(m.group(1) if m else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


EXTRACTION = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("language", T.StringType()), T.StructField("local_links", T.IntegerType()), T.StructField("external_links", T.IntegerType())]
    + [T.StructField("links", T.ArrayType(T.StringType())), T.StructField("refuses_indexing", T.BooleanType()), T.StructField("refuses_following", T.BooleanType())]
)


def _text_udf(f: Callable[[str | None], str | None]):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def run(body: pd.Series) -> pd.Series:
        return body.map(f)

    return run


flatten = _text_udf(flattened)
to_markdown = _text_udf(markdown)
to_readable = _text_udf(readable)


@F.pandas_udf(EXTRACTION)
def extract(url: pd.Series, body: pd.Series) -> pd.DataFrame:
    empty = {"title": None, "language": None, "local_links": None, "external_links": None, "links": None, "refuses_indexing": None, "refuses_following": None}
    return pd.DataFrame([extracted(u, b) or empty for u, b in zip(url, body, strict=True)], columns=list(empty))


def page_of_text(title: Column, text: Column, language: Column) -> Column:
    """A page that shows a text: used where only texts are at hand."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    blocks = F.array_join(F.transform(F.split(esc(text), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return F.concat(F.lit('<html lang="'), F.coalesce(language, F.lit("")), F.lit('"><head><title>'), esc(title), F.lit("</title></head><body>"), blocks, F.lit("</body></html>"))
