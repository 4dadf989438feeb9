"""Web documents: a chain of regular expressions for flat pages, and a parser for the general case."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.blocks import Block, heading, item, paragraph, table
from pagemill.functions.texts import decoded

# The flat chain, in order. (pattern, replacement); both engines read these the same.
CHAIN: tuple[tuple[str, str], ...] = (
    (r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<head>.*?</head>", ""),
    (r"(?is)<h1[^>]*>", "\n# "),
    (r"(?is)</h1>", "\n\n"),
    (r"(?is)<br\s*/?>", "\n"),
    (r"(?is)<p[^>]*>", "\n\n"),
    (r"(?is)<[^>]+>", ""),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)

# Every space separator (Zs), as SQL's trim takes them.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def flat_markdown(html: Column) -> Column:
    """Markdown of a flat page; JVM-side, one projection."""
    for pattern, to in CHAIN:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(to.replace("\\", "\\\\").replace("$", "\\$")))
    return F.trim(html, F.lit(SPACES))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "&quot;", '"'), "&amp;", "&"), F.lit(SPACES))


_SKIP = {"script", "style", "nav", "footer", "head", "noscript", "template"}
_BREAK = {"p", "div", "article", "section", "main", "header", "aside", "figure", "blockquote", "ul", "ol", "dl", "dt", "dd", "form", "body", "html", "address", "figcaption"}


class _Pages(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.kind: tuple[str, int] = ("paragraph", 0)
        self.skip: list[str] = []
        self.lists = 0
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.link: str | None = None
        self.title = ""
        self.in_title = False

    def flush(self) -> None:
        text = "\n".join(" ".join(line.split()) for line in "".join(self.text).split("\n")).strip()
        self.text = []
        if not text:
            return
        kind, level = self.kind
        self.blocks.append(heading(text, level) if kind == "heading" else item(text, level) if kind == "item" else paragraph(text))
        self.kind = ("paragraph", 0)

    def end_cell(self) -> None:
        if self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1][-1] = "".join(self.cell)
        self.cell = None

    def put(self, s: str) -> None:
        (self.text if self.cell is None else self.cell).append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        elif self.skip or tag in _SKIP:
            if tag in _SKIP:
                self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind = ("heading", int(tag[1]))
        elif tag == "li":
            self.flush()
            self.kind = ("item", max(0, self.lists - 1))
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists += 1
        elif tag == "table":
            self.flush()
            self.tables.append([])
            self.cell = None
        elif tag == "tr" and self.tables:
            self.end_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.end_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
            self.tables[-1][-1].append("")
        elif tag == "br":
            self.put("\n")
        elif tag in ("b", "strong"):
            pass  # often left open; emphasis is not kept
        elif tag == "a":
            self.link = dict(attrs).get("href")
        elif tag == "img":
            if alt := dict(attrs).get("alt"):
                self.put(f"![{alt}]")
        elif tag in _BREAK and self.cell is None:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "table" and self.tables:
            self.end_cell()
            if rows := self.tables.pop():
                self.blocks.append(table(rows))
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = max(0, self.lists - 1)
        elif tag in _BREAK or tag == "li" or re.fullmatch("h[1-6]", tag):
            if self.cell is None:
                self.flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.put(data.replace("\n", " ").replace("\r", " ") if data.strip() else " ")


def html_blocks(content: bytes) -> list[Block]:
    """Headings, paragraphs, lists and tables; missing end tags and unknown tags do no harm."""
    text = decoded(content)
    stated = re.search(rb"(?i)charset\s*=\s*[\"']?([\w-]+)", content[:2048])
    if stated and not content.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        try:
            text = content.decode(stated[1].decode("ascii"))
        except (LookupError, UnicodeDecodeError):
            pass
    page = _Pages()
    page.feed(text)
    page.close()
    page.end_cell()
    page.flush()
    while page.tables:
        if rows := page.tables.pop():
            page.blocks.append(table(rows))
    title = " ".join(page.title.split())
    if title and not any(b.kind == "heading" for b in page.blocks):
        page.blocks.insert(0, heading(title))
    return page.blocks
