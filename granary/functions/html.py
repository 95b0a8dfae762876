"""One parse of a page: technical nodes dropped, links made absolute, the rest as Markdown.

Blocks are written as they end, each line behind the prefixes of the containers it lies in (list items, quotes); a container shows its mark once, then what continues it. White space in a
block becomes one blank, but for preformatted text. Emphasis that a block leaves open ends with the block. Inside table cells blocks run on in one line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import normalize_markdown

DROPPED = {"script", "style"}
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
# The relation of category links, and the line that stands for one.
CATEGORY, CATEGORY_LINE = "mw:PageProp/Category", "Category: {}"
BREAKS = {"p", "div", "section", "article", "nav", "footer", "header", "ul", "ol", "table", "blockquote", "figure", "figcaption", "main", "aside", "pre", "form", "fieldset", "details", "summary", "address", "dl", "dt", "dd", "caption"}
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
BLANKS = re.compile(r"[ \t\n\r\f]+")
BREAK = "\0"  # a line break inside a block; no text holds one


@dataclass
class Container:
    """A list item or a quote: what its first line begins with, and all others."""

    name: str
    first: str
    rest: str
    fresh: bool = True
    nested: bool = False  # a list item whose list begins in an item, or that is not its list's first


class Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.links, self.skip, self.in_head = url, [], 0, 0
        self.begin()

    def begin(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.heading = ""
        self.containers: list[Container] = []
        self.lists: list[list] = []  # kind, items so far, containers around it
        self.opened: list[list] = []  # links: address, place in inline, text so far
        self.emphasis: list[tuple[str, int]] = []  # tag, place in inline
        self.fence: str | None = None  # preformatted: its language
        self.code: int | None = None  # inline code: place in inline
        self.tables: list[list[list[str]]] = []  # rows of cells, innermost last
        self.cells: list[tuple] = []  # what a cell interrupts

    def absolute(self, value: str | None) -> str:
        try:
            return urljoin(self.url, value) if value else ""
        except ValueError:
            return value or ""

    # -- writing

    def take(self, at: int = 0) -> str:
        text = BLANKS.sub(" ", "".join(self.inline[at:]))
        del self.inline[at:]
        return text

    def flush(self) -> None:
        """Ends the block that is being written."""
        if self.fence is not None:
            return
        while self.emphasis:
            self.end_emphasis(self.emphasis[-1][0])
        if self.code is not None:
            self.end_code()
        for link in reversed(self.opened):  # a link over several blocks is one in each
            self.end_link(link)
        if self.cells:
            if self.inline:
                self.inline.append(" ")
            return
        text = re.sub(f" ?{BREAK} ?", BREAK, self.take()).strip(" " + BREAK)
        if text:
            mark, self.heading = self.heading, ""
            self.write([mark + text.replace(BREAK, " ")] if mark else text.replace(BREAK, "  \n").split("\n"))

    def write(self, lines: list[str]) -> None:
        if self.lines:
            going_on = []
            for c in self.containers:
                if c.fresh:
                    break
                going_on.append(c.rest)
            begins = next((c for c in self.containers if c.fresh), None)
            if not (begins and begins.nested):
                self.lines.append("".join(going_on).rstrip(" "))
        for line in lines:
            self.lines.append("".join(c.first if c.fresh else c.rest for c in self.containers) + line)
            for c in self.containers:
                c.fresh = False

    def close_to(self, depth: int) -> None:
        while len(self.containers) > depth:
            if self.containers[-1].fresh and self.containers[-1].name == "li":
                self.write([""])
                self.lines[-1] = self.lines[-1].rstrip(" ")
            self.containers.pop()

    def end_emphasis(self, tag: str) -> None:
        if tag not in [t for t, _ in self.emphasis]:
            return
        while True:
            last, at = self.emphasis.pop()
            text, mark = self.take(at), EMPHASIS[last]
            inner = text.strip(" " + BREAK)
            lead, trail = text[: len(text) - len(text.lstrip(" " + BREAK))], text[len(text.rstrip(" " + BREAK)) :]
            self.inline.append(f"{lead}{mark}{inner}{mark}{trail}" if inner else text)
            if last == tag:
                return

    def end_code(self) -> None:
        text, self.code = self.take(self.code), None
        mark = "`" * (1 + max([len(m) for m in re.findall("`+", text)], default=0))
        self.inline.append(f"{mark} {text} {mark}" if "`" in text else f"{mark}{text}{mark}" if text else "")

    def end_link(self, link: list) -> None:
        url, at, _ = link
        text = self.take(at)
        if text.strip(" "):
            link[2] += text
            self.inline.append(f"[{text}]({url})" if url else text)
        link[1] = 0 if not self.cells else len(self.inline)

    # -- tags

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        elif tag == "head":
            self.in_head = 1
        elif tag == "body":
            self.in_head, self.skip = 0, 0
            self.begin()
        if self.skip:
            return
        if tag == "link":
            if CATEGORY in (a.get("rel") or "") and a.get("href"):
                self.flush()
                self.inline.append(CATEGORY_LINE.format(a["href"]))
                self.flush()
        elif self.in_head:
            return
        elif tag in ("img", "source"):
            src, alt = self.absolute(a.get("src")), a.get("alt") or ""
            if tag == "img":
                self.inline.append(f"![{alt}]({src})")
            if src:
                self.links.append({"tag": tag, "url": src, "text": alt})
        elif self.fence is not None:
            if tag == "code" and not self.fence:
                self.fence = language(a)
            elif tag == "br":
                self.inline.append("\n")
        elif tag in HEADINGS:
            self.flush()
            self.heading = "" if self.cells else HEADINGS[tag] + " "
        elif tag in EMPHASIS:
            self.emphasis.append((tag, len(self.inline)))
        elif tag == "code":
            if self.code is None:
                self.code = len(self.inline)
        elif tag == "br":
            self.inline.append(" " if self.cells else BREAK)
        elif tag == "hr":
            self.flush()
            if not self.cells:
                self.write(["---"])
        elif tag == "a":
            self.opened.append([self.absolute(a.get("href")), len(self.inline), ""])
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif tag in ("tr", "td", "th") and self.tables:
            self.row_or_cell(tag)
        else:
            self.open_block(tag, a)

    def open_block(self, tag: str, a: dict) -> None:
        if tag == "li":
            self.flush()
            if self.cells:
                return
            if not self.lists:
                self.lists.append(["ul", 0, len(self.containers)])
            kind = self.lists[-1]
            self.close_to(kind[2])
            kind[1] += 1
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            nested = kind[1] > 1 or any(c.name == "li" for c in self.containers)
            self.containers.append(Container("li", mark, " " * len(mark), nested=nested))
        elif tag in BREAKS:
            self.flush()
            if self.cells:
                return
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0, len(self.containers)])
            elif tag == "blockquote":
                self.containers.append(Container(tag, "> ", "> "))
            elif tag == "pre":
                self.fence = language(a)

    def row_or_cell(self, tag: str | None) -> None:
        """Ends the open cell of the innermost table, then opens a row or a cell, or nothing."""
        rows = self.tables[-1]
        if self.cells and self.cells[-1][0] == len(self.tables):
            self.flush()
            _, inline, emphasis, opened, heading = self.cells.pop()
            rows[-1].append(self.take().strip(" ").replace(BREAK, " ").replace("|", "\\|"))
            self.inline, self.emphasis, self.opened, self.heading = inline, emphasis, opened, heading
        if tag == "tr" or (tag and not rows):
            rows.append([])
        if tag in ("td", "th"):
            self.cells.append((len(self.tables), self.inline, self.emphasis, self.opened, self.heading))
            self.inline, self.emphasis, self.opened, self.heading = [], [], [], ""

    def end_table(self) -> None:
        self.row_or_cell(None)
        rows = [r for r in self.tables.pop() if r]
        if self.cells:  # a table in a cell runs on in its line
            self.inline += [" ", " ".join(c for r in rows for c in r), " "]
        elif rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
            self.write([lines[0], "|" + " --- |" * width, *lines[1:]])

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "head":
            self.in_head = 0
        if self.skip or self.in_head:
            return
        if self.fence is not None:
            if tag == "pre":
                text, lang = "".join(self.inline), self.fence
                self.inline, self.fence = [], None
                mark = "`" * max(3, 1 + max([len(m) for m in re.findall("`+", text)], default=0))
                self.write([mark + lang, *text.removeprefix("\n").removesuffix("\n").split("\n"), mark])
        elif tag in EMPHASIS:
            self.end_emphasis(tag)
        elif tag == "code":
            if self.code is not None:
                self.end_code()
        elif tag == "a" and self.opened:
            self.end_link(link := self.opened[-1])
            self.opened.pop()
            if link[0]:
                self.links.append({"tag": "a", "url": link[0], "text": link[2].replace(BREAK, " ")})
        elif tag == "table" and self.tables:
            self.flush()
            self.end_table()
        elif tag in ("tr", "td", "th") and self.tables:
            self.row_or_cell(None)
        elif tag in ("ul", "ol") and self.lists and not self.cells:
            self.flush()
            self.close_to(self.lists.pop()[2])
        elif tag in ("li", "blockquote") and not self.cells:
            self.flush()
            depth = next((i for i in range(len(self.containers) - 1, -1, -1) if self.containers[i].name == tag), None)
            if depth is not None and (tag != "li" or not self.lists or depth >= self.lists[-1][2]):
                self.close_to(depth)
                while self.lists and self.lists[-1][2] > depth:
                    self.lists.pop()
        elif tag in HEADINGS or tag in BREAKS:
            self.flush()
            self.heading = ""

    def handle_data(self, data):
        if not self.skip and not self.in_head:
            self.inline.append(data.replace(BREAK, "") if self.fence is None else data)

    def text(self) -> str:
        """What was written, once the page has ended."""
        if self.fence is not None:
            self.handle_endtag("pre")
        while self.tables:
            self.end_table()
        self.flush()
        self.close_to(0)
        return "\n".join(self.lines)


def language(a: dict) -> str:
    """The language that a class like language-x names."""
    found = re.search(r"(?:^|\s)lang(?:uage)?-([\w+#-]+)", a.get("class") or "")
    return found[1] if found else ""


def convert(html: str | None, url: str | None) -> tuple[str, list[dict]]:
    page = Page(url or "")
    page.feed(html or "")
    page.close()
    return page.text(), page.links


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, markdown (normalised), links array<struct<tag, url, text>>: each page parsed once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [convert(h, u) for h, u in zip(b["html"], b["url"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "markdown": [x[0] for x in found], "links": [x[1] for x in found]})

    rows = pages.select("page_id", "url", "html").mapInPandas(scan, "page_id long, url string, markdown string, links array<struct<tag: string, url: string, text: string>>")
    return rows.withColumn("markdown", normalize_markdown(F.col("markdown")))
