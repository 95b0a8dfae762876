"""Main text of pages by nearest-URL page differencing.

Every page is parsed to lines (blocks of text). Within each host every page is paired with the neighbour in path order that shares the longer
beginning of its path; all lines of both, menus and footers included, are aligned by longest common subsequence and shared lines are deleted.

Two rules stand around that. Differencing alone deletes an article that a mirror of the page repeats, so a shared line is left where it stands inside the page's own
article or main element; and a mirror (the same article lines, or all the same lines where neither has an article) tells nothing, so the
neighbours are the nearest pages on either side that are none. Differencing also leaves what a menu, footer or advert says on one page alone, so of the lines that
are not shared those in elements that name themselves as furniture go too (menus, headers, footers, sidebars, notices, adverts, forms, reader comments).
A form that wraps an article, or most of the page, is no furniture. Inside an article a paragraph, list item or table is text: only adverts and comments go by name there.
The rule is the same with and without a neighbour: what is neither shared nor furniture stays. n_by_difference_alone counts lines that no name would have deleted.

Text that a reader does not see as part of the article is not read: scripts, styles, templates, frames, drawings (svg, canvas), controls (select, textarea), and what stands in for scripts
(noscript). Formulas (math) and the text of an object are read.

Order comes from range partitions whose ends are passed on, so the pages of one host never meet in one task; what is aligned are hashes of lines.
Scanning is linear in the page: a tag or comment that never ends takes the rest of the page, as in browsers.

Defined results: null html or url counts as empty; no text gives an empty string; repeated rows are pages of their own (mirrors of each other); other columns of
the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from os.path import commonprefix
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import batch_of, materialize, row_ids

# Element and class names.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title", "canvas"}
FURNITURE = {"nav", "footer", "aside", "button", "dialog", "menu", "head"}
CONTAINERS = {"form", "div", "section", "article", "main", "header", "ul", "ol", "table", "figure", "details", "body", "p", "span", "li"} | FURNITURE
BLOCKS = {"form", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "section", "article", "main", "header", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary", "body", "html", "fieldset", "legend"} | FURNITURE
FURNITURE_WORDS = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "banner", "ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "share", "social", "comment", "comments", "disqus", "breadcrumb", "breadcrumbs", "related", "popup", "modal", "login", "search", "complementary", "contentinfo"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}

#: Inside an article these words say too little: an article has a header, related work, a search.
OUTSIDE_ONLY = {"header", "footer", "banner", "related", "search", "menu", "navigation", "nav", "modal", "login"}
CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "text", "body"}
#: Adverts and reader comments are that, whatever else a name says; unless it says that there are none, or some elsewhere.
ALWAYS_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "comment", "comments", "disqus"}
ABOUT_WORDS = {"no", "non", "free", "has", "with", "without", "is", "show", "hide", "enable", "enabled", "count"}
#: Inside an article these elements are text: of the words above only those that always hold speak against them.
TEXT = {"p", "li", "span", "table", "figure", "details"}

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
COMMENT_END = re.compile("--!?>")
VALUE_OR_END = re.compile(r"[>=]")
BLANKS = re.compile(r"[ \t\n\x0c\r]*")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


class Line(NamedTuple):
    text: str
    article: bool  # inside an article or main element
    furniture: bool  # inside an element that names itself as furniture


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element names itself as furniture; forms are told apart later, by what they hold."""
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("body", "html", "main"):
        return False
    tokens = [t for m in NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    parts = [set(re.split(r"[^a-z]+", t)) for t in tokens]
    if name == "article" or (in_article and name in TEXT):
        return any(p & ALWAYS_WORDS and not p & ABOUT_WORDS for p in (parts if name == "article" else [{t} for t in tokens]))
    if in_article:
        return any(t in FURNITURE_WORDS and t not in OUTSIDE_ONLY for t in tokens)
    return any(p & FURNITURE_WORDS and not p & ABOUT_WORDS and (p & ALWAYS_WORDS or not p & CONTENT_WORDS) for p in parts)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag and of each comment or declaration (no name), in order. The reader may send a place to go on from."""
    at = 0
    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", start):
                over = COMMENT_END.search(page, start + 2 if page.startswith(("<!-->", "<!--->"), start) else start + 4)
                end = over.end() if over else len(page)
            else:
                end = page.find(">", start) + 1 or len(page)
            sent = yield start, end, False, "", ""
            at = sent or end
            continue
        closing = follows == "/"
        name = NAME.match(page, start + 1 + closing)
        if closing and not name and start + 2 < len(page):  # </ with no name behind it is a comment to the next >
            end = page.find(">", start) + 1 or len(page)
            sent = yield start, end, False, "", ""
            at = sent or end
            continue
        if not name:
            at = start + 1
            continue
        end = name.end()
        while True:  # quotes count only where a value begins
            m = VALUE_OR_END.search(page, end)
            if not m:
                end = len(page)
                break
            end = m.end()
            if m[0] == ">":
                break
            end = BLANKS.match(page, end).end()
            quote = page[end : end + 1]
            if quote in ('"', "'"):
                end = page.find(quote, end + 1) + 1 or len(page)
        sent = yield start, end, closing, name[0].lower(), page[name.end() : end - 1]
        at = sent or end


def lines_of(page: str) -> list[Line]:
    """All lines of a page in order, but for scripts, styles and the like."""
    found: list[tuple[str, bool, bool, int]] = []  # text, article, furniture, number of the outermost form (0: none)
    parts: list[str] = []
    aside: list[str] = []  # furniture inside a line of text
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, article
    open_names: Counter[str] = Counter()
    furniture = articles = forms = form = inside = 0
    wraps: set[int] = set()  # forms that hold an article

    def flush() -> None:
        for pieces, named in ((parts, furniture > inside), (aside, True)):
            text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip(" ")
            pieces.clear()
            if text:
                found.append((text, articles > 0, named, form))

    def close() -> str:
        nonlocal furniture, articles, form, inside
        name, was_furniture, was_article = stack.pop()
        open_names[name] -= 1
        furniture, articles, inside = furniture - was_furniture, articles - was_article, inside - (was_furniture and name == "span")
        if name == "form" and not open_names["form"]:
            form = 0
        return name

    at, scan, go_on = 0, tags(page), None
    while True:
        try:
            start, end, closing, name, attributes = scan.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            (aside if inside else parts).append(page[at:start])
        at = end
        if name == "br":
            (aside if inside else parts).append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            if name in CONTAINERS and open_names[name]:
                while close() != name:
                    pass
        elif name in RAW:
            last = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = go_on = (page.find(">", last.end()) + 1 or len(page)) if last else len(page)
        elif name in CONTAINERS and name not in VOID and not attributes.endswith("/"):
            named = is_furniture(name, attributes, articles > 0)
            if name in ("p", "li", "span") and not named:
                continue
            if name == "body":  # whatever head left open is over
                while stack:
                    close()
            article = name in ("article", "main") and not named
            if name == "form":
                named = False
                if not form:
                    forms += 1
                    form = forms
            if article and not furniture:
                wraps.add(form)
            stack.append((name, named, article))
            open_names[name] += 1
            furniture, articles, inside = furniture + named, articles + article, inside + (named and name == "span")
    (aside if inside else parts).append(page[at:])
    flush()
    size = sum(len(t) for t, _, f, _ in found if not f)
    held: Counter[int] = Counter()
    for t, _, f, k in found:
        if k and not f:
            held[k] += len(t)
    plain = wraps | {k for k, n in held.items() if 2 * n > size} | {0}
    return [Line(t, a, f or k not in plain) for t, a, f, k in found]


#: Bits of alignment state kept for walking back; larger pairs are halved first.
KEPT_BITS = 1 << 26


def ends_of(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a: a number whose zero bits are the places in b at which the longest common subsequence grows (bit-parallel)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    state = full
    for x in a:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
        yield state


def lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of a with the first 0..len(b) lines of b."""
    state = (1 << len(b)) - 1
    for state in ends_of(a, b):
        pass
    bits = bin(state | 1 << len(b))[:2:-1]
    return list(accumulate((c == "0" for c in bits), initial=0))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence with b. Time len(a) * len(b) / word size at most, however often lines repeat; memory is bounded."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ours, theirs = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in theirs]
    left, right = [a[i] for i in at], [x for x in b[head : len(b) - tail] if x in ours]
    return [*range(head), *(at[i] for i in _aligned(left, right)), *range(len(a) - tail, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > KEPT_BITS:
        half = len(a) // 2
        before, after = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    states = list(ends_of(a, b))
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # the last growth at or before j; it belongs to this line if the state before did not have it there
        grown = ~states[i] & ((1 << j + 1) - 1)
        if not grown:
            break
        j = grown.bit_length() - 1
        if i == 0 or states[i - 1] >> j & 1:
            if a[i] == b[j]:
                out.append(i)
                j -= 1
                if j < 0:
                    break
    return out[::-1]


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def page_lines(pages: DataFrame) -> DataFrame:
    """row_id, host, path, same, lines array<long>: hashes of lines; same is equal for mirrors."""
    out = pa.schema([("row_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("same", pa.int64()), ("lines", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, same, lines = [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                try:
                    parts = urlsplit(url or "")
                    hosts.append(parts.netloc.lower())
                    paths.append(parts.path + "?" + parts.query)
                except ValueError:
                    hosts.append("")
                    paths.append(url)
                found = lines_of(page or "")
                inside = [x.text for x in found if x.article and not x.furniture]
                same.append(line_hash("\n\n".join(["article", *inside] if inside else ["page", *(x.text for x in found)])))
                lines.append([line_hash(x.text) for x in found])
            yield batch_of(out, batch.column("row_id"), hosts, paths, same, lines)

    read = pages.select(row_ids(pages).alias("row_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(scan, "row_id long, host string, path string, same long, lines array<long>")


def packed(found: list[Line]) -> bytes:
    """Lines as compressed bytes; a line has no line end, so one marks where the next begins."""
    return zlib.compress("\n".join(f"{x.article + 2 * x.furniture}{x.text}" for x in found).encode("utf-8", "replace"))


def unpacked(data: bytes) -> list[Line]:
    rows = zlib.decompress(data).decode("utf-8")
    return [Line(r[1:], bool(int(r[0]) & 1), int(r[0]) > 1) for r in rows.split("\n")] if rows else []


def beyond(ends: list[dict]) -> list[dict | None]:
    """For each of ends (first, last, other: the nearest row before the last that is no mirror of it), in order: the nearest row before them that is no mirror of the first."""
    key = lambda x: (x["host"], x["same"])
    out, last, other = [], None, None
    for e in ends:
        out.append(last if last and key(last) != key(e["first"]) else other)
        last, other = e["last"], e["other"] or (last if last and key(last) != key(e["last"]) else other)
    return out


def shared_lines(keys: DataFrame) -> DataFrame:
    """row_id, shared array<boolean>: for each line whether the page's nearest neighbour has it too, for pages with a neighbour. keys: row_id, host, path, same, lines as from page_lines."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "row_id"]
    parts = materialize(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "page-order")
    me = F.struct(*order, "same", "lines")
    run = F.struct("host", "same")

    def nearest(sort: list) -> Column:
        """The nearest row before, in this order, that is no mirror; null in the first run of a range partition."""
        within = Window.partitionBy("part").orderBy(*sort)
        starts = F.lag(run).over(within) != run
        return F.last(F.when(starts, F.lag(me).over(within)), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))

    rows = parts.withColumn("before", nearest(order)).withColumn("after", nearest([F.desc(c) for c in order]))
    # one row per range partition: what lies beyond each end
    ends = rows.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"), F.min_by("after", F.struct(*order)).alias("first_other"), F.max_by("before", F.struct(*order)).alias("last_other"))
    side = ends.schema["first"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["part"])
        left = beyond([{"first": r["first"], "last": r["last"], "other": r["last_other"]} for r in found])
        right = beyond([{"first": r["last"], "last": r["first"], "other": r["first_other"]} for r in reversed(found)])[::-1]
        if found:
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "left": a, "right": b} for r, a, b in zip(found, left, right)], schema=bounds)

    row = pa.struct([("host", pa.string()), ("path", pa.string()), ("row_id", pa.int64()), ("same", pa.int64()), ("lines", pa.list_(pa.int64()))])
    bounds = pa.schema([("part", pa.int32()), ("left", row), ("right", row)])
    ends = ends.repartition(1).mapInArrow(fold, f"part int, left {side}, right {side}")
    rows = rows.join(ends, "part").select("row_id", "host", "path", "lines", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
    out = pa.schema([("row_id", pa.int64()), ("shared", pa.list_(pa.bool_()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = [], []
            for r in batch.to_pylist():
                near = [x for x in (r["before"], r["after"]) if x and x["host"] == r["host"]]
                if near:
                    other = max(near, key=lambda x: len(commonprefix((x["path"], r["path"]))))
                    mask = [False] * len(r["lines"])
                    for i in common_lines(r["lines"], other["lines"]):
                        mask[i] = True
                    ids.append(r["row_id"])
                    shared.append(mask)
            yield batch_of(out, ids, shared)

    return rows.mapInArrow(align, "row_id long, shared array<boolean>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (lines in page order joined by an empty line), n_lines (all the page has), n_shared (deleted by differencing), n_by_difference_alone (of these, lines in no named
    element), n_named (deleted by name)."""
    keys = materialize(page_lines(pages).filter(F.size("lines") > 0), "page-lines")
    shared = materialize(shared_lines(keys), "shared-lines")
    blobs = pa.schema([("row_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("found", pa.binary())])
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in ("n_lines", "n_shared", "n_by_difference_alone", "n_named"))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(blobs, *(batch.column(c) for c in ("row_id", "page_id", "url")), [packed(lines_of(x or "")) for x in batch.column("html").to_pylist()])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, gone in zip(batch.column("found").to_pylist(), batch.column("shared").to_pylist()):
                found = unpacked(data)
                own = [x.article and not x.furniture for x in found]
                away = [g and not o for g, o in zip(gone or [False] * len(found), own)]
                left, deleted = [x.text for x, g in zip(found, away) if not g and not x.furniture], sum(away)
                alone = sum(g and not x.furniture for x, g in zip(found, away))
                rows.append(("\n\n".join(left), len(found), deleted, alone, len(found) - deleted - len(left)))
            yield batch_of(out, batch.column("page_id"), batch.column("url"), *(zip(*rows) if rows else [[]] * 5))

    read = pages.select(row_ids(pages).alias("row_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    lines = read.mapInArrow(parse, "row_id long, page_id long, url string, found binary")
    # a merge join at every size; lines move compressed
    rows = lines.join(shared.hint("merge"), "row_id", "left").select("page_id", "url", "found", "shared")
    return rows.mapInArrow(select, "page_id long, url string, text string, n_lines long, n_shared long, n_by_difference_alone long, n_named long")
