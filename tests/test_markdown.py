"""Markdown of pages, against hand-written results and an independent renderer of random block trees."""

import html
import random

import pytest

from granary.functions.html import convert

BASE = "https://h.org/d/p"
CASES = [
    ("<h2>Head <b>x</b></h2><p>One <b>two </b><a href='/x?y=1'>three</a><br>four</p>", "## Head **x**\n\nOne **two** [three](https://h.org/x?y=1)  \nfour"),
    ("<blockquote><p>q1</p><p>q2<br>more</p><ul><li>i1</li><li>i2</li></ul><blockquote>deep</blockquote></blockquote><p>after</p>", "> q1\n>\n> q2  \n> more\n>\n> - i1\n> - i2\n>\n> > deep\n\nafter"),
    ("<ul><li>a<li>b<ul><li>c<p>d</p></li></ul></li></ul><ol><li>x</ol>", "- a\n- b\n  - c\n\n    d\n\n1. x"),
    ("<ol><li>one</li><li>two<ol><li>n</li></ol>tail</li><li></li></ol>", "1. one\n2. two\n   1. n\n\n   tail\n3."),
    ("<pre><code class='x language-py'>def f():\n\n    return `1`\n</code></pre>", "```py\ndef f():\n\n    return `1`\n```"),
    ("<pre>a ```` b</pre><p>use <code>a  b</code>, <code>x`y</code></p>", "`````\na ```` b\n`````\n\nuse `a b`, `` x`y ``"),
    ("<ul><li><pre>raw\n  two</pre></li><li>z</li></ul>", "- ```\n  raw\n    two\n  ```\n- z"),
    ("<table><tr><th>A</th><th>B|</th></tr><tr><td><p>1</p><p>2</p></td><td><a href='/l'>l</a></td><td>x</td></tr></table>", "| A | B\\| |  |\n| --- | --- | --- |\n| 1 2 | [l](https://h.org/l) | x |"),
    ("<table><tr><td>one<table><tr><td>in</td><td>ner</td></tr></table></td></tr>", "| one in ner |\n| --- |"),
    ("<a href='/u'><h3>T</h3><p>body</p></a><p>x</p><hr>", "### [T](https://h.org/u)\n\n[body](https://h.org/u)\n\nx\n\n---"),
    ("<p><b>open<p>next</b> <i></i>x</p>", "**open**\n\nnext x"),
    ("<li>stray</li></ul></li>text </blockquote></td></table><p>end", "- stray\n\ntext\n\nend"),
    ("<pre>never closed\n x", "```\nnever closed\n x\n```"),
    ("<blockquote><pre>a\n\nb</pre></blockquote>", "> ```\n> a\n> \n> b\n> ```"),
    ("", ""),
]


@pytest.mark.parametrize("page, want", CASES)
def test_hand_pages(page, want):
    assert convert(page, BASE)[0] == want


def test_links_over_blocks_are_listed_once():
    assert convert("<a href='/u'><p>a</p><p>b <img src='i.png' alt='p'></p></a><a>none</a>", BASE)[1] == [{"tag": "img", "url": "https://h.org/d/i.png", "text": "p"}, {"tag": "a", "url": "https://h.org/u", "text": "ab ![p](https://h.org/d/i.png)"}]


def tree(r, depth=0):
    """A list of blocks: (kind, content)."""
    words = lambda: " ".join(r.choice(["alpha", "be<ta", "ga&mma", "delta"]) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(r.randint(1, 3)):
        kind = r.choice(["p", "p", "h3", "pre", "ul", "ol", "quote", "table"] if depth < 3 else ["p"])
        if kind in ("p", "h3"):
            out.append((kind, words()))
        elif kind == "pre":
            out.append((kind, [words(), "  " + words()]))
        elif kind == "table":
            width = r.randint(1, 3)
            out.append((kind, [[words() for _ in range(width)] for _ in range(r.randint(1, 3))]))
        elif kind == "quote":
            out.append((kind, tree(r, depth + 1)))
        else:
            out.append((kind, [[("p", words()), *(tree(r, depth + 1) if r.random() < 0.5 else [])] for _ in range(r.randint(1, 3))]))
    return out


def as_html(blocks):
    out = ""
    for kind, content in blocks:
        if kind in ("p", "h3"):
            out += f"<{kind}>\n {html.escape(content)} </{kind}>\n"
        elif kind == "pre":
            out += "<pre>" + html.escape("\n".join(content)) + "</pre>"
        elif kind == "table":
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td> " for c in row) + "</tr>\n" for row in content) + "</table>"
        elif kind == "quote":
            out += f"<blockquote>{as_html(content)}</blockquote>"
        else:
            out += f"<{kind}>" + "".join(f"<li>{as_html(item)}</li>" for item in content) + f"</{kind}>"
    return out


def rendered(blocks, in_item=False):
    lines = []
    for kind, content in blocks:
        if kind in ("p", "h3"):
            new = ["### " * (kind == "h3") + content]
        elif kind == "pre":
            new = ["```", *content, "```"]
        elif kind == "table":
            rows = ["| " + " | ".join(row) + " |" for row in content]
            new = [rows[0], "|" + " --- |" * len(content[0]), *rows[1:]]
        elif kind == "quote":
            new = [("> " + x) if x else ">" for x in rendered(content, in_item)]
        else:
            new = []
            for n, item in enumerate(content, 1):
                mark = f"{n}. " if kind == "ol" else "- "
                new += [(mark if not i else " " * len(mark) if x else "") + x for i, x in enumerate(rendered(item, True))]
        # lists inside list items follow without an empty line
        tight = in_item and kind in ("ul", "ol")
        lines += ([""] if lines and not tight else []) + new
    return lines


@pytest.mark.parametrize("seed", range(60))
def test_random_trees(seed):
    blocks = tree(random.Random(seed))
    assert convert(as_html(blocks), BASE)[0].split("\n") == rendered(blocks)
