"""Main text: what densities decide, and a plain recursive version on random trees."""

from __future__ import annotations

import random
from math import e, log

import pytest
from codeloom.llm import html_text
from codeloom.llm.html_text import extract_main_text, main_text

from .conftest import prose

A = "The first paragraph of the article has a fair number of words in it."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(20)) + "</ul>"
TEXT = [f"{A} Number {i}, and more of it follows here." for i in range(5)]
P = "".join(f"<p>{t}</p>" for t in TEXT)
SIDE = "".join(f"<p>Words beside the text that go on and on {i}, in whole sentences.</p>" for i in range(20))


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        (f'<div class="commentary">{P}</div>', TEXT),
        (f'<nav><a href=a>Home</a></nav><div class="post-reply">{P}</div><footer>foot text</footer>', TEXT),
        (f'<div>{P}</div><div class="sidebar">{SIDE}</div>', TEXT),
        (f"<article><h1>T</h1>{P}{LINKS}</article>", ["T", *TEXT]),
        (f"<div>{LINKS}</div><div><h2>Head</h2>{P}</div><div>{LINKS}</div>", ["Head", *TEXT]),
        (f"<form id=f><div>{P}</div><input><button>Go</button></form>", TEXT),
        (f"<form>User name <input> Password <input></form><div>{P}</div>", TEXT),
        (f"<article><h1>T</h1>{P}<div class=comments><article class=comment><p>{A}</p></article></div></article>", ["T", *TEXT]),
        (f'<div class="content-sidebar-wrap"><div class=x>{P}</div><div class=sidebar>{SIDE}</div></div>', TEXT),
        (f'<div class="related"><p>{A}</p></div><div>{P}</div>', TEXT),
        ("<nav><a href=a>x</a><a href=b>y</a></nav><article></article><div class=ad>Buy this now, it is good.</div><footer>c 2020</footer>", []),
        (f"<article>{P}<p><a href=a>one thing</a> | <a href=b>two things</a></p><p>See <a href=a>this</a>.</p></article>", [*TEXT, "See this."]),
        ("<article><h1>Title</h1><p>Short one.</p></article><div>" + LINKS + "</div>", ["Title", "Short one."]),
        (f"<div class=w><h1>A heading here</h1><div><p>{A}</p><p>{A}</p><p>Hi.</p></div></div>", ["A heading here", A, A, "Hi."]),
        (f"<article><section><p>{A}</p><p>{A}</p></section><section><p>Hi.</p></section></article>", [A, A, "Hi."]),
        ("<div>Menu</div><div>a b</div>", ["Menu", "a b"]),
        # an article in an element whose class or id means something else
        (f'<div class="login-guide">{P}</div>', TEXT),
        (f'<nav>{LINKS}</nav><main><section class="notices">{P}</section></main><footer>foot text</footer>', TEXT),
        (f'<div id="dinner-menu">{P}</div><div>Short block.</div>', TEXT),
        (f'<div id="dinner-menu">{P}<div class="ad"><p>{A}</p><p>{A}</p></div></div>', TEXT),
        # ... but not an advert, comments, or a notice beside some text
        (f'<article></article><div class="ad">{P}</div>', []),
        (f'<article></article><div class="cookie-notice">{P}</div><div class="comments">{P}</div>', []),
        (f'<div class="notice"><p>{A}</p><p>{A}</p></div><div>{P}</div>', TEXT),
        # references in the article
        (f"<article>{P}<p><a href=a>First paper of them</a> and <a href=b>second paper of them</a></p></article>", [*TEXT, "First paper of them and second paper of them"]),
        (f"<article>{P}<ul><li><a href=a>A long title of a paper</a></li><li><a href=b>Another one that is long</a></li></ul></article>", [*TEXT, "A long title of a paper", "Another one that is long"]),
        (f"<article>{P}<ul><li><a href=a>Share</a></li><li><a href=b>Print</a></li></ul></article>", TEXT),
        (f"<div>{P}</div><ul><li><a href=a>A long title of a page</a></li><li><a href=b>Another one that is long</a></li></ul>", TEXT),
        # headings go with their sections
        (f"<article><h1>T</h1>{P}<h2>Comments</h2><div class=comments><p>{A}</p></div></article>", ["T", *TEXT]),
        (f"<article><h1>T</h1><div class=share><a href=a>x</a></div>{P}<h2>Said</h2><section class=comments><h3>Bob</h3><p>{A}</p></section><h2>More</h2><p>{A}</p></article>", ["T", *TEXT, "More", A]),
        (f"<article><h1>T</h1><h2>Links</h2>{LINKS}<h2>Text</h2>{P}</article>", ["T", "Text", *TEXT]),
    ],
)
def test_density_decides(body, lines):
    assert main_text(page(body)) == "\n".join(lines)


def test_without_densities_menus_and_footers_stay(monkeypatch):
    """On a page without an article element the result is the densities' work, not the names'."""
    html = page(f'<nav>{LINKS}</nav><div class="ad">Buy this.</div><div>{P}</div>{LINKS}<footer>foot text</footer>')
    assert main_text(html) == "\n".join(TEXT)
    monkeypatch.setattr(html_text, "composite_density", lambda *_: 1.0)
    flat = main_text(html)
    assert "Link number 3" in flat and "Buy this." in flat and "foot text" in flat


def test_very_long_page(spark):
    paragraphs = [prose(i, 400) for i in range(700)]
    html = page(f"<div>{LINKS}</div><div>" + "".join(f"<p>{t}" for t in paragraphs) + "</div>")
    got = extract_main_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert got.text == "\n".join(paragraphs) and got.n_chars == len(got.text) > 1_000_000


class Node:
    def __init__(self, tag: str, children: list, hint: bool = False) -> None:
        self.tag, self.children, self.hint = tag, children, hint

    def html(self) -> str:
        attrs = ' class="sidebar"' if self.hint else " href=x" if self.tag == "a" else ""
        return f"<{self.tag}{attrs}>" + "".join(c if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag}>"

    def nodes(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.nodes()


def grow(rng: random.Random, depth: int) -> Node:
    kids: list = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if depth and kind < 0.45:
            kids.append(grow(rng, depth - 1))
        elif kind < 0.8:
            kids.append(Node("p", [prose(rng.randrange(10**6), rng.randint(1, 30))]))
        else:
            kids.append(Node("p", [Node("a", [prose(rng.randrange(10**6), rng.randint(1, 4))]) for _ in range(rng.randint(1, 3))]))
    return Node(rng.choice(["div", "section"]), kids, depth < 2 and rng.random() < 0.2)


def plain(body: Node) -> str:
    """The text of a tree by the formula, with counts taken afresh at every node."""

    def size(text: str) -> int:
        return len(text.replace(" ", ""))

    def counts(node: Node, noisy: bool, hinted: bool) -> tuple[int, int, int, int, int]:
        """Characters, noise, tags, noise tags, links below a node."""
        out = [0] * 5
        for c in node.children:
            if isinstance(c, str):
                out[0] += size(c)
                out[1] += size(c) * noisy
            else:
                h = hinted or c.hint
                got = counts(c, noisy or h or c.tag == "a", h)
                out = [x + y for x, y in zip(out, got, strict=True)]
                out[2] += 1
                out[3] += h or c.tag == "a"
                out[4] += c.tag == "a"
        return tuple(out)

    parent = {c: p for p in body.nodes() for c in p.children if isinstance(c, Node)}

    def chain(node: Node) -> list[Node]:
        return [node, *(chain(parent[node]) if node in parent else [])]

    of, density = {}, {}
    for x in body.nodes():
        hinted = any(y.hint for y in chain(x))
        of[x] = counts(x, hinted or any(y.tag == "a" for y in chain(x)), hinted)
    share = of[body][1] / of[body][0]
    for x, (c, nc, t, nt, _) in of.items():
        inner = c / max(1, nc) * max(1, t) / max(1, nt)
        density[x] = c / max(1, t) * log(inner) / log(log(c / max(1, c - nc) * max(1, nc) + share * c + e)) if inner > 1 else 0.0
    total = {x: sum(density[c] for c in x.children if isinstance(c, Node)) for x in of}

    def best(x: Node) -> Node:
        inner = [y for y in x.nodes() if total[y] == max(total[z] for z in x.nodes())]
        return x if x in inner else inner[0]

    top = best(body)
    threshold = min(density[x] for x in chain(top))
    marked = {y for x in of if x is body or density[x] >= threshold > 0 for y in best(x).nodes()}
    cut = set()
    for x in of:
        link_list = of[x][4] > 1 and 2 * of[x][1] > of[x][0] and x.tag != "a"
        if x is not body and (density[x] < threshold or not density[x]) and (x.hint or link_list):
            cut.update(x.nodes())
    if not any(isinstance(c, str) for x in marked - cut for c in x.children):
        marked, cut = set(of), {y for x in of if x.hint for y in x.nodes()}
    lines: list[list[str]] = [[]]

    def write(x: Node) -> None:
        block = x.tag != "a"
        lines.extend([[]] if block else [])
        for c in x.children:
            if isinstance(c, Node):
                write(c)
            elif x in marked and x not in cut:
                lines[-1].append(c)
        lines.extend([[]] if block else [])

    write(body)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in lines) if t)


def test_plain_version_agrees():
    rng = random.Random(21)
    kept = lost = 0
    for _ in range(400):
        body = grow(rng, 3)
        body.tag, body.hint = "body", False
        html = f"<html>{body.html()}</html>"
        expected = plain(body)
        assert main_text(html) == expected
        lost += len(expected) < sum(len(c) for x in body.nodes() for c in x.children if isinstance(c, str))
        kept += bool(expected)
    assert kept > 300 and lost > 100
