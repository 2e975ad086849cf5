"""Main text of HTML pages by composite text density.

Every page is parsed into a tree (no recursion, so depth is no limit).  For each
node with ``C`` characters, ``NC`` of them noise, ``T`` tags and ``NT`` noise
tags below it, the composite text density is

    C / T * log(C / NC * T / NT)  to the base  ln(C / (C - NC) * NC + NCb / Cb * C + e)

with ``NCb / Cb`` the share of noise in the body, and 1 in place of a 0.  Noise is what stands in links, so a
menu has hardly any density however its element is called.  A node's density
sum adds up its children's densities.  The node of the largest sum starts the main text;
the smallest density on its path to the body is the threshold.  Wherever a subtree
reaches the threshold, its own node of the largest sum belongs to the text too, and so do the
article element round the best node, and headings beside what belongs to it.  Within the
text, an element of mostly noise that stays below the threshold goes: lists of links, and hinted elements.

Inline formatting is not markup of the page's layout: such elements count as no
tags, and their children as children of what they stand in.

Plain sentences of an advert or a footer are as dense as the article's.  So an element's name, role, class or
id may *hint* that it is no article text; its characters and tags then count as noise, and the same densities decide.
Hints that are ambiguous (a reply may be the article of a forum) are dropped where the densest
subtree lies inside them.  So is the hint of a mere class or id (a guide to a login, a menu of dishes) if hardly any prose is left outside it and
it holds paragraphs of it; but never that of an element, a role, an advert, a consent, comments or what frames a page.  A paragraph of links with words between them, and a few long
links in a list of the article, are references and stay.  A heading goes with its section.  Nothing but what is never displayed (scripts, styles, form controls, hidden elements) is removed by name alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from math import e, log

import pyarrow as pa
from codeloom.llm.worker import small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|\Z)""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_LETTERS = re.compile(r"[^\W\d_]{2}")
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without displayed text, and form controls.
_DROP = frozenset("script style noscript template button select option textarea input iframe object svg canvas audio video map head title xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Names, roles, and words of a class or id, that hint at something other than article text.
_CERTAIN_TAGS = frozenset("nav aside footer menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_COMMENTS = frozenset("comment comments commenter commentlist commentform disqus replies respond".split())
_FIRM = _COMMENTS | frozenset("ad ads adbox adslot adunit adsense advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored cookie cookies cookiebar cookiebanner consent gdpr sidebar sidebars nav navbar navigation breadcrumb breadcrumbs pagination pager footer".split())
_CERTAIN = frozenset("notice notices alert banner masthead menu menus header login signup subscribe newsletter".split())
_UNCERTAIN = frozenset("reply responses reactions discussion popup modal overlay promo promotion share sharing social related recommended widget widgets toolbar copyright disclaimer search".split())
#: How many times the prose outside hinted elements one of them must have to be the article after all, in at least so many paragraphs of at least so many characters.
_MORE_PROSE, _PARAGRAPHS, _PARAGRAPH_CHARS = 8, 2, 40
#: References in a list: at most so many links, of at least so many words on average.
_REFERENCES, _REFERENCE_WORDS = 5, 3
#: Words beside which another word of a class names a layout.
_LAYOUT = frozenset("has with no without wrap wrapper layout".split())


class _Tree:
    """Nodes in document order as parallel lists; a parent comes before its children."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.drop, self.hint = ["#root"], [-1], [False], [0]
        self.events: list[tuple[int, str]] = []  # (node, text), or (node, "") at a block boundary
        self.stack = [0]
        self.open: Counter = Counter()
        self._parse(html)

    def _pop_to(self, tag: str) -> None:
        while len(self.stack) > 1:
            node = self.stack.pop()
            name = self.tag[node]
            self.open[name] -= 1
            if name in _BLOCK:
                self.events.append((node, ""))
            if name == tag:
                return

    def _start(self, tag: str, attrs: str) -> None:
        if tag in _BLOCK:
            if self.open["p"]:
                self._pop_to("p")
            self.events.append((self.stack[-1], ""))
        if tag in _CLOSES:
            names, limits = _CLOSES[tag]
            group = names.split()
            if any(self.open[x] for x in group):
                outer = None
                for node in reversed(self.stack):
                    name = self.tag[node]
                    if name in limits:
                        break
                    if name in group:
                        outer = name
                        if name == group[0]:
                            break
                if outer:
                    self._pop_to(outer)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        never, hint = self._hints(tag, attrs)
        self.drop.append(never)
        self.hint.append(hint)
        if tag in ("p", "article", "main", "h1") and self.open["form"]:
            for outer in self.stack:  # a form round prose is the page's frame
                if self.tag[outer] == "form":
                    self.hint[outer] = min(self.hint[outer], 1)
        if tag not in _VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def _hints(self, tag: str, attrs: str) -> tuple[bool, int]:
        """Whether an element is never displayed, and 3, 2 or 1 for a firm, certain or ambiguous hint."""
        never = tag in _DROP
        inner = self.open["article"] or self.open["main"]
        hint = 3 if tag in _CERTAIN_TAGS or tag == "form" or tag == "header" and not inner else 0
        if attrs and tag not in ("html", "body", "main"):
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    never = True
                elif name == "role":
                    hint = 3 if value.lower() in _ROLES else hint
                elif name in ("class", "id"):
                    for token in value.split():
                        hint = max(hint, _token_hint(token, tag == "article", bool(inner)))
        return never, hint

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            m = _TOKEN.match(html, lt) if lt >= 0 else None
            if lt < 0 or m is None:
                end = n if lt < 0 else lt + 1  # a bare < is text
                self.events.append((self.stack[-1], html[at:end]))
                at = end
                continue
            if lt > at:
                self.events.append((self.stack[-1], html[at:lt]))
            at = m.end()
            if m["cdata"]:
                self.events.append((self.stack[-1], m["cdata"].replace("&", "&amp;")))
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if m["close"]:
                if tag == "p" and not self.open["p"]:
                    self.events.append((self.stack[-1], ""))
                elif self.open[tag]:
                    self._pop_to(tag)
                continue
            attrs = m["attrs"]
            self._start(tag, attrs)
            if tag == "br":
                self.events.append((self.stack[-1], " "))
            if tag in _RAW_END and len(self.stack) > 1 and self.tag[self.stack[-1]] == tag:
                at = _RAW_END[tag].search(html, at).end()
                self._pop_to(tag)


@lru_cache(maxsize=4096)
def _token_hint(token: str, article: bool, inner: bool) -> int:
    """Hint of one class or id on an element that is, or stands in, an article."""
    words = {w.lower() for w in _HINT.findall(token)}
    if article:  # its class names parts of it; but reader comments are articles, too
        words &= _COMMENTS
    if inner:
        words.discard("header")  # the article's own
    if words & (_FIRM | _CERTAIN):
        return 1 if words & _LAYOUT else 3 if words & _FIRM else 2
    return 1 if words & _UNCERTAIN else 0


class _Counts:
    """Characters and tags below each node of a tree, without what is gone."""

    def __init__(self, tree: _Tree, gone: list[bool], texts: list[tuple[int, str]]) -> None:
        n = len(tree.tag)
        self.tree, self.gone = tree, gone
        self.own, self.words, self.beside = [0] * n, [0] * n, [0] * n
        for node, text in texts:
            self.own[node] += len(text) - text.count(" ")
            self.words[node] += text.count(" ") + 1
            if _LETTERS.search(text):  # a link's text is counted at the link
                self.beside[node] += tree.tag[node] != "a"
        self.chars, self.tags, self.links = self.own[:], [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = tree.parent[i]
                self.chars[p] += self.chars[i]
                self.words[p] += self.words[i]
                self.beside[p] += self.beside[i] if tree.tag[i] != "a" else 0
                self.tags[p] += self.tags[i] + (tree.tag[i] not in _INLINE)
                self.links[p] += self.links[i] + (tree.tag[i] == "a")


class _Densities:
    """Density and density sum of every node, for the given hints."""

    def __init__(self, counts: _Counts, hints: set[int]) -> None:
        tree, gone = counts.tree, counts.gone
        n = len(tree.tag)
        hinted, noisy = [False] * n, [False] * n
        for i in range(1, n):
            p = tree.parent[i]
            hinted[i] = hinted[p] or i in hints
            noisy[i] = noisy[p] or hinted[i] or tree.tag[i] == "a"
        noise = [c if x else 0 for c, x in zip(counts.own, noisy, strict=True)]
        noise_tags = [0] * n
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = tree.parent[i]
                noise[p] += noise[i]
                noise_tags[p] += noise_tags[i] + (tree.tag[i] == "a" or hinted[i] and tree.tag[i] not in _INLINE)
        self.noise = noise
        share = noise[0] / max(1, counts.chars[0])
        self.density, self.total = density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if i and tree.tag[i] in _INLINE:
                total[tree.parent[i]] += total[i]
                total[i] = 0.0
            elif counts.chars[i] and not gone[i]:
                density[i] = composite_density(counts.chars[i], noise[i], counts.tags[i], noise_tags[i], share)
                if i:
                    total[tree.parent[i]] += density[i]
        # the node of the largest sum in every subtree, the first on ties
        self.best = best = list(range(n))
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = tree.parent[i]
                if total[best[i]] > total[best[p]] or total[best[i]] == total[best[p]] and best[p] != p and best[i] < best[p]:
                    best[p] = best[i]


def composite_density(chars: int, noise: int, tags: int, noise_tags: int, share: float) -> float:
    """The formula of the module's docstring; 0 where the logarithm is not positive."""
    some, t = max(1, noise), max(1, tags)
    inner = chars / some * t / max(1, noise_tags)
    if not chars or inner <= 1:
        return 0.0
    return chars / t * log(inner) / log(log(chars / max(1, chars - noise) * some + share * chars + e))


def _way_up(tree: _Tree, node: int) -> set[int]:
    out = set()
    while node >= 0:
        out.add(node)
        node = tree.parent[node]
    return out


def _hinted_article(counts: _Counts, got: _Densities, body: int, certain: list[int]) -> int | None:
    """The element with a certain hint that holds the page's prose, if nearly all of it stands in one."""
    if not certain:
        return None
    tree = counts.tree
    left = counts.chars[body] - got.noise[body]
    firm = _Densities(counts, {i for i in range(1, len(tree.tag)) if tree.hint[i] == 3 and not counts.gone[i]})
    prose = {i: counts.chars[i] - firm.noise[i] for i in certain}
    most = max(certain, key=lambda i: (prose[i], -i))
    if prose[most] < _MORE_PROSE * max(left, 1):
        return None
    below = {most}
    paragraphs = 0
    for i in range(most + 1, len(tree.tag)):
        if tree.parent[i] not in below:
            if tree.parent[i] < most:
                break
            continue
        if tree.hint[i] == 3 or counts.gone[i]:
            continue
        below.add(i)
        paragraphs += tree.tag[i] == "p" and counts.chars[i] - firm.noise[i] >= _PARAGRAPH_CHARS
    return most if paragraphs >= _PARAGRAPHS else None


def _references(counts: _Counts, node: int) -> bool:
    """Whether a node of mostly links is a sentence of references or a short list of long ones, within an article or main element."""
    tree = counts.tree
    way = node
    while way > 0 and tree.tag[way] not in ("article", "main"):
        if tree.tag[way] in ("nav", "aside", "footer"):
            return False
        way = tree.parent[way]
    if way <= 0:
        return False
    if tree.tag[node] in ("p", "li"):
        return counts.beside[node] > 0  # words beside the links
    return tree.tag[node] in ("ul", "ol") and counts.links[node] <= _REFERENCES and counts.words[node] >= _REFERENCE_WORDS * counts.links[node]


def _measure(counts: _Counts, body: int) -> tuple[_Densities, set[int]]:
    """Densities, and the hints that hold."""
    tree = counts.tree
    shown = [i for i in range(1, len(tree.tag)) if tree.hint[i] and not counts.gone[i] and counts.chars[i]]
    hints = {i for i in shown if tree.hint[i] >= 2}
    got = _Densities(counts, hints)
    article = _hinted_article(counts, got, body, [i for i in shown if tree.hint[i] == 2])
    if article is not None:
        hints -= {i for i in _way_up(tree, article) if tree.hint[i] == 2}
        got = _Densities(counts, hints)
    if any(tree.hint[i] == 1 for i in shown):
        # an ambiguous hint does not hold where the densest subtree lies inside
        way = _way_up(tree, got.best[body])
        more = {i for i in shown if tree.hint[i] == 1 and i not in way}
        after = _Densities(counts, hints | more)
        if not after.total[after.best[body]]:  # nothing is left: nor does it on the way to the densest text
            node, way = got.best[body], set(way)
            children: dict[int, list[int]] = {}
            for i in range(1, len(tree.tag)):
                children.setdefault(tree.parent[i], []).append(i)
            while node in children:
                node = max(children[node], key=lambda i: got.density[i])
                way.add(node)
            more -= way
            after = _Densities(counts, hints | more)
        hints, got = hints | more, after
    return got, hints


def _cut_headings(counts: _Counts, body: int, cut: list[bool]) -> None:
    """Cut headings too, up to the next of their level, after which all is cut."""
    tree = counts.tree
    waiting: dict[int, list[int]] = {}  # by parent: headings whose section has only what is cut so far
    empty: dict[int, bool] = {}
    for i in range(body + 1, len(tree.tag)):
        if counts.gone[i] or not counts.chars[i] or tree.tag[i] in _INLINE:
            continue
        open_ = waiting.setdefault(tree.parent[i], [])
        if tree.tag[i] in _HEADINGS and not cut[i]:
            for h in [h for h in open_ if tree.tag[h] >= tree.tag[i]]:
                open_.remove(h)
            open_.append(i)
            empty[i] = False
        elif cut[i]:
            empty.update(dict.fromkeys(open_, True))
        else:
            for h in open_:
                empty.pop(h)
            open_.clear()
    gone = {h for h, with_cut in empty.items() if with_cut}
    for i in range(body + 1, len(tree.tag)):
        cut[i] = cut[i] or i in gone or cut[tree.parent[i]]


def main_text(html: str | None) -> str:
    """The article of a page: one line per block, white space within a block as one space."""
    if not html:
        return ""
    tree = _Tree(html)
    n = len(tree.tag)
    gone = [False] * n
    for i in range(1, n):
        gone[i] = tree.drop[i] or gone[tree.parent[i]]
    texts = []
    for node, raw in tree.events:
        if raw and not gone[node] and not raw.isspace():
            texts.append((node, " ".join((unescape(raw) if "&" in raw else raw).split())))
    if not texts:
        return ""
    counts = _Counts(tree, gone, texts)
    body = next((i for i in range(n) if tree.tag[i] == "body" and counts.chars[i]), 0)
    got, hints = _measure(counts, body)
    density, best = got.density, got.best
    top = best[body]
    threshold = min(density[i] for i in _way_up(tree, top) if i >= body)
    inside, marked, cut, above = [False] * n, [False] * n, [False] * n, [False] * n
    inside[body] = True
    frame = next((i for i in sorted(_way_up(tree, top), reverse=True) if i > body and tree.tag[i] in ("article", "main")), top)
    marked[frame] = True
    for i in range(body, n):
        p = tree.parent[i]
        if i > body:
            inside[i] = inside[p] and not gone[i]
        if inside[i]:
            if i == body or density[i] >= threshold > 0:
                marked[best[i]] = True  # itself if nothing below it has a sum
            marked[i] = marked[i] or i > 0 and marked[p]
            low = density[i] < threshold or not density[i]
            links = counts.links[i] > 1 and 2 * got.noise[i] > counts.chars[i] and tree.tag[i] not in _HEADINGS and tree.tag[i] not in _INLINE
            cut[i] = i > body and (cut[p] or low and (i in hints or links and not _references(counts, i)))
    for i in range(n - 1, body, -1):
        above[tree.parent[i]] = above[tree.parent[i]] or above[i] or marked[i]
    for i in range(body + 1, n):  # headings of what is marked, wherever they stand round it
        marked[i] = marked[i] or inside[i] and (marked[tree.parent[i]] or tree.tag[i] in _HEADINGS and above[tree.parent[i]])
    _cut_headings(counts, body, cut)
    show = [m and not c for m, c in zip(marked, cut, strict=True)]
    if not any(show[node] for node, _ in texts):  # no prose: what no hint names
        show = [False] * n
        for i in range(n):
            show[i] = not gone[i] and i not in hints and (i == 0 or show[tree.parent[i]])
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            lines.append(text)
        line.clear()

    for node, raw in tree.events:
        if raw == "":
            flush()
        elif show[node]:
            line.append(unescape(raw) if "&" in raw else raw)
    flush()
    return "\n".join(lines)


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A null or empty ``html``, or one without article text, gives the empty text
    and 0.  Null ids and urls are passed on; repeated rows give their row each.  Other columns are not read.
    An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
