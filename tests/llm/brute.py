"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import re

FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str | None) -> str:
    return (text or "").translate(FOLD)


def shingle_set(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = VISIBLE.findall(fold(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc id -> smallest id reachable over links."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    above = {i: i for i, _ in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                above[b] = a
    return {i: root(i) for i, _ in sets}


def windows(items: list[tuple[str, str | None]], size: int = 10) -> dict[tuple[str, ...], set[str]]:
    out: dict[tuple[str, ...], set[str]] = {}
    for name, text in items:
        w = ALNUM.findall(fold(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[i : i + n]), set()).add(name)
    return out


def hits(text: str | None, found: dict[tuple[str, ...], set[str]]) -> tuple[list[str], set[int], set[str]]:
    """Words, numbers of the hit ones, items."""
    w, hit, items = ALNUM.findall(fold(text)), set(), set()
    for n in {len(p) for p in found}:
        for i in range(len(w) - n + 1):
            own = found.get(tuple(w[i : i + n]))
            if own:
                hit.update(range(i, i + n))
                items |= own
    return w, hit, items
