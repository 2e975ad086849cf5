"""Scalar functions on source text and paths."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(text: Column, limit: int | None = None) -> Column:
    """White space runs as one space, trimmed, and cut to ``limit`` characters."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def normalize_path(path: Column, prefix: str = "") -> Column:
    """Forward slashes, without ``./`` or the prefix in front."""
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out) if prefix else out


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def parent_scope(name: Column) -> Column:
    """What stands before the last dot; the empty text without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def line_at(text: Column, n: Column | int) -> Column:
    """Line ``n`` from 1; null beyond the last one."""
    return F.try_element_at(F.split(text, "\n"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def line_window(text: Column, n: Column, before: int, after: int, clip: int = 240) -> Column:
    """Lines ``n - before .. n + after``, each cut to ``clip`` characters."""
    lines = F.split(text, "\n")
    first = F.greatest(n - before, F.lit(1)).cast("int")
    length = F.greatest(F.least(n + after, F.size(lines)) - first + 1, F.lit(0)).cast("int")
    return F.transform(F.slice(lines, first, length), lambda x: F.substring(x, 1, clip))


def span_line(text: Column, start: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(text, F.lit(1), start.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def span_column(text: Column, start: Column) -> Column:
    """1-based UTF-8 byte column of a 0-based character offset."""
    return F.octet_length(F.substring_index(F.substring(text, F.lit(1), start.cast("int")), "\n", -1)) + 1


def language(path: Column) -> Column:
    """Language by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "py", "python").when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("js", "jsx"), "javascript").when(ext == "rs", "rust").when(ext == "go", "go")


def query_words(text: str) -> list[str]:
    """Distinct lower-case words of more than two bytes, in order."""
    out: list[str] = []
    word = ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        else:
            if len(word.encode()) > 2 and word not in out:
                out.append(word)
            word = ""
    return out


def escape_markdown(text: Column) -> Column:
    """Markdown and HTML signs made harmless, line breaks as spaces."""
    out = F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1")
    return F.replace(F.replace(F.regexp_replace(out, r"[\r\n]+", " "), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_controls(text: Column) -> Column:
    """Text safe for a terminal: control characters as a replacement sign."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", "�")


def file_uri(path: str) -> str:
    """A percent-encoded ``file://`` URI."""
    clean = path.replace("\\", "/")
    return "file://" + ("" if clean.startswith("/") else "/") + quote(clean, safe="/-._~:")


def portable_path(path: Column) -> Column:
    """Whether a path is relative, with forward slashes and without dot segments."""
    return path.rlike(r"^[^/\\:]+(?:/[^/\\:]+)*$") & ~path.rlike(r"(?:^|/)\.{1,2}(?:/|$)")


def is_hex(text: Column, *sizes: int) -> Column:
    return text.rlike("^(?:" + "|".join(f"[0-9a-f]{{{n}}}" for n in sizes) + ")$")


#: Fixed value: bytes of a target at most.
MAX_TARGET_BYTES = 512


def normalize_target(target: str, root: str = "") -> str:
    """What a user names: a symbol, a path or ``path:line``, with ``/`` and relative to ``root``; an error if it cannot be one of the project."""
    name = target.strip().replace("\\", "/")
    if not name or len(name.encode()) > MAX_TARGET_BYTES or any(ord(c) < 32 for c in name):
        raise ValueError(f"a target has 1 to {MAX_TARGET_BYTES} bytes and no control characters")
    base = root.rstrip("/")
    if base and (name == base or name.startswith(base + "/")):
        name = name[len(base) :].lstrip("/") or "."
    while name.startswith("./"):
        name = name[2:].lstrip("/")
    if name.startswith("/") or re.match(r"[A-Za-z]:/", name) or ".." in name.rsplit(":", 1)[0].split("/"):
        raise ValueError(f"{target} is outside the project")
    return name
