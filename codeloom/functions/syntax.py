"""Just enough structure of source text for rules: literals, calls, blocks.

Python uses its own parser; JavaScript, TypeScript and Rust a scanner that knows comments,
strings and balanced brackets.  What does not balance is an error, so that a
broken file is reported and never taken for a clean one.
Offsets are characters here; ``byte_place`` gives lines and byte columns.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_OPEN, _CLOSE = "([{", ")]}"
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\s*(?:\.|::|\?\.)\s*[A-Za-z_$][\w$]*)*\s*!?\s*$")
_BRACKET = re.compile(r"[()\[\]{}]")
#: Where a comment or literal may begin.
_MARK, _RUST_MARK = re.compile(r"[/\"'`]"), re.compile(r"[/\"'br]")
_REGEX_BEFORE = set("(,=:[!&|?{};~^+-*%<>")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "match", "function", "fn", "with", "typeof", "await", "else", "in", "of", "new", "loop", "async"}


class SyntaxProblem(ValueError):
    """The source can't be analysed."""


@dataclass
class Syntax:
    literals: list[tuple[int, int]]  # comments and strings, in order
    nodes: list[tuple[int, int]]  # calls, unsafe blocks
    contexts: list[tuple[int, int]]  # functions, classes, blocks, calls
    functions: list[tuple[int, int, list[str]]]  # body and parameters, of the scanner's languages
    blanked: str | None = field(default=None, repr=False)

    def code(self, text: str) -> str:
        """The text with spaces for its comments and strings; made once."""
        if self.blanked is None:
            self.blanked = blank(text, self.literals)
        return self.blanked

    def in_literal(self, start: int, end: int) -> bool:
        i = bisect_right(self.literals, (start, 1 << 60)) - 1
        return i >= 0 and self.literals[i][0] <= start and end <= self.literals[i][1]


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces for the given spans, which do not overlap."""
    out, done = [], 0
    for a, b in spans:
        out += [text[done:a], " " * (b - a)]
        done = b
    return "".join([*out, text[done:]])


def byte_place(text: str, at: int) -> tuple[int, int]:
    """1-based line, and 1-based UTF-8 byte column, of a character."""
    line = text.count("\n", 0, at) + 1
    return line, len(text[text.rfind("\n", 0, at) + 1 : at].encode()) + 1


def parse(text: str, language: str) -> Syntax:
    return _python(text) if language == "python" else _scan(text, language)


def _python(text: str) -> Syntax:
    import io
    import tokenize

    try:
        tree = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        raise SyntaxProblem(str(e)) from e
    lines = text.splitlines(keepends=True)
    begin = [0]
    for x in lines:
        begin.append(begin[-1] + len(x))

    def at(line: int, column: int, in_bytes: bool) -> int:
        return begin[line - 1] + (len(lines[line - 1].encode()[:column].decode()) if in_bytes and line <= len(lines) else column)

    literals = sorted((at(*t.start, False), at(*t.end, False)) for t in tokens if t.type in (tokenize.STRING, tokenize.COMMENT))
    nodes, contexts = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.If | ast.With | ast.For | ast.While | ast.Try):
            span = (at(n.lineno, n.col_offset, True), at(n.end_lineno, n.end_col_offset, True))
            contexts.append(span)
            if isinstance(n, ast.Call):
                nodes.append(span)
    return Syntax(literals, sorted(nodes), sorted(contexts), [])


def _literals(text: str, language: str) -> list[tuple[int, int]]:
    out, i, n, last = [], 0, len(text), ""
    mark = _RUST_MARK if language == "rust" else _MARK
    while i < n:
        found = mark.search(text, i)
        plain = text[i : found.start() if found else n].rstrip()
        last = plain[-1] if plain else last
        if not found:
            break
        i = found.start()
        c, two = text[i], text[i : i + 2]
        start = i
        if two == "//":
            i = text.find("\n", i)
            i = n if i < 0 else i
        elif two == "/*":
            depth, i = 1, i + 2
            while depth and i < n:
                if text.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                elif language == "rust" and text.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                else:
                    i += 1
            if depth:
                raise SyntaxProblem("a comment has no end")
        elif language == "rust" and (m := re.match(r'b?r(#*)"', text[i : i + 40])):
            stop = text.find('"' + m[1], i + m.end())
            if stop < 0:
                raise SyntaxProblem("a string has no end")
            i = stop + 1 + len(m[1])
        elif c == '"' or c in "'`" and language != "rust" or c == "'" and re.match(r"'(?:\\[^\n]{1,8}?|[^\\'\n])'", text[i : i + 12]):
            i += 1
            while i < n and text[i] != c:
                if text[i] == "\n" and c != "`" and language != "rust":
                    raise SyntaxProblem("a string has no end")
                i += 2 if text[i] == "\\" else 1
            if i >= n:
                raise SyntaxProblem("a string has no end")
            i += 1
            if c == "`":  # templates hold code and are no literals here
                last = c
                continue
        elif c == "/" and language != "rust" and (not last or last in _REGEX_BEFORE) and (m := re.match(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/[a-z]*", text[i:])):
            i += m.end()
        else:
            if not c.isspace():
                last = c
            i += 1
            continue
        out.append((start, i))
        if two not in ("//", "/*"):
            last = '"'
    return out


def _scan(text: str, language: str) -> Syntax:
    literals = _literals(text, language)
    code = list(text)
    for a, b in literals:
        for i in range(a, b):
            if code[i] != "\n":
                code[i] = " "
    plain = "".join(code)
    stack, pair = [], {}
    for m in _BRACKET.finditer(plain):
        i, c = m.start(), m[0]
        if c in _OPEN:
            stack.append(i)
            if len(stack) > 256:
                raise SyntaxProblem("brackets are nested too deep")
        else:
            if not stack or _OPEN.index(plain[stack[-1]]) != _CLOSE.index(c):
                raise SyntaxProblem("brackets do not match")
            pair[stack.pop()] = i
    if stack:
        raise SyntaxProblem("brackets do not match")
    back = {b: a for a, b in pair.items()}
    nodes, contexts, functions = [], [], []
    for a, b in sorted(pair.items()):
        if plain[a] == "(":
            start = _chain_start(plain, a, back)
            if start < a:
                nodes.append((start, b + 1))
                contexts.append((start, b + 1))
        elif plain[a] == "{":
            head = max(plain.rfind(x, 0, a) for x in ";{}") + 1
            while head < a and plain[head].isspace():
                head += 1
            contexts.append((head, b + 1))
            contexts.append((a, b + 1))
            if re.search(r"\bunsafe\s*$", plain[:a]):
                nodes.append((plain.rindex("unsafe", 0, a), b + 1))
            params = _parameters(plain, head, a, back)
            if params is not None:
                functions.append((a, b + 1, params))
    return Syntax(literals, sorted(set(nodes)), sorted(set(contexts)), functions)


def _chain_start(plain: str, at: int, back: dict[int, int]) -> int:
    """Where the callee of the bracket at ``at`` begins, over members and earlier calls."""
    i = at
    while True:
        m = _NAME.search(plain, max(0, i - 200), i)
        if m and m.group().strip() not in _KEYWORDS:
            i = m.start()
        before = i
        while before > 0 and plain[before - 1].isspace():
            before -= 1
        if i == at and before > 0 and plain[before - 1] in ")]" and before - 1 in back:
            i = back[before - 1]
            continue
        if m and before > 0 and (plain[before - 1] == "." or plain[before - 2 : before] == "::"):
            before -= 1 if plain[before - 1] == "." else 2
            while before > 0 and plain[before - 1].isspace():
                before -= 1
            if before > 0 and plain[before - 1] in ")]" and before - 1 in back:
                at = i = back[before - 1]
                continue
        return i


def _parameters(plain: str, head: int, brace: int, back: dict[int, int]) -> list[str] | None:
    """Parameter names if the block at ``brace`` is a function's body."""
    text = plain[head:brace]
    close = brace - 1
    m = re.search(r"=>\s*$", text)
    if m:
        close = head + m.start() - 1
    while close > head and plain[close].isspace():
        close -= 1
    if plain[close] == ")" and close in back:
        inner = plain[back[close] + 1 : close]
        before = plain[head : back[close]]
        if not m and re.search(r"\b(?:if|for|while|switch|catch|with)\s*$", before):
            return None
        return re.findall(r"(?:^|,)\s*(?:\.\.\.)?\s*[{\[]?\s*([A-Za-z_$][\w$]*)", inner)
    if m and (one := re.search(r"([A-Za-z_$][\w$]*)\s*$", plain[head : close + 1])):
        return [one[1]]
    return None
