"""Many regular expressions over whole texts: an expression runs only where a text has what it cannot match without.

Every expression is looked through for *factors*: literal strings of which each match has one.  One Aho-Corasick automaton over the factors of all expressions reads a text
once, and names the expressions that may match; expressions without factors run on every text.  Texts are not
split into lines, so a match may go over several.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
#: Factors of an expression at most, and characters of one at least; with more or shorter ones it runs on every text.
MOST_FACTORS, LEAST_CHARS = 16, 2
_CLASSES = frozenset("dDwWsSbBAZ")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


def _group(pattern: str, at: int) -> int:
    """Where the group or class that begins at ``at`` ends."""
    if pattern[at] == "[":
        end = at + 2 if pattern[at + 1 : at + 2] == "]" or pattern[at + 1 : at + 3] == "^]" else at + 1
        end += pattern[at + 1 : at + 3] == "^]"
        while pattern[end] != "]":
            end += 2 if pattern[end] == "\\" else 1
        return end + 1
    depth, end = 0, at
    while True:
        c = pattern[end]
        if c == "\\":
            end += 1
        elif c == "[":
            end = _group(pattern, end) - 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return end + 1
        end += 1


def _choices(pattern: str) -> list[str]:
    """The alternatives at the top of an expression."""
    out, start, at = [], 0, 0
    while at < len(pattern):
        if pattern[at] == "|":
            out.append(pattern[start:at])
            start = at = at + 1
        else:
            at = at + 2 if pattern[at] == "\\" else _group(pattern, at) if pattern[at] in "([" else at + 1
    return [*out, pattern[start:]]


def factors(pattern: str) -> list[str] | None:
    """Literals of which every match of ``pattern`` contains one; None if there are none that help."""
    if re.search(r"\(\?[a-zA-Z]*[ix]", pattern):
        return None  # letters in any case, or free white space
    choices = _choices(pattern)
    if len(choices) > 1:
        every = [factors(c) for c in choices]
        found = [f for fs in every for f in fs or []]
        return None if None in every or len(found) > MOST_FACTORS else found
    best: list[str] | None = None
    run, at = "", 0

    def done() -> None:
        nonlocal best, run
        if len(run) >= LEAST_CHARS and (best is None or len(run) > min(map(len, best))):
            best = [run]
        run = ""

    while at < len(pattern):
        c = pattern[at]
        literal, inner, end = None, None, at + 1
        if c == "\\":
            escaped = pattern[at + 1 : at + 2]
            end = at + 2
            if not escaped.isalnum():
                literal = escaped
            elif escaped in _ESCAPES:
                literal = _ESCAPES[escaped]
            elif escaped not in _CLASSES:
                return best  # a code, a reference: what follows is not looked at
        elif c in "([":
            end = _group(pattern, at)
            if c == "(":
                head = re.match(r"\((?:\?:|\?P<\w+>)?(?!\?)", pattern[at:end])
                inner = pattern[at + head.end() : end - 1] if head else None
        elif c not in ".^$":
            literal = c
        quantifier = re.match(r"(?:[*+?]|\{\d*(?:,\d*)?\})[?+]?", pattern[end:])
        if quantifier:
            optional = quantifier[0][0] in "*?" or re.match(r"\{0*[,}]", quantifier[0])
            if literal is not None and not optional:
                run += literal  # once for sure, and then who knows
            done()
            if inner is not None and not optional:
                found = factors(inner)
                if found and (best is None or min(map(len, found)) > min(map(len, best))):
                    best = found
            at = end + quantifier.end()
            continue
        if literal is not None:
            run += literal
        elif not (c == "\\" and pattern[at + 1] in "bBAZ" or c in "^$"):  # these have no characters
            done()
            if inner is not None:
                found = factors(inner)
                if found and (best is None or min(map(len, found)) > min(map(len, best))):
                    best = found
        at = end
    done()
    return best


class RuleSet:
    """Compiled rules and the automaton of their factors."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = [(name, re.compile(pattern), severity) for name, pattern, severity in rules]
        self.always: list[int] = []
        of: dict[str, list[int]] = {}
        for n, (_, pattern, _) in enumerate(rules):
            found = factors(pattern)
            if found is None:
                self.always.append(n)
            for f in found or []:
                of.setdefault(f, []).append(n)
        self.automaton = ahocorasick.Automaton()
        for f, owners in of.items():
            self.automaton.add_word(f, tuple(owners))
        if of:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules that may match, in order."""
        found = set(self.always)
        if len(self.automaton):
            for _, owners in self.automaton.iter(text):
                found.update(owners)
        return sorted(found)

    def matches(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """Rule, place, number and text of every match that is not empty, rule by rule."""
        for n in self.candidates(text):
            kept = (m for m in self.rules[n][1].finditer(text) if m.end() > m.start())
            for ordinal, m in enumerate(kept):
                yield n, m.start(), ordinal, m[0]


def _batches(rules: Sequence[Rule]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RuleSet(rules)
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                lines = [0, 1]  # how far lines are counted, and the line there
                for n, start, ordinal, match in known.matches(text or ""):
                    if start < lines[0]:
                        lines = [0, 1]
                    lines = [start, lines[1] + text.count("\n", lines[0], start)]
                    rows.append((k, n, start, lines[1], ordinal, match))
            at, rule, *rest = zip(*rows, strict=True) if rows else ([],) * 6
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            columns = [pa.array([known.rules[n][0] for n in rule], pa.string()), pa.array([known.rules[n][2] for n in rule], pa.string()), ids]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["rule_id", "severity", "id", "start", "line", "ordinal", "match"])

    return run


def text_matches(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame:
    """All matches of ``rules`` (name, expression, severity) in whole texts: ``rule_id, severity, id, start, line, ordinal, match``.

    ``start`` counts characters from 0, ``line`` from 1, ``ordinal`` the rule's matches in the text from 0.  A null text has no match; an empty match is none.
    """
    for name, pattern, _ in rules:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{name}: {e}") from e
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_batches(list(rules)), f"rule_id string, severity string, id {kind}, start long, line long, ordinal long, match string")
