"""Factors of expressions, and many rules over whole texts against running every rule."""

from __future__ import annotations

import random
import re
import time

import pytest
from codeloom.operators.literals import RuleSet, factors, text_matches


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("secret", ["secret"]), ("a+bcd", ["bcd"]), ("abc?d", ["ab"]), ("abc*", ["ab"]), ("ab{2}cde", ["cde"]), ("x{0,3}yz", ["yz"]), (r"\bfoo\.bar\(", ["foo.bar("]), ("(?:ab|cd)e", ["ab", "cd"]), ("(?:abc)?xy", ["xy"]),
        ("key|token", ["key", "token"]), ("key|.", None), ("[abc]de[^]x]fgh", ["fgh"]), (r"[\]]ab", ["ab"]), ("(?i)abc", None), ("(?:(?i:a)bcd)", None), ("a.b", None), (r"\d+", None), ("(?=ab)..", None), ("(?P<n>abc)d", ["abc"]), (r"ab\ncd", ["ab\ncd"]), (r"ab\x41cd", None),
        ("^abc$", ["abc"]), ("(abc)+", ["abc"]), ("(abc){0}xy", ["xy"]), ("((a|b)cd|ef)", ["cd", "ef"]), ("", None), ("(?<!ab)cd", ["cd"]), ("a(?#note)bc", ["bc"]),
    ],
)
def test_factors(pattern, want):
    assert factors(pattern) == want


def test_every_match_has_a_factor():
    """Random expressions over few letters: what the automaton leaves out has no match."""
    rng = random.Random(11)

    def grow(depth):
        kind = rng.random()
        if not depth or kind < 0.5:
            out = rng.choice(["a", "b", "ab", "abc", r"\.", "[ab]", "[^a]", ".", r"\w", r"\b", "c"])
        elif kind < 0.8:
            out = "".join(grow(depth - 1) for _ in range(rng.randint(1, 4)))
        else:
            out = rng.choice(["(", "(?:"]) + "|".join(grow(depth - 1) for _ in range(rng.randint(1, 3))) + ")"
        return out + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,2}", "+?"] if out[-1] not in "?*+}" and not out.endswith(r"\b") else [""])

    helped = 0
    for _ in range(1500):
        pattern = "".join(grow(2) for _ in range(rng.randint(1, 4)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        found = factors(pattern)
        helped += found is not None
        for _ in range(20):
            text = "".join(rng.choice("abc. ") for _ in range(rng.randint(0, 12)))
            for m in compiled.finditer(text):
                assert found is None or not m[0] or any(f in m[0] for f in found), (pattern, found, m[0])
    assert helped > 300


RULES = [("one", r"secret\s+key", "high"), ("any", r"[xy]\d", "low"), ("lines", r"begin\n+end", "medium"), ("mail", r"\w+@\w+\.org|admin", "info"), ("empty", "z*", "low")]


def test_text_matches(spark):
    rng = random.Random(2)
    parts = ["secret ", "key", "\n", "begin\n\nend", "begin", "end", "x1", "y2", "é\U0001f600", "a@b.org", "admin", "zz", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(None, "secret key"), (7, None), (8, "")]
    got = text_matches(spark.createDataFrame(rows, "n long, t string").repartition(3), RULES, "n", "t").collect()
    want = []
    for i, t in rows:
        for name, pattern, severity in RULES:
            found = [m for m in re.finditer(pattern, t or "") if m[0]]
            want += [(name, severity, i, m.start(), t.count("\n", 0, m.start()) + 1, k, m[0]) for k, m in enumerate(found)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(r.rule_id == "lines" for r in got)
    assert text_matches(spark.createDataFrame(rows, "n long, t string"), [], "n", "t").collect() == []
    with pytest.raises(ValueError, match="bad"):
        text_matches(spark.createDataFrame(rows, "n long, t string"), [("bad", "(", "low")], "n", "t")


def test_a_thousand_rules():
    """They cost less than five times as much as three."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(30)]
    many = [(f"r{i}", rf"\bneedle{i}x\d+\s*=\s*\w+", "low") for i in range(997)]
    few = [(f"f{i}", rf"{words[i]}\s+{words[i + 1]}", "low") for i in range(3)]

    def seconds(rules):
        known = RuleSet(rules)
        began = time.perf_counter()
        found = [list(known.matches(t)) for t in texts]
        return time.perf_counter() - began, sum(map(len, found))

    (small, a), (large, b) = (min(seconds(rules) for _ in range(5)) for rules in (few, few + many))
    assert a == b and large < 5 * small
