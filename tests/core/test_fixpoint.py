"""Fixpoints, closures that are kept up to date and bounded sets against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from codeloom.operators import code_index, fixpoint, taint
from codeloom.operators.fixpoint import bounded_sets, closure, maintained, meets, shortest_steps
from pyspark.sql import functions as F


def plain_closure(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = set()
    for start in list(after):
        todo = list(after[start])
        while todo:
            b = todo.pop()
            if (start, b) not in out:
                out.add((start, b))
                todo += after.get(b, ())
    return out


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


@pytest.mark.parametrize("seed", range(6))
def test_closure_after_changes(spark, seed):
    """Cycles, self edges, edges that are not there or there already, and one both removed and added; changes follow each other."""
    rng = random.Random(seed)
    names = "abcdefghij"[: 5 + seed]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(len(names) + seed)}
    known = closure(pairs(spark, [*edges, *list(edges)[:2], (None, "a"), ("a", None)]))
    assert {tuple(r) for r in known.collect()} == plain_closure(edges)
    for _ in range(2):
        removed = set(rng.sample(sorted(edges), 2)) | {("z", "a")}
        added = {(rng.choice(names), rng.choice(names)) for _ in range(3)} | {("x", names[0]), next(iter(sorted(edges)))} | set(list(removed)[:1])
        known = maintained(known, pairs(spark, list(edges)), pairs(spark, list(removed)), pairs(spark, list(added)))
        edges = (edges - removed) | added
        got = [tuple(r) for r in known.collect()]
        assert len(got) == len(set(got)) and set(got) == plain_closure(edges)


def test_no_edges(spark):
    none = pairs(spark, [])
    assert closure(none).collect() == [] == maintained(none, none, none, none).collect()
    assert [tuple(r) for r in maintained(none, none, none, pairs(spark, [("a", "b")])).collect()] == [("a", "b")]
    assert maintained(closure(pairs(spark, [("a", "b")])), pairs(spark, [("a", "b")]), pairs(spark, [("a", "b")]), none).collect() == []


def test_rules_that_join_facts_with_facts(spark):
    """Ways double in length each round, so a chain of 60 needs seven rounds; a cycle ends; the shortest length wins."""
    chain = [(n, n + 1) for n in range(60)] + [(60, 57), (10, 30)]
    base = spark.createDataFrame([(a, b, 1) for a, b in chain], "src int, dst int, n int")
    rounds = []

    def rule(facts):
        rounds.append((facts.delta.count(), facts.every.count()))
        left = facts.map(lambda t: t.select("src", F.col("dst").alias("mid"), F.col("n").alias("m")))
        right = facts.map(lambda t: t.select(F.col("src").alias("mid"), "dst", "n"))
        parts = [a.join(b, "mid").select("src", "dst", (F.col("m") + F.col("n")).alias("n")) for a, b in meets(left, right)]
        return parts[0].union(parts[1])

    got, complete = fixpoint.fixpoint(base, rule, ["src", "dst"], "n")
    assert complete and len(rounds) <= 9
    after = defaultdict(list)
    for a, b in chain:
        after[a].append(b)
    for start in (0, 5, 58):
        want, todo = {}, [(b, 1) for b in after[start]]
        for b, n in todo:
            if b not in want:
                want[b] = n
                todo += [(c, n + 1) for c in after[b]]
        assert {r.dst: r.n for r in got.filter(F.col("src") == start).collect()} == want
    assert not fixpoint.fixpoint(base, rule, ["src", "dst"], "n", max_rounds=2)[1]


def test_steps_and_proofs(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    got = {r.node: (r.steps, r.via) for r in shortest_steps(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}


def test_bounded_sets(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(60)])) for _ in range(900)] + [("none", None)]
    got = {r.k: (r["values"], r.overflow) for r in bounded_sets(spark.createDataFrame(rows, "k string, v int").repartition(6), ["k"], "v", 32).collect()}
    sets = defaultdict(set)
    for k, v in rows:
        if v is not None:
            sets[k].add(v)
    assert got == {k: (sorted(v)[:32], len(v) > 32) for k, v in sets.items()}
    exact = bounded_sets(spark.createDataFrame([("a", v) for v in (1, 2, 2)], "k string, v int"), ["k"], "v", 2).first()
    assert (exact["values"], exact.overflow) == ([1, 2], False)


def test_paths_may_hold_any_sign(spark):
    """Paths and names with the signs that separate things elsewhere stay whole."""
    web = "from store import find\n\ndef view():\n    return find(input('a|b:c'))\n"
    store = "import sqlite3\n\ndef find(x):\n    return sqlite3.connect('x').cursor().execute('|' + x)\n"
    rows = [("p", "odd|dir:x/web.py", web), ("p", "odd|dir:x/store.py", store)]
    flows, complete = taint.trace(code_index.index_files(spark.createDataFrame(rows, "project string, path string, content string")))
    found = flows.collect()
    assert complete and [(r.source_path, r.source_line, r.source, r.sink_path, r.sink_line) for r in found] == [("odd|dir:x/web.py", 4, "input", "odd|dir:x/store.py", 4)]
    assert [(r.sources, r.overflow) for r in taint.sink_sources(flows).collect()] == [(["input"], False)]
