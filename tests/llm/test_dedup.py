"""Exact and near deduplication against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from codeloom.llm import near_dedup, skew
from codeloom.llm.components import components
from codeloom.llm.exact_dedup import exact_duplicates, keep_one_per_text
from codeloom.llm.near_dedup import keep_one_per_class, near_duplicates
from codeloom.llm.sketch import EMPTY, miss_probability, sketches

from .brute import fold, near_classes, shingle_set
from .conftest import prose


def test_exact_groups(spark, odd_docs, odd_rows, no_docs):
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[fold(t)].append(i)
    got = exact_duplicates(odd_docs, salts=2).collect()
    assert len(got) == len(odd_rows)
    by_text = {hashlib.sha256(k.encode()).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_text[r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)
    kept = keep_one_per_text(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in by_text.values())
    assert exact_duplicates(no_docs).collect() == [] == keep_one_per_text(no_docs).collect()


def test_hot_group_joins_by_broadcast(spark):
    rows = [(i, "same text" if i % 3 else f"text {i // 6}") for i in range(3000)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[t] += 1
    assert {r.doc_id: r.group_size for r in got} == {i: sizes[t] for i, t in rows}


def test_equal_digests_do_not_merge_texts(spark, monkeypatch):
    """With digests that say nothing, the texts alone tell groups apart."""
    from codeloom.llm import exact_dedup
    from pyspark.sql import functions as F

    class Blind:
        def __getattr__(self, name):
            return getattr(F, name)

        def sha2(self, col, bits):
            return F.when(F.length(col) > 3, F.lit("a")).otherwise(F.lit("b"))

        def xxhash64(self, *cols):
            return F.lit(7).cast("long")

    rows = [(i, t) for i, t in enumerate(["same", "SAME", "other", "other", "third", "x", "X", None, ""] * 3)] + [(50, "alone")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(exact_dedup, "F", Blind())
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(table, salts=2).collect()}
    kept = sorted(r.doc_id for r in keep_one_per_text(table, salts=2).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    assert got == {i: (max(groups[fold(t)]), len(groups[fold(t)])) for i, t in rows}
    assert kept == sorted(max(v) for v in groups.values())


def test_keep_one_keeps_columns_that_clash(spark):
    rows = [(1, "a", "x", 1), (2, "a", "y", 2), (2, "a", "z", 3), (3, "b", None, 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __keep string, __sha int")
    kept = keep_one_per_text(table)
    assert kept.columns == table.columns
    got = sorted(map(tuple, kept.collect()))
    assert len(got) == 2 and got[0] in rows[1:3] and got[1] == rows[3]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for common in (0, 100, 200, 300, 390):
        other = np.concatenate([base[:common], rng.integers(0, 1 << 63, 400 - common).astype(np.uint64)])
        agree = []
        for _ in range(8):
            seed = np.uint64(rng.integers(1, 1 << 62)) | np.uint64(1)
            s = sketches(np.concatenate([base * seed, other * seed]), np.array([0, 400, 800]))
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - common / (800 - common)) < 0.05
    small = sketches(np.array([5, 9], dtype=np.uint64), np.array([0, 1, 1, 2]))
    assert (small[0] != EMPTY).all() and (small[1] == EMPTY).all()
    assert miss_probability(0.75, 32, 4) < 6e-6


def test_components_are_exact(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    above = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            above[hi] = lo
    got = {r.v: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in above}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_classes(spark, odd_docs, odd_rows, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    rows = [(i, t) for i, t in odd_rows if i is not None]
    expected = near_classes(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    sizes = {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)
    kept = keep_one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, c in expected.items() if c == i}
    assert near_duplicates(no_docs).collect() == []


def drifting_rows():
    """Edits that drift away from a base: many members are not similar to the centre."""
    rng = random.Random(11)
    rows, base = [], prose(4, 120).split()
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    chain = prose(9, 100).split()
    for i in range(30):
        chain = chain[2:] + [f"c{i}", f"d{i}"]
        rows.append((1000 - i, " ".join(chain)))
    return rows


@pytest.mark.parametrize(("block", "most_rows", "least_hot"), [(64, near_dedup.MOST_ROWS, skew.LEAST_HOT), (64, 0, skew.LEAST_HOT), (16, near_dedup.MOST_ROWS, 4)])
def test_near_classes_of_chains_and_large_groups(spark, monkeypatch, block, most_rows, least_hot):
    """Whole, split and hot buckets give the same classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MOST_ROWS", most_rows)
    monkeypatch.setattr(skew, "LEAST_HOT", least_hot)
    rows = drifting_rows()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == near_classes(rows)


def test_rows_that_share_an_id_are_classed_by_their_text(spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (1, b), (2, f"{a} tail"), (3, f"{b} tail"), (5, f"{a} end"), (5, c), (7, c), (8, a)]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, digest int").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 5, True), (7, 5, False), (8, 1, False)])
    kept = keep_one_per_class(table)
    assert kept.columns == table.columns
    assert sorted(r.digest for r in kept.collect()) == [0, 1, 5]


def test_large_buckets_make_linear_rows(spark):
    """A hundred thousand members, most on one centre; and members of as many centres, which are split."""
    job = near_dedup._Job(spark.createDataFrame([], "doc_id long, text string"), 5, 75)
    n = 100_000
    rows = spark.range(n).selectExpr("1L as key", "id as rep", "100L as size", "if(id % 500 = 3, id, -1L) as label")
    plan = job.mixed(rows).first()
    assert (plan.n, plan.others, plan.minors, plan.majors) == (n, 200, 1, 195)
    assert plan.cost <= 2 * n
    reps = spark.range(n).selectExpr("id as rep", "cast('' as binary) as sketch")
    dealt = job.tasks(rows.join(job.mixed(rows), "key").selectExpr("*", "key as band", "-1 as coord", "cast(null as binary) as mask"), reps)
    assert dealt.count() == plan.cost
    most = dealt.groupBy("key", "x", "y").count().agg({"count": "max"}).first()[0]
    assert most < 3 * near_dedup.BLOCK
    spread = job.mixed(rows.withColumn("label", rows["rep"])).first()
    assert spread.cost > near_dedup.MOST_ROWS * n  # so it is split into PREFIX rows a member
    # memory is bounded by shingles, too
    long = job.mixed(rows.filter("rep < 600").selectExpr("key", "rep", "1000000L as size", "rep as label")).first()
    assert long.minors >= 600 / 3


def test_prefixes_meet():
    """Two sketches that agree often enough share a coordinate of their prefixes, whatever the centre."""
    rng = np.random.default_rng(8)
    for trial in range(200):
        centre = rng.integers(0, 4, (1, 128)).astype("<u2")
        x, y = (np.where(rng.random((1, 128)) < rng.random(), centre, rng.integers(0, 1 << 16, (1, 128))).astype("<u2") for _ in range(2))
        same = rng.permutation(128)[: near_dedup.LEAST_AGREEMENT]
        y[0, same] = x[0, same]
        p, q = near_dedup.prefixes(x, centre)[0], near_dedup.prefixes(y, centre)[0]
        assert p.sum() == q.sum() == near_dedup.PREFIX
        assert (p & q & (x[0] == y[0])).any()


def test_skew_join_agrees(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(400)] + [(3, i) for i in range(300)], "k long, i int")
    table = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "k long, t string")
    for how in ("inner", "left", "left_semi"):
        plain = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, skew.skew_join(rows, table, "k", [3, 6], how).collect())) == plain


def test_hot_components(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    links = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(50, 120) if i != 100] + [(300, 301)]
    got = {r.v: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: 300 if v >= 300 else 0 for pair in links for v in pair}
