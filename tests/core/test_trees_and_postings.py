"""Hash trees and inverted indexes against plain versions, and how little of them is read."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from codeloom.operators import merkle, postings
from pyspark.sql import functions as F


def manifest(spark, rows):
    return spark.createDataFrame(rows, "key string, hash string")


def test_tree_names_what_differs(spark):
    rng = random.Random(1)
    before = {f"f{i}": f"h{rng.randint(0, 99)}" for i in range(6000)} | {None: "x", "": None}
    after = dict(before)
    for k in ("f3", "f77", None):
        after[k] = "other"
    del after["f500"]
    after["new"], after[""] = "n", ""
    a, b = (merkle.tree(manifest(spark, list(d.items())).repartition(5), "key", "hash", 2) for d in (before, after))
    got, opened = merkle.differences(a, b)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("f3", before["f3"], "other", "changed"), ("f77", before["f77"], "other", "changed"), (None, "x", "other", "changed"), ("", None, "", "changed"), ("f500", before["f500"], None, "removed"), ("new", None, "n", "added")]))
    assert opened < 1 + 16 + 6 * 16 + 1
    assert a.root() != b.root() and a.root() == merkle.tree(manifest(spark, list(before.items())[::-1]), "key", "hash", 2).root()
    same, opened = merkle.differences(a, a)
    assert same.collect() == [] and opened == 1
    with pytest.raises(ValueError):
        merkle.differences(a, merkle.tree(manifest(spark, [("a", "b")]), "key", "hash", 1))


def test_odd_trees(spark):
    none = merkle.tree(manifest(spark, []), "key", "hash")
    one = merkle.tree(manifest(spark, [("a", "1"), ("a", "1"), ("a", "2")]), "key", "hash")
    assert none.root() == "0" * 64 and none.depth == one.depth == 1
    assert sorted(tuple(r) for r in merkle.differences(none, one)[0].collect()) == [("a", None, "1", "added"), ("a", None, "2", "added")]
    # texts that a separator could mix up
    pairs = [[("a", "b\nc")], [("a\nb", "c")], [("a:b", "c")], [("a", "b:c")], [(None, "c")], [("", "c")], [("", None)], [("n", "c")]]
    assert len({merkle.identity(manifest(spark, p), "key", "hash") for p in pairs}) == len(pairs)
    assert [merkle.depth_for(n) for n in (0, 256, 4096, 4097, 65537)] == [1, 1, 1, 2, 3]


@pytest.mark.parametrize("k", [1, 5])
def test_search(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, rng.choices(vocabulary, weights=[1 / (n + 1) for n in range(400)], k=rng.randint(0, 60))) for i in range(-50, 900)]
    words = spark.createDataFrame([(i, w) for i, ws in docs for w in ws] + [(None, "w0"), (3, None)], "id long, term string")
    queries = {f"q{n}": set(rng.sample(vocabulary, 3)) | ({"nowhere"} if n % 3 else set()) for n in range(30)} | {"none": {"nowhere"}}
    rows = [(q, t) for q, ts in queries.items() for t in ts] + [("q0", t) for t in queries["q0"]] + [(None, "w1"), ("q1", None)]
    index = postings.build(words, F.floor(F.col("id") / 50))
    found, share = postings.top(index, spark.createDataFrame(rows, "query string, term string"), k)
    counts = {i: Counter(ws) for i, ws in docs}
    want = []
    for q, ts in queries.items():
        scores = sorted(((-sum(c[t] for t in ts), i) for i, c in counts.items()))
        want += [(q, i, -s, n) for n, (s, i) in enumerate((x for x in scores if x[0]), 1) if n <= k]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert 0 < share <= 1
    assert postings.top(index, spark.createDataFrame([], "query string, term string"), k)[0].collect() == []


def test_rare_terms_read_little(spark):
    """Most blocks lack a rare term, and those with few of it are ruled out."""
    words = spark.range(20000).select("id", F.lit("common").alias("term")).union(spark.range(20000).filter("id % 200 = 7").select("id", F.explode(F.array_repeat(F.lit("rare"), 3))))
    hot = spark.createDataFrame([(5000 + i, "rare") for i in range(5) for _ in range(40)], "id long, term string")
    index = postings.build(words.union(hot), F.floor(F.col("id") / 100))
    found, share = postings.top(index, spark.createDataFrame([("q", "rare")], "query string, term string"), 5)
    assert [r.id for r in found.orderBy("position").collect()] == [5000, 5001, 5002, 5003, 5004] and share < 0.1
