"""Prefix sums, spans, ranges, as-of joins and versioned tables against plain versions; large keys over many tasks."""

from __future__ import annotations

import random
import threading
from collections import defaultdict

import pytest
from codeloom.operators import compare, intervals, ledger, lexical, prefix, spans, state
from codeloom.storage import materialize
from jobs.common import settings
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(3))
def test_scan(spark, seed):
    """One key has most rows; nulls in keys and values."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([None, *range(-5, 9)])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    for keys, desc in ((["k"], False), ([], False), (["k"], True)):
        order = F.desc("o") if desc else F.col("o")
        kinds = ("sum", "max", "min", "last")
        got = prefix.scan(df, keys, [order], {kind: (kind, F.col("v")) for kind in kinds}).collect()
        want, known = {}, defaultdict(list)
        for k, o, v in sorted(rows, key=lambda r: -r[1] if desc else r[1]):
            seen = known[k if keys else 0]
            seen += [v] if v is not None else []
            want[o] = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
        assert {r.o: (r["sum"], r["max"], r["min"], r["last"]) for r in got} == want


def test_large_key_is_dealt(spark, monkeypatch):
    """A key with all rows is dealt evenly over parts, each of which has a window of its own."""
    written = []
    monkeypatch.setattr(prefix, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
    df = spark.range(200000).select(F.lit("one").alias("k"), ((F.col("id") * 7919) % 200003).alias("o"))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        found = prefix.ordinals(df, ["k"], [F.col("o")])
    assert tuple(found.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first()) == (1, 200000, 200000)
    assert found.join(found.select((F.col("ordinal") + 1).alias("ordinal"), F.col("o").alias("before")), "ordinal").filter("before >= o").isEmpty()
    sizes = [r["count"] for r in written[0][0].groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_users_of_scans(spark):
    rng = random.Random(1)
    before, after = ([(rng.choice("aaaabc"), i) for i in range(n)] for n in (70, 90))
    schema = "key string, row int"
    got = compare.bag_diff(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "key", "row").collect()
    for k in "abc":
        x, y = (sum(r[0] == k for r in rows) for rows in (before, after))
        own = sorted((r.ordinal, r.status) for r in got if r.key == k)
        assert own == [(n, "unchanged" if n <= min(x, y) else "resolved" if n <= x else "new") for n in range(1, max(x, y) + 1)]
    rows = [(i, rng.choice("gh"), rng.randint(0, 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, size int")
    for group in (None, "g"):
        used: dict = defaultdict(int)
        want = {}
        for i, g, n in rows:
            used[g if group else 0] += n
            want[i] = (used[g if group else 0], used[g if group else 0] <= 300)
        assert {r.id: (r.used, r.within) for r in lexical.running_budget(df, F.col("size"), ["id"], 300, group).collect()} == want
    marks = spark.createDataFrame([("g", 1, "b"), ("g", 2, "a"), ("g", 3, "b"), ("g", 4, "c"), ("h", 1, "a"), ("h", 2, "a")], "g string, n int, key string")
    assert sorted(tuple(r) for r in ledger.unsorted_rows(marks, "g", "n", "key").collect()) == [("g", 2, "a"), ("g", 3, "b"), ("h", 2, "a")]
    assert ledger.unsorted_rows(marks.filter("g = 'g'"), None, "n", "key").count() == 2


def span_rows(rng, n, wide):
    out = []
    for _ in range(n):
        start = rng.randint(0, 200)
        out.append((rng.choice(["x", "x", "x", "y", None]), rng.choice([start, start, start, None]) if rng.random() < 0.1 else start, start + rng.choice([0, 1, 5, wide])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans(spark, seed):
    """Empty spans, equal ends, nulls, repeated rows and a key with most spans."""
    rng = random.Random(seed)
    hits, others = span_rows(rng, 120, 30), span_rows(rng, 25, 60)
    hits += hits[:5]
    schema = "file string, start long, end long"
    a, b = spark.createDataFrame(hits, schema), spark.createDataFrame(others, schema)

    def plain(related):
        return [h for h in hits if any(None not in (*h, *o) and h[0] == o[0] and related(h, o) for o in others)]

    over = plain(lambda h, o: h[1] < o[2] and o[1] < h[2])
    within = plain(lambda h, o: o[1] <= h[1] and h[2] <= o[2])
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    for got, want in (
        (spans.overlapping(a, b, ["file"]), over),
        (spans.not_overlapping(a, b, ["file"]), [h for h in hits if h not in over]),
        (spans.inside(a, b, ["file"]), within),
        (spans.outside(a, b, ["file"]), [h for h in hits if h not in within]),
    ):
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_segments(spark):
    rng = random.Random(6)
    pairs = [(-7, 90), (0, 0), (5, 4), (3, 3), (-(1 << 40), 1 << 40), *((x := rng.randint(-300, 300), x + rng.randint(0, 500)) for _ in range(40))]
    rows = spark.createDataFrame(pairs, "s long, e long").select("s", "e", intervals.segments(F.col("s"), F.col("e")).alias("found")).collect()
    for s, e, found in rows:
        if s > e:
            assert found is None
            continue
        assert len({(x.level, x.number) for x in found}) == len(found) <= 2 * (e - s + 1).bit_length()
        parts = sorted(((x.number << x.level) - (1 << 61), ((x.number + 1) << x.level) - (1 << 61)) for x in found)
        assert parts[0][0] == s and parts[-1][1] == e + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("wide", [12, 2])
def test_narrowest(spark, monkeypatch, wide):
    monkeypatch.setattr(intervals, "WIDE_LEVEL", wide)
    rng = random.Random(2)
    ranges = [(rng.choice("ff g"), s := rng.randint(0, 400), s + rng.choice([0, 3, 50, 5000]), f"r{i:03}") for i in range(150)]
    ranges += [("f", 10, None, "none"), (None, 0, 9, "nokey"), ("f", 9, 3, "empty")]
    points = [(i, rng.choice(["f", "g", "h", None]), rng.choice([None, *range(450)])) for i in range(300)]
    got = spans.narrowest_enclosing(spark.createDataFrame(points, "id int, file string, line int"), spark.createDataFrame(ranges, "file string, start int, end int, name string"), ["file"], "line", "id", "name").collect()
    assert len(got) == len(points)
    for r in got:
        fit = [(e - s, n) for f, s, e, n in ranges if None not in (f, e, r.file, r.line) and f == r.file and s <= r.line <= e]
        assert r.range_name == min(fit, default=(None, None))[1]
    none = spans.narrowest_enclosing(spark.createDataFrame(points, "id int, file string, line int"), spark.createDataFrame([], "file string, start int, end int, name string"), ["file"], "line", "id", "name")
    assert {r.range_name for r in none.collect()} == {None}


def test_many_ranges_of_one_key(spark):
    """Ten thousand nested ranges and as many points of one key: the join makes at most one row per point and level."""
    ranges = spark.range(10000).select(F.lit("f").alias("file"), F.col("id").alias("start"), (F.lit(30000) - F.col("id")).alias("end"), F.col("id").alias("name"))
    points = spark.range(10000).select("id", F.lit("f").alias("file"), F.col("id").alias("line"))
    got = spans.narrowest_enclosing(points, ranges, ["file"], "line", "id", "name")
    assert got.filter("range_name <> line").count() == 0 and got.count() == 10000


def test_pieces_are_not_broadcast(spark, tmp_path):
    """Points and index are small tables in a file, but have a row a level or segment when they meet: neither goes through the driver."""
    spark.range(2000).select("id", F.lit("f").alias("file"), (F.col("id") * 7).alias("line"), F.col("id").alias("start"), (F.col("id") + 5000).alias("end")).write.parquet(str(tmp_path / "t"))
    both = spark.read.parquet(str(tmp_path / "t"))
    few = both.filter("id < 3")
    for points, ranges in ((both, both), (both, few), (few, both)):
        best = intervals.best_holding(points.select("id", "file", "line"), ranges.select("file", "start", "end"), ["file"], "line", "id", F.struct("start"))
        assert best.collect() and "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_asof(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(100)])) for i in range(200)]
    right = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(100)]), i) for i in range(80)]
    got = prefix.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u long, rev int"), ["k"], "t", "u", ["rev"], tie="rev").collect()
    assert {tuple(r)[:3] for r in got} == set(left) and len(got) == len(left)
    for r in got:
        fit = [(u, rev) for k, u, rev in right if None not in (r.k, r.t, u) and k == r.k and u <= r.t]
        assert r.rev == max(fit, default=(None, None))[1]


def test_two_writers(spark, tmp_path):
    """Both read the same version, and both have written their rows before either claims the next."""
    path = f"file://{tmp_path}/t"
    start = state.VersionedTable(spark, path)
    start.replace(spark.range(1), 0)
    for turn in range(1, 4):
        ready, done = threading.Barrier(2), []

        class Slow(state.VersionedTable):
            def _claim(self, version, folder, ready=ready):
                ready.wait()
                return super()._claim(version, folder)

        def write(n, turn=turn, done=done, table=Slow):
            try:
                done.append((table(spark, path).replace(spark.range(n), turn), n))
            except RuntimeError as e:
                done.append((str(e), n))

        threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        won = [n for v, n in done if v == turn + 1]
        assert len(won) == 1 and [v for v, n in done if n not in won] == [f"version {turn + 1} was written by somebody else"]
        assert start.version() == turn + 1 and start.read().count() == won[0]
    kept = {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")}
    assert kept == {f"v{v}" for v in range(1, 5)} | {start._folder(v) for v in range(1, 5)}
    assert start.forget_before(4) == 3 and start.forget_before(9) == 0
    assert start.read().count() in (5, 7)
    assert {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")} == {"v4", start._folder(4)}
    assert start.replace(spark.range(2), 4) == 5
