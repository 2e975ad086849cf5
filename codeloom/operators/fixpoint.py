"""Rules over tables until nothing new follows, each round from what the round before found.

``fixpoint`` keeps one fact per key, with its best value (a proof, a distance).  A rule gets the facts as ``Facts``: those of the last round
(``delta``), those before (``old``) and all (``every``).  A rule that joins facts with facts takes ``meets``, which has the last round's on one side of each join, so
that a round joins nothing that it joined before.  Rounds end by the facts: a fact that is no better than the known one is not a new
fact, so cycles end by themselves.  Facts are written round by round, which cuts the lineage.

``maintained`` keeps a transitive closure up to date: of removed edges it deletes what may have followed and derives again what still does, of
added ones it derives what is new; pairs that no changed edge touches are only read. Pairs lie in buckets of their
end and edges in buckets of their start, so a round shuffles the pairs it finds and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from codeloom.storage import Buckets, bucketed, joins_by_one_key, materialize, remove
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facts:
    """Facts of the last round, of those before it, and all."""

    delta: DataFrame
    old: DataFrame
    every: DataFrame

    def only(self, condition: str | Column) -> Facts:
        return Facts(self.delta.filter(condition), self.old.filter(condition), self.every.filter(condition))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Facts:
        return Facts(change(self.delta), change(self.old), change(self.every))


def meets(*facts: Facts) -> list[tuple[DataFrame, ...]]:
    """Every combination of one table per position that has a fact of the last round at some position, each combination of facts once."""
    return [tuple(f.old if k < at else f.delta if k == at else f.every for k, f in enumerate(facts)) for at in range(len(facts))]


def _same(keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def fixpoint(base: DataFrame, rule: Callable[[Facts], DataFrame], keys: Sequence[str], value: str, rank: Callable[[Column], Column] = lambda v: v, max_rounds: int = 1000) -> tuple[DataFrame, bool]:
    """``keys, value`` of all facts that follow from ``base``, and whether the rounds ended by themselves.

    Of several values of a key the smallest counts.  One that comes in a later round replaces the known one, and is a new fact, if its ``rank`` is smaller.
    A null key is a key.  Without base facts there are none.
    """
    spark = base.sparkSession

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(value).alias(value))

    first, path = materialize(best(base.select(*keys, value)), "facts")
    paths, complete = [path], first.isEmpty()
    for _ in range(0 if complete else max_rounds):
        facts = Facts(*[spark.read.schema(first.schema).parquet(*p) if p else first.limit(0) for p in (paths[-1:], paths[:-1], paths)])
        found, made = materialize(best(rule(facts).select(*keys, value)), "candidates")
        # known facts are read, but only those that a candidate may replace are shuffled
        asked = found.select(*[F.col(k).alias(f"__{k}") for k in keys])
        known = best(facts.every.join(asked, _same(keys, "__"), "left_semi")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"))
        fresh = found.join(known, _same(keys, "__"), "left").filter(F.col("__value").isNull() | (rank(F.col(value)) < rank(F.col("__value"))))
        fresh, path = materialize(fresh.select(*keys, value), "facts")
        remove(spark, made)
        if fresh.isEmpty():
            remove(spark, path)
            complete = True
            break
        paths.append(path)
    return best(spark.read.schema(first.schema).parquet(*paths)), complete


class FurtherError(RuntimeError):
    """Something is further than the given number of steps."""


def shortest_steps(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node, steps, via`` of what ``edges(src, dst)`` reach from ``start(node)``: the least number of steps, and the smallest node before it on such a way.

    Edges are dealt by ``src`` once, where they also lose their copies; rounds shuffle what they reach, never the edges.
    """
    spark = edges.sparkSession
    edges, forget = bucketed(edges.select("src", "dst").filter("src is not null"), "edges", "src")

    def written(rows: DataFrame, steps: int) -> tuple[DataFrame, str]:
        return materialize(rows.select("node", F.lit(steps).cast("long").alias("steps"), "via"), "steps")

    last, path = written(start.select("node", F.lit(None).cast(start.schema["node"].dataType).alias("via")).distinct(), 0)
    schema, paths = last.schema, [path]
    for steps in range(1, max_rounds + 1):
        found = edges.join(last.select("node"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        known = spark.read.schema(schema).parquet(*paths).select(F.col("node").alias("__node"))
        last, path = written(found.join(known, _same(["node"], "__"), "left_anti"), steps)
        if last.isEmpty():
            remove(spark, path)
            forget()
            return spark.read.schema(schema).parquet(*paths)
        paths.append(path)
    forget()
    raise FurtherError(f"some node is further than {max_rounds} steps")


_PAIR = ["src", "dst"]


def dealt(edges: DataFrame, label: str = "edges") -> DataFrame:
    """``edges(src, dst)`` without nulls and copies, in buckets of ``src`` in the shared folder."""
    buckets = Buckets(edges.sparkSession, label, "src")
    buckets.append(edges.select(*_PAIR).dropna().repartition(buckets.count, "src").distinct())
    return buckets.settle()


def _after(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with an edge behind."""
    return pairs.withColumnRenamed("dst", "mid").join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select(*_PAIR)


def _ways(start: DataFrame, edges: Sequence[DataFrame], max_rounds: int, known: DataFrame | None = None) -> Buckets:
    """Pairs of ``start`` and what they become with edges behind, as far as the pairs are not ``known``.

    Pairs lie in buckets of ``dst`` and edges in buckets of ``src``, so they meet where they lie, and a round shuffles only what it finds, once.
    """
    found = Buckets(start.sparkSession, "pairs", "dst")
    for _ in range(max_rounds + 1):
        fresh = start.repartition(found.count, "dst").distinct()
        for there in ([found.all()] if found.rounds else []) + ([] if known is None else [known]):
            fresh = fresh.join(there, ["dst", "src"], "left_anti")
        last = found.append(fresh.select(*_PAIR))
        if last.isEmpty():
            return found
        start = reduce(DataFrame.union, [_after(last, e) for e in edges])
    found.settle()
    raise FurtherError(f"the closure is deeper than {max_rounds} steps")


def closure(edges: DataFrame, max_rounds: int = 1000, in_buckets: bool = False) -> DataFrame:
    """``src, dst`` of all ways of one edge or more; nulls are no nodes.  Edges ``in_buckets`` are those that ``dealt`` gave."""
    edges = edges if in_buckets else dealt(edges)
    with joins_by_one_key(edges.sparkSession):
        return _ways(edges.select(*_PAIR), [edges], max_rounds).settle()


def maintained(known: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, max_rounds: int = 1000, in_buckets: bool = False) -> DataFrame:
    """The closure after a change of edges, from the ``known`` one of ``edges``: without ``removed``, then with ``added``.

    Removed edges that are not there and added ones that are there change nothing; an edge that is both stays.
    A known closure that ``closure`` or this gave lies in buckets and is not shuffled, nor are edges ``in_buckets``, which ``dealt`` gave.
    """
    spark, known = edges.sparkSession, known.select(*_PAIR)
    every = edges if in_buckets else dealt(edges)
    added = dealt(added, "added-edges")
    with joins_by_one_key(spark):
        buckets = Buckets(spark, "gone-edges", "src")
        asked = removed.select(*_PAIR).dropna().repartition(buckets.count, "src").distinct()
        buckets.append(asked.join(every, _PAIR, "left_semi").join(added, _PAIR, "left_anti").select(*_PAIR))
        gone = buckets.settle()
        kept = every.join(gone, _PAIR, "left_anti").select(*_PAIR)
        # all pairs with a way over a removed edge
        doubtful = _ways(gone.union(_after(known, gone)), [every], max_rounds).settle()
        sure = known.join(doubtful, ["dst", "src"], "left_anti").select(*_PAIR)
        again = _proven(doubtful, known, kept, max_rounds)
        buckets = Buckets(spark, "present", "dst")
        buckets.append(sure)
        buckets.append(again)
        present = buckets.settle()
        fresh = _ways(added.union(_after(present, added)), [kept, added], max_rounds, present).settle()
    return present.union(fresh)


def _proven(doubtful: DataFrame, known: DataFrame, kept: DataFrame, max_rounds: int) -> DataFrame:
    """The ``doubtful`` pairs that have a way left: a kept edge, or one to where a sure pair or one that is proven again begins."""
    steps = Buckets(doubtful.sparkSession, "steps", "end")

    def marked(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.lit(True).alias(name))

    ways = doubtful.withColumnRenamed("dst", "end").join(kept.withColumnRenamed("dst", "mid"), "src").repartition(steps.count, "end")
    open_, there = F.col("open").isNotNull(), F.col("there").isNotNull()
    ways = ways.join(marked(doubtful, "open"), ["end", "mid"], "left").join(marked(known, "there"), ["end", "mid"], "left")
    edge = F.col("mid") == F.col("end")
    steps.append(ways.filter(edge | open_ | there).select("src", "mid", "end", (edge | ~open_).alias("sure")))
    ways = steps.settle()
    waiting = ways.filter("not sure")
    proven = Buckets(doubtful.sparkSession, "proven", "dst")
    found = ways.filter("sure").select("src", F.col("end").alias("dst"))
    for _ in range(max_rounds + 1):
        fresh = found.distinct()
        if proven.rounds:
            fresh = fresh.join(proven.all(), ["dst", "src"], "left_anti")
        last = proven.append(fresh.select(*_PAIR))
        if last.isEmpty():
            return proven.settle()
        found = waiting.join(marked(last, "now"), ["end", "mid"], "left_semi").select("src", F.col("end").alias("dst"))
    proven.settle()
    raise FurtherError(f"the closure is deeper than {max_rounds} steps")


def bounded_sets(rows: DataFrame, keys: Sequence[str], value: str, most: int = 32) -> DataFrame:
    """``keys, values, overflow``: the ``most`` smallest distinct non-null values of each key, sorted, and whether there are more.

    Tasks send at most ``most + 1`` values of a key: the filter on the row number is applied before the shuffle, too.  Sets
    merge: the sets of two tables are those of their exploded ``values``, with ``overflow`` if any part has it.
    """
    from pyspark.sql import Window

    distinct = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("__one"))
    ranked = distinct.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("__n") <= most + 1)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))
    return listed.select(*keys, F.slice("values", 1, most).alias("values"), (F.size("values") > most).alias("overflow"))
