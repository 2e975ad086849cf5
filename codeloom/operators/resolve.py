"""Joins that resolve names, and reach over links."""

from __future__ import annotations

from codeloom.storage import materialize, remove
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_unique(refs: DataFrame, candidates: DataFrame, ref_id: str, key: str, target: str, name: Column) -> DataFrame:
    """Every reference with its target: resolved if exactly one candidate has its key.

    Else the target is ``unresolved:NAME``.  Adds ``target, resolved``.
    """
    found = candidates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(target).alias("__n"), F.min(target).alias("__target"))
    joined = refs.join(found, key, "left")
    one = F.coalesce(F.col("__n") == 1, F.lit(False))
    return joined.withColumn("target", F.when(one, F.col("__target").cast("string")).otherwise(F.concat(F.lit("unresolved:"), name))).withColumn("resolved", one).drop("__n", "__target")


def scope_ladder(scope: Column, separator: str = ".") -> Column:
    """All prefixes of a scope with their depths, the empty one too: array of (prefix, depth)."""
    parts = F.filter(F.split(scope, f"\\{separator}"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), separator).alias("prefix"), n.alias("depth")))


def nearest_scope(refs: DataFrame, defs: DataFrame, ref_id: str, scope: str, def_scope: str, target: str, separator: str = ".") -> DataFrame:
    """References with the definition in the nearest enclosing scope: ``target, depth, resolved``.

    Resolved if one definition stands in the deepest scope that has any.  Definitions become one row a scope before they meet
    anything, and each scope is looked up once, so rows follow the scopes and their depths, however many definitions share one.
    """
    there = defs.filter(F.col(def_scope).isNotNull()).groupBy(F.col(def_scope).alias("__scope")).agg(F.min(target).alias("__least"), F.max(target).alias("__most"))
    steps = refs.select(F.col(scope).alias("__from")).filter("__from is not null").distinct().select("__from", F.explode(scope_ladder(F.col("__from"), separator)).alias("__step"))
    hits = steps.join(there, F.col("__step.prefix") == F.col("__scope"))
    best = hits.groupBy("__from").agg(F.max(F.struct(F.col("__step.depth").alias("depth"), "__least", "__most")).alias("__best"))
    found = refs.join(best, F.col(scope) == F.col("__from"), "left")
    least, most = F.col("__best.__least"), F.col("__best.__most")
    return found.select(*refs.columns, F.col("__best.depth").alias("depth"), least.alias("target"), F.coalesce(least == most, F.lit(False)).alias("resolved"))


def neighbours(edges: DataFrame, nodes: DataFrame, forward: bool) -> DataFrame:
    """Distinct (node, other): callees of ``nodes(node)``, or callers; unresolved edges count too."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return nodes.join(edges.select(F.col(a).alias("node"), F.col(b).alias("other")), "node").select("node", "other").distinct()


def two_hops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes within two undirected steps, with the smaller number of steps."""
    # edges are read for the nodes at hand, and what repeats goes after each step: no pass makes all edges distinct
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    one = nodes.distinct().join(both.withColumnRenamed("a", "node"), "node").select("node", F.col("b").alias("other")).distinct()
    one, _ = materialize(one.withColumn("hops", F.lit(1)), "near")
    two = one.join(both.withColumnRenamed("a", "other"), "other").select("node", F.col("b").alias("other"), F.lit(2).alias("hops")).distinct()
    return one.union(two).filter("node <> other").groupBy("node", "other").agg(F.min("hops").alias("hops"))


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes reachable from ``start(node)`` over ``edges(src, dst)``, with the least number of steps.

    Each round joins only the new frontier; rounds are cut by written tables.
    """
    spark = edges.sparkSession
    edges, _ = materialize(edges.select("src", "dst").distinct(), "reach-edges")  # rounds read them again and again
    seen, path = materialize(start.select("node").distinct().withColumn("hops", F.lit(0)), "reach")
    frontier, paths = seen, [path]
    for hop in range(1, max_rounds + 1):
        fresh = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        fresh, path = materialize(fresh.withColumn("hops", F.lit(hop)), "reach")
        if fresh.isEmpty():
            remove(spark, path)
            return seen
        paths.append(path)
        frontier, seen = fresh, seen.unionByName(fresh)
    raise RuntimeError(f"the closure is deeper than {max_rounds} steps")


def ranked_context(tiers: list[tuple[DataFrame, int, str]], k: int) -> DataFrame:
    """Candidates of scored tiers (target, key): best score, distinct reasons best first, top ``k`` and how many were left out."""
    # tiers are bits of a number, so that a candidate is one row of fixed size, and scores and reasons are told from it at the end
    parts = None
    for n, (df, _, _) in enumerate(tiers):
        t = df.select("target", "key", F.lit(1 << n).alias("__tiers"))
        parts = t if parts is None else parts.unionByName(t)
    has = [F.col("__tiers").bitwiseAND(F.lit(1 << n)) != 0 for n in range(len(tiers))]
    score = F.greatest(*[F.when(h, t[1]) for h, t in zip(has, tiers, strict=True)], F.lit(None).cast("int"))
    order: dict[str, list[int]] = {}  # a reason may stand for several tiers; its best score counts
    for n, (_, _, reason) in enumerate(tiers):
        order.setdefault(reason, []).append(n)

    def reason_of(reason: str) -> Column:
        return F.greatest(*[F.when(has[n], F.struct(F.lit(tiers[n][1]).alias("score"), F.lit(reason).alias("reason"))) for n in order[reason]], F.lit(None).cast("struct<score: int, reason: string>"))

    found = F.filter(F.array(*map(reason_of, order)), lambda r: r.isNotNull())
    reasons = F.transform(F.array_sort(F.transform(found, lambda r: F.struct((-r["score"]).alias("o"), r["reason"].alias("reason")))), lambda r: r["reason"])
    merged = parts.groupBy("target", "key").agg(F.bit_or("__tiers").alias("__tiers")).withColumn("score", score)
    # the filter on the number is applied before the shuffle, too, so that a task sends k rows of a target; a count in the same window would hinder it
    w = Window.partitionBy("target").orderBy(F.desc("score"), "key")
    best = merged.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    counts = merged.groupBy("target").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("target", "__target")
    ranked = best.join(counts, F.col("target").eqNullSafe(F.col("__target")))
    return ranked.select("target", "key", "score", reasons.alias("reasons"), "position", F.greatest(F.col("__n") - k, F.lit(0).cast("long")).alias("omitted"))


def select_tiered(symbols: DataFrame, target: str, exact: list[str], contains: str) -> DataFrame:
    """Rows whose exact columns equal ``target``; only if there are none, rows whose name contains it in any case."""
    tier = F.lit(None).cast("int")
    for c in exact:
        tier = F.coalesce(tier, F.when(F.col(c) == target, 0))
    tier = F.coalesce(tier, F.when(F.contains(F.lower(contains), F.lit(target.lower())), 1))
    ranked = symbols.withColumn("__tier", tier).filter("__tier is not null")
    best = ranked.agg(F.min("__tier").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__tier") == F.col("__best"), "left_semi").drop("__tier")


def listed(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in a total ``order``, each with ``omitted``: how many there are beyond them."""
    omitted = max(0, rows.count() - limit)
    return rows.orderBy(*order).limit(limit).withColumn("omitted", F.lit(omitted).cast("long"))
