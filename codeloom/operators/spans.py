"""Algebra of text spans: overlap and containment as semi and anti joins, without a range join.

Spans are half-open ``[start, end)`` and belong together by ``keys`` (a file, a
rule).  A span overlaps another one if the largest end of those that start before its own end lies after its
start, and lies in one if the largest end of those that start no later reaches its own.  So both are a running maximum over the starts and ends of a
key in order (``codeloom.operators.prefix``): rows are never paired, and a key with very many spans is dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from codeloom.operators.intervals import best_holding
from codeloom.operators.prefix import scan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _related(hits: DataFrame, others: DataFrame, keys: Sequence[str], contained: bool, keep: bool) -> DataFrame:
    row = F.struct(*hits.columns)
    nothing = F.lit(None).cast(hits.select(row.alias("x")).schema["x"].dataType)
    # of equal places, a span that only touches must not count for overlap, and one that starts at the same place counts for containment
    place, side = ("start", 1) if contained else ("end", -1)
    asked = hits.select(*keys, F.col(place).cast("long").alias("__place"), F.lit(side).alias("__side"), F.lit(None).cast("long").alias("__end"), row.alias("__hit"))
    known = others.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(*keys, F.col("start").cast("long").alias("__place")).agg(F.max(F.col("end").cast("long")).alias("__end"))
    known = known.select(*keys, "__place", F.lit(0).alias("__side"), "__end", nothing.alias("__hit"))
    order = [F.col("__place"), F.col("__side"), F.xxhash64("__hit")]
    reached = scan(asked.unionByName(known), keys, order, {"__reach": ("max", F.col("__end"))}).filter("__hit is not null")
    found = F.col("__reach") >= F.col("__hit.end") if contained else F.col("__reach") > F.col("__hit.start")
    for k in keys:
        found = found & F.col(k).isNotNull()
    found = F.coalesce(found & F.col("__place").isNotNull(), F.lit(False))
    return reached.filter(found if keep else ~found).select("__hit.*")


def overlapping(hits: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits that overlap some other span: all positive parts of a rule must."""
    return _related(hits, others, keys, False, True)


def not_overlapping(hits: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits that overlap no excluded span."""
    return _related(hits, others, keys, False, False)


def inside(hits: DataFrame, contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits that lie in some context."""
    return _related(hits, contexts, keys, True, True)


def outside(hits: DataFrame, contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits that lie in no context."""
    return _related(hits, contexts, keys, True, False)


def any_of(*spans: DataFrame) -> DataFrame:
    """Spans of any alternative, each once."""
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out.distinct()


def narrowest_enclosing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, row_id: str, order: str, width: Column | None = None) -> DataFrame:
    """Each point with the narrowest range that holds it, the first by ``order`` on ties, a null one last; null without one.

    ``ranges`` has ``keys``, integer ``start``, ``end`` (inclusive) and ``order``; its columns come prefixed with ``range_``.  ``row_id`` tells points apart, and is
    the same whenever ``points`` is read.  ``width`` of a range is ``end - start``, if its bounds were not rounded.
    """
    rest = [c for c in ranges.columns if c != order]
    width = F.col("end") - F.col("start") if width is None else width
    rank = F.struct(width.alias("width"), F.col(order).isNull().alias("unordered"), F.col(order).alias("order"), F.struct(*[F.col(c).alias(c) for c in rest]).alias("rest"))
    best = best_holding(points, ranges, keys, point, row_id, rank)
    columns = [(F.col("best.order") if c == order else F.col(f"best.rest.{c}")).alias(f"range_{c}") for c in ranges.columns]
    return points.join(best.select(F.col(row_id), *columns), row_id, "left").select(*points.columns, *[f"range_{c}" for c in ranges.columns])


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key: insert-or-ignore.  Which of rows that tie is open, so give a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def line_matches(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All matches of every regular expression in every line: rule_id, id, line, ordinal, match.

    ``rules(rule_id, pattern, severity)`` is a small table, whose rows become expressions over each line: nothing is joined, and each text is read once.
    """
    known = [(r.rule_id, r.pattern, r.severity) for r in rules.select("rule_id", "pattern", "severity").distinct().collect()]
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line_text"))
    if not known:
        return lines.filter(F.lit(False)).select(F.lit("").alias("rule_id"), F.lit("").alias("severity"), "id", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("ordinal"), F.lit("").alias("match"))
    line = F.col("line_text")

    def found_by(name: str, pattern: str, severity: str | None) -> Column:
        def hit(match: Column, ordinal: Column) -> Column:
            return F.struct(F.lit(name).alias("rule_id"), F.lit(severity).cast("string").alias("severity"), ordinal.cast("long").alias("ordinal"), match.alias("match"))

        return F.when(line.rlike(pattern), F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), hit))

    found = [found_by(*rule) for rule in known]
    hits = lines.select("id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("hit"))
    return hits.select("hit.rule_id", "hit.severity", "id", "line", "hit.ordinal", "hit.match")
