"""Running sums, extremes and last values within keys, without a task that gets a whole key.

A window over a key puts the key into one task.  Here two passes do the same over any number of tasks:

1. rows are dealt by ranges of key *and* order, so a large key lies in several neighbouring tasks, and each part's own running
   values are written with the part's number;
2. the totals of the parts that a key had before are carried into each part.  A part goes on with at most one key, so
   there are at most as many carried rows as parts, and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from codeloom.storage import materialize
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(kind: str, value: str, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _merged(kind: str, own: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(own + carried, own, carried)
    return {"max": F.greatest, "min": F.least, "last": F.coalesce}[kind](own, carried)


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with running values: per name a kind (``sum``, ``max``, ``min`` or ``last``) and what it runs over.

    A value is over all rows of equal ``keys`` up to and with its own, in ``order``; nulls are passed over, as in windows, and null
    keys are a key.  Rows that tie in ``order`` stand in some order of their own, and all in one task: give an order without large ties.
    Without keys the order is over all rows.  The rows are read twice (ranges are sampled) and written once: select what is needed before.
    """
    dealt = rows.withColumns({f"__v_{n}": v for n, (_, v) in values.items()}).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part", *keys).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"__l_{n}": _over(kind, f"__v_{n}", upto) for n, (kind, _) in values.items()}
    local, _ = materialize(dealt.withColumns({"__at": F.row_number().over(within)} | own).drop(*[f"__v_{n}" for n in values]), "prefix")
    totals = local.groupBy("__part", *keys).agg(*[F.max_by(f"__l_{n}", "__at").alias(f"__t_{n}") for n in values])
    parts = Window.partitionBy(*keys).orderBy("__part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("__part").alias("__cpart"), *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.row_number().over(parts).alias("__nth"), *[_over(kind, f"__t_{n}", before).alias(f"__c_{n}") for n, (kind, _) in values.items()])
    on = F.col("__part") == F.col("__cpart")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__c{i}"))
    joined = local.join(F.broadcast(carried.filter("__nth > 1")), on, "left")
    return joined.select(*rows.columns, *[_merged(kind, F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, (kind, _) in values.items()])


def ordinals(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """``rows`` with their number from 1 among those of equal ``keys``."""
    return scan(rows, keys, order, {name: ("sum", F.lit(1).cast("long"))})


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, columns: Sequence[str], tie: str | None = None) -> DataFrame:
    """``left`` with the ``columns`` of the newest row of ``right`` that is not newer: ``right_at <= at``, of equal ones the largest ``tie``.

    Rows of ``left`` without such a row, or with a null key or time, have nulls; rows of ``right`` with a null time are never taken.
    Columns of ``right`` must have other names than those of ``left``.
    """
    time = left.schema[at].dataType
    own = F.struct(*[F.col(c) for c in left.columns])
    there = F.struct(*[F.col(c) for c in columns])
    none_left, none_right = F.lit(None).cast(left.select(own.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(there.alias("x")).schema["x"].dataType)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    second = F.col(tie) if tie else F.lit(0)
    kind = right.select(second.alias("x")).schema["x"].dataType
    events = right.filter(F.col(right_at).isNotNull() & known).select(*keys, F.col(right_at).cast(time).alias("__time"), F.lit(0).alias("__side"), second.alias("__tie"), none_left.alias("__left"), there.alias("__right"))
    asked = left.select(*keys, F.col(at).alias("__time"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__tie"), own.alias("__left"), none_right.alias("__right"))
    order = [F.col("__time"), F.col("__side"), F.col("__tie"), F.xxhash64("__left")]
    found = scan(events.unionByName(asked), keys, order, {"__found": ("last", F.col("__right"))}).filter("__left is not null")
    able = known & F.col("__time").isNotNull()
    return found.select("__left.*", *[F.when(able, F.col(f"__found.{c}")).alias(c) for c in columns])
