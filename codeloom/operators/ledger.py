"""Referential and order checks of records, as rows that name what is wrong."""

from __future__ import annotations

from codeloom.operators import prefix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_violations(units: DataFrame, records: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """``violation, key``: units without a record, records without a unit, units with several records."""
    missing, unknown, repeated = names
    lacking = units.select(key).join(records.select(key), key, "left_anti").select(F.lit(missing).alias("violation"), key)
    stray = records.select(key).join(units.select(key), key, "left_anti").select(F.lit(unknown).alias("violation"), key)
    twice = records.groupBy(key).count().filter("count > 1").select(F.lit(repeated).alias("violation"), key)
    return lacking.unionByName(stray).unionByName(twice)


def unsorted_rows(rows: DataFrame, group: str | None, position: str, key: str) -> DataFrame:
    """Rows whose key does not come after the largest key before it in their group; without a group, in all rows."""
    keys = [group] if group else []
    # the largest key of the rows before, without the row itself: rows at their place come before keys at the same place
    marks = rows.select(*keys, F.col(position).alias("__place"), F.lit(1).alias("__side"), F.col(key).alias("__key"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("x")).schema["x"].dataType).alias("__row"))
    asked = rows.select(*keys, F.col(position).alias("__place"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema[key].dataType).alias("__key"), F.struct(*rows.columns).alias("__row"))
    order = [F.col("__place"), F.col("__side"), F.xxhash64("__row")]
    found = prefix.scan(marks.unionByName(asked), keys, order, {"__before": ("max", F.col("__key"))})
    return found.filter(F.col("__row").isNotNull() & (F.col("__before") >= F.col(f"__row.{key}"))).select("__row.*")


def failing(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """``violation, id`` for each rule that a row breaks; a rule that is null counts as broken."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("violation"), F.col(id_col).alias("id"))


def coverage_counts(units: DataFrame, records: DataFrame, key: str, group: str, states: dict[str, Column]) -> DataFrame:
    """Per ``group`` of units: how many records are in each state, and ``pending`` units without a record."""
    rows = units.join(records.withColumn("__there", F.lit(True)), key, "left")
    return rows.groupBy(group).agg(*[F.count_if(c).alias(name) for name, c in states.items()], F.count_if(F.col("__there").isNull()).alias("pending"))


def next_pending(units: DataFrame, records: DataFrame, key: str, group: str) -> DataFrame:
    """Per ``group``: the smallest unit without a record, and how many there are."""
    left = units.join(records.select(key).distinct(), key, "left_anti")
    return left.groupBy(group).agg(F.min(key).alias("next_unit"), F.count(F.lit(1)).alias("pending"))


def ordinals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``ordinal``, their number from 1 among those of equal ``keys``."""
    return prefix.ordinals(rows, keys, [F.col(order)])


def counters(rows: DataFrame, kind: str, owner: str) -> DataFrame:
    """``kind, n, owners``: rows and distinct owners of each kind."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(owner).alias("owners"))
