"""Comparison of two states: bags of findings, path sets, verdicts."""

from __future__ import annotations

from codeloom.operators.prefix import ordinals
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_diff(before: DataFrame, after: DataFrame, key: str, order: str) -> DataFrame:
    """Multiset difference: ``key, ordinal, status`` of unchanged, resolved and new members.

    The first k members of a key on both sides are unchanged, the rest is new or resolved.  Members are numbered by
    prefix sums, so a key with very many of them is dealt over tasks; the join is by key and number.
    """
    b = ordinals(before.select(key, order), [key], [F.col(order)]).select(key, "ordinal", F.lit(True).alias("__b"))
    a = ordinals(after.select(key, order), [key], [F.col(order)]).select(key, "ordinal", F.lit(True).alias("__a"))
    status = F.when(F.col("__b") & F.col("__a"), "unchanged").when(F.col("__b"), "resolved").otherwise("new")
    return b.join(a, [key, "ordinal"], "full_outer").select(key, "ordinal", status.alias("status"))


def bag_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The same per key as counts, without numbering rows: partial counts are merged, so a hot key is no hot task."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("__b"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("__a"))
    x, y = F.coalesce("__b", F.lit(0)), F.coalesce("__a", F.lit(0))
    return b.join(a, key, "full_outer").select(key, F.least(x, y).alias("unchanged"), F.greatest(x - y, F.lit(0)).alias("resolved"), F.greatest(y - x, F.lit(0)).alias("new"))


def assessed_diff(before: DataFrame, after: DataFrame, key: str, before_complete: bool, after_complete: bool) -> DataFrame:
    """``bag_counts`` where an incomplete side can't tell: new becomes unclassified, resolved needs both."""
    d = bag_counts(before, after, key)
    new = F.col("new") if before_complete else F.lit(0).cast("long")
    unclassified = F.lit(0).cast("long") if before_complete else F.col("new")
    resolved = F.col("resolved") if before_complete and after_complete else F.lit(0).cast("long")
    return d.select(key, "unchanged", resolved.alias("resolved"), new.alias("new"), unclassified.alias("unclassified"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def rows_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks, by all columns."""
    return left.join(right, left.columns, "left_anti").distinct()


def verdict(severe: Column, incomplete: Column, any_new: Column, changed_path: Column | None = None, detector_changed: Column | None = None) -> Column:
    """FAIL, WARN or PASS of a state against another.

    FAIL on a severe new finding, or where both sides are complete on a changed path of more than low confidence; else
    WARN if incomplete, if the detector changed or if anything is new; else PASS.
    """
    path = F.lit(False) if changed_path is None else changed_path
    detector = F.lit(False) if detector_changed is None else detector_changed
    return F.when(severe | path & ~incomplete, "FAIL").when(incomplete | detector | any_new, "WARN").otherwise("PASS")


def logical_key(file: Column, title: Column, category: Column, line_text: Column, flow_id: Column) -> Column:
    """What makes a finding the same over versions: its flow, or else its place by content, not by line number."""
    from codeloom.functions.identity import identity_sql, json_string

    text = F.trim(F.regexp_replace(line_text, r"\s+", " "))
    return F.when(flow_id.isNotNull(), identity_sql(json_string(file), json_string(title), json_string(flow_id))).otherwise(identity_sql(json_string(file), json_string(title), json_string(category), json_string(F.coalesce(text, F.lit("")))))
