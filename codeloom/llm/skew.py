"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over one in so many rows is hot, so there are fewer hot keys than that ...
HOT_SHARE = 1000
#: ... but only if it has more rows than a task takes easily.
LEAST_HOT = 1 << 14


def hot_keys(rows: DataFrame, key: str, weight: str | None = None) -> list[Any]:
    """The hot keys of ``rows`` (of written ones: they are read twice), fewer than ``HOT_SHARE``; ``weight`` is a column of counts."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    total = rows.agg(size).first()[0] or 0
    if total <= LEAST_HOT:
        return []
    limit = max(total / HOT_SHARE, LEAST_HOT)
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(size.alias("__size"))
    return [r[0] for r in sizes.filter(F.col("__size") > limit).select(key).collect()]


def skew_join(rows: DataFrame, table: DataFrame, key: str, hot: list[Any], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key: broadcast for the hot keys, by a shuffle for the others.

    ``how`` is ``inner``, ``left`` or ``left_semi``.
    """
    if not hot:
        return rows.join(table, key, how)
    few = F.col(key).isin(hot)
    many = F.col(key).isNull() | ~few
    return rows.filter(few).join(F.broadcast(table.filter(few)), key, how).unionByName(rows.filter(many).join(table.filter(~few), key, how))
