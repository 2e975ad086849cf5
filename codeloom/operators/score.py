"""Scores of detectors against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; null without trials."""
    p, n = hits / total, total
    middle, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = (middle - spread) / (1 + Z * Z / n), (middle + spread) / (1 + Z * Z / n)
    return F.when(total > 0, F.greatest(low, F.lit(0.0))), F.when(total > 0, F.least(high, F.lit(1.0)))


def confusion(cases: DataFrame, *groups: str) -> DataFrame:
    """Confusion matrix, precision and recall with intervals: overall and by each group.

    ``cases(positive, detected, failed)``: a failed case is a miss if positive, and no true negative.
    """
    ok = ~F.coalesce("failed", F.lit(False))
    hit = ok & F.coalesce("detected", F.lit(False))

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)

    sets = [[], *[[g] for g in groups]]
    scored = cases.groupingSets([[F.col(g) for g in s] for s in sets], *[F.col(g) for g in groups]) if groups else cases.groupBy()
    m = scored.agg(count(F.col("positive") & hit, "tp"), count(~F.col("positive") & hit, "fp"), count(F.col("positive") & ~hit, "fn"), count(~F.col("positive") & ok & ~hit, "tn"))
    found, real = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    p_low, p_high = wilson(F.col("tp"), found)
    r_low, r_high = wilson(F.col("tp"), real)
    return m.select(*groups, "tp", "fp", "fn", "tn", F.when(found > 0, F.col("tp") / found).alias("precision"), p_low.alias("precision_low"), p_high.alias("precision_high"), F.when(real > 0, F.col("tp") / real).alias("recall"), r_low.alias("recall_low"), r_high.alias("recall_high"))
