"""The ordered severity scale; never compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by rank.
LEVELS = ("info", "low", "medium", "high", "critical")
#: Other spellings.
ALIASES = {"warning": "medium", "error": "high"}
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def parse(text: str) -> str:
    """The name of a severity in any case or spelling."""
    name = text.strip().lower()
    name = ALIASES.get(name, name)
    if name not in LEVELS:
        raise ValueError(f"unknown severity {text!r}")
    return name


def parse_col(text: Column) -> Column:
    """As ``parse``; null for an unknown one."""
    low = F.lower(F.trim(text))
    return F.when(low == "warning", "medium").when(low == "error", "high").when(low.isin(*LEVELS), low)


def rank(name: Column) -> Column:
    """0 for info to 4 for critical; null for anything else."""
    low = F.lower(name)
    out = F.when(low == LEVELS[0], 0)
    for n, level in enumerate(LEVELS[1:], 1):
        out = out.when(low == level, n)
    return out


def label(rank_col: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank_col.cast("int") + 1)


def sarif_level(name: Column) -> Column:
    return F.when(rank(name) >= 3, "error").when(rank(name) == 2, "warning").otherwise("note")


def threshold_exit(findings, threshold: str, complete: Column | bool = True):
    """One row, ``exit_code``: 2 if the scan is incomplete, 1 if a finding reaches the threshold, else 0."""
    worst = findings.agg(F.max(rank(F.col("severity"))).alias("worst"))
    done = complete if isinstance(complete, Column) else F.lit(complete)
    return worst.select(F.when(~done, 2).when(F.coalesce("worst", F.lit(-1)) >= LEVELS.index(parse(threshold)), 1).otherwise(0).alias("exit_code"))
