"""Lexical relevance of texts, excerpts and budgets."""

from __future__ import annotations

from collections.abc import Callable

from codeloom.operators import prefix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in a text, A-Z folded."""
    return _contained(F.lower(text), words)


def _contained(low: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def relevance(path: Column, text: Column, words: list[str], focus: Column | None = None, manifest: Column | None = None) -> Column:
    """Ten for each word in the path, one for each in the text, 1000 for the focus, 5 for a manifest file."""
    out = 10 * word_hits(path, words) + word_hits(text, words)
    if focus is not None:
        out = out + F.when(focus, 1000).otherwise(0)
    if manifest is not None:
        out = out + F.when(manifest, 5).otherwise(0)
    return out


def best_line(text: Column, words: list[str]) -> Column:
    """1-based line with the most word hits, the last one on ties."""
    scored = F.transform(F.split(text, "\n"), lambda line, n: F.struct(word_hits(line, words).alias("hits"), (n + 1).alias("line")))
    return F.array_max(scored)["line"]


#: Lines before the anchor, lines and bytes of an excerpt at most.
LINES_BEFORE, EXCERPT_LINES, EXCERPT_BYTES = 8, 40, 2500


def excerpt(text: Column, words: list[str], anchor: Column | None = None) -> Column:
    """``start_line, end_line, text`` (numbered lines) round the line with the most word hits, or round ``anchor``; null if not even a line fits.

    Lines end at a line feed, a carriage return before it does not count, and there is no line after the last line feed.
    """
    # each step is bound to a name of its own: an expression that a lambda holds is made anew for each element
    def found(split: Column) -> Column:
        count = F.size(split) - (F.element_at(split, -1) == "").cast("int")
        return F.struct(split.alias("all"), count.alias("n"))

    def placed(lines: Column) -> Column:
        if anchor is None:
            low = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
            hits = F.transform(low, lambda line, n: F.struct(_contained(line, words).alias("hits"), n.alias("at")))
            at = _bound(F.array_max(F.slice(hits, F.lit(1), F.greatest(lines["n"], F.lit(1)))), lambda best: F.when(best["hits"] > 0, best["at"]).otherwise(0))
        else:
            at = F.least(anchor - 1, lines["n"] - 1)
        return F.struct(F.greatest(at - LINES_BEFORE, F.lit(0)).alias("first"), lines.alias("lines"))

    def taken(place: Column) -> Column:
        here = F.slice(place["lines"]["all"], place["first"] + 1, F.greatest(F.least(F.lit(EXCERPT_LINES), place["lines"]["n"] - place["first"]), F.lit(0)))
        return F.struct(place["first"].alias("first"), here.alias("here"))

    def cut(window: Column) -> Column:
        numbered = F.transform(window["here"], lambda line, n: F.concat((window["first"] + n + 1).cast("string"), F.lit(": "), F.regexp_replace(line, "\r$", ""), F.lit("\n")))
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(acc: Column, line: Column) -> Column:
            fits = acc["open"] & (F.octet_length(acc["text"]) + F.octet_length(line) <= EXCERPT_BYTES)
            return F.struct(F.when(fits, F.concat(acc["text"], line)).otherwise(acc["text"]).alias("text"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.struct(window["first"].alias("first"), F.aggregate(numbered, start, add).alias("kept"))

    def shown(x: Column) -> Column:
        return F.when(x["kept"]["n"] > 0, F.struct((x["first"] + 1).alias("start_line"), (x["first"] + x["kept"]["n"]).alias("end_line"), x["kept"]["text"].alias("text")))

    out = F.split(F.coalesce(text, F.lit("")), "\n")
    for step in (found, placed, taken, cut, shown):
        out = _bound(out, step)
    return out


def running_budget(rows: DataFrame, size: Column, order: list[str], budget: int, group: str | None = None) -> DataFrame:
    """Rows in order with the sum of sizes up to each, and whether it is within the budget.

    Sums are carried over tasks (``codeloom.operators.prefix``), so neither a large group nor the order over all rows is one task.
    """
    summed = prefix.scan(rows, [group] if group else [], [F.col(c) for c in order], {"used": ("sum", size)})
    return summed.withColumn("within", F.col("used") <= budget)
