"""An index of integer ranges by dyadic segments: a range join as an equality join.

Level ``l`` cuts the numbers into segments of ``2 ** l``.  Every range is the disjoint union of at most two segments a
level, and a number lies in one segment a level, so it meets each range that holds it in exactly one segment.  The joins below keep
one row per segment, the best of all ranges it belongs to, so that many ranges of one key neither multiply rows nor meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers lie between -2 ** (LEVELS - 1) and 2 ** (LEVELS - 1).
LEVELS = 62
#: From this level on a segment may have very many points: they are dealt over SALTS tasks, and the segments, of which a range has few there, are repeated.
WIDE_LEVEL, SALTS = 12, 16
_OFFSET = 1 << (LEVELS - 1)


def segments(start: Column, end: Column) -> Column:
    """The segments of the range from ``start`` to ``end``, both within: an array of (level, number); null if there is no number between."""
    lo, hi = start.cast("long") + F.lit(_OFFSET), end.cast("long") + F.lit(_OFFSET + 1)
    kind = "array<struct<level: int, number: long>>"
    state = F.struct(lo.alias("lo"), hi.alias("hi"), F.array().cast(kind).alias("found"))

    def one(level: Column, number: Column, take: Column) -> Column:
        return F.when(take, F.array(F.struct(level.cast("int").alias("level"), number.alias("number")))).otherwise(F.array().cast(kind))

    def step(acc: Column, level: Column) -> Column:
        more = acc["lo"] < acc["hi"]
        left = more & (F.pmod(acc["lo"], F.lit(2)) == 1)
        lo = acc["lo"] + left.cast("long")
        right = (lo < acc["hi"]) & (F.pmod(acc["hi"], F.lit(2)) == 1)
        hi = acc["hi"] - right.cast("long")
        found = F.concat(acc["found"], one(level, acc["lo"], left), one(level, hi, right))
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), found.alias("found"))

    # once both bounds meet nothing is added, and they meet after as many levels as the length has bits
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double"))).cast("int") + 1)
    return F.when(lo < hi, F.aggregate(levels, state, step)["found"])


def best_holding(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, row_id: str, rank: Column) -> DataFrame:
    """``row_id, best`` of the points that lie in a range of equal ``keys``: the smallest ``rank`` (a struct) of all these ranges.

    ``ranges`` has ``start`` and ``end``, both within.  Points or ranges with a null key or bound meet nothing.
    """
    pieces = ranges.select(*keys, rank.alias("__rank"), F.explode(segments(F.col("start"), F.col("end"))).alias("__s"))
    index = pieces.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__s.level").alias("__level"), F.col("__s.number").alias("__number")).agg(F.min("__rank").alias("__rank"))
    levels = sorted(r[0] for r in ranges.select(F.explode(F.transform(segments(F.col("start"), F.col("end")), lambda s: s["level"]))).distinct().collect())  # at most LEVELS
    at = F.col(point).cast("long") + F.lit(_OFFSET)
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS))
    above = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(at, n).alias("number"), (salt if n >= WIDE_LEVEL else F.lit(0).cast("long")).alias("salt")) for n in levels]) if levels else F.array().cast("array<struct<level: int, number: long, salt: long>>")
    asked = points.select(F.col(row_id), *keys, F.explode(above).alias("__a"))
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col("__level") >= WIDE_LEVEL, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))
    dealt = index.withColumn("__salt", F.explode(copies))
    on = (F.col("__a.level") == F.col("__level")) & (F.col("__a.number") == F.col("__number")) & (F.col("__a.salt") == F.col("__salt"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    # either side has many times the rows that Spark's estimates give it, as they leave out explode(): neither may be broadcast
    return asked.hint("merge").join(dealt, on).groupBy(row_id).agg(F.min("__rank").alias("best"))
