"""A broadcast set of bounded size that lets most unwanted rows be told before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a set.
FILTER_WORDS = 1 << 20


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(FILTER_WORDS)), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")


def marked(rows: DataFrame, key: Column, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the column ``flag``: false only where ``key`` is not in the one column of ``wanted``.

    The set is ``FILTER_WORDS`` words of 64 bits, made by an aggregation, so that its size is
    bounded whatever the number of keys and it can be broadcast.
    """
    word, bit = _place(F.col(wanted.columns[0]))
    one = F.lit(1).cast("long")
    bits = wanted.select(word.alias("__word"), F.call_function("shiftleft", one, bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = _place(key)
    inside = F.col("__bits").bitwiseAND(F.call_function("shiftleft", one, bit)) != 0
    return rows.join(F.broadcast(bits), word == F.col("__word"), "left").select(*(rows[c] for c in rows.columns), F.coalesce(inside, F.lit(False)).alias(flag))
