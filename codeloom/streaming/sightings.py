"""Sightings of findings over numbered scans, as bitmaps that merge.

A finding's scans are cut into blocks of ``SPAN``, and a block is a number with a bit per scan.  Blocks merge by ``bit_or``, in any
order and however often: the aggregation is partial on every task, so that a key with a third of all rows is no hot task, and a stream keeps
one number per key and block in its state store, where late and repeated sightings change nothing but their bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scans of a block.
SPAN = 32


def sighting_blocks(rows: DataFrame, keys: list[str], scan: Column, *more: Column) -> DataFrame:
    """``keys, block, bits, first, last, sightings`` and ``more`` aggregates of rows or of a stream; rows without a scan are left out."""
    numbered = rows.withColumn("__scan", scan.cast("long")).filter("__scan is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("__scan"), F.lit(SPAN)).cast("int"))
    block = F.floor(F.col("__scan") / SPAN).cast("long").alias("block")
    return numbered.groupBy(*keys, block).agg(F.bit_or(bit).alias("bits"), F.min("__scan").alias("first"), F.max("__scan").alias("last"), F.count(F.lit(1)).alias("sightings"), *more)


def lifecycle_of_blocks(blocks: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``keys, first_seen, last_seen, scans, reopened, sightings`` and ``more`` aggregates; a block has one row.

    ``reopened`` counts the scans that follow a scan without the finding, but for the first.  A window holds one row per
    block of a key, however many sightings it has.
    """
    w = Window.partitionBy(*keys).orderBy("block")
    adjacent = F.lag("block").over(w) == F.col("block") - 1
    carry = F.when(adjacent, F.shiftright(F.lag("bits").over(w), SPAN - 1)).otherwise(0)
    before = F.shiftleft("bits", 1).bitwiseOR(F.coalesce(carry, F.lit(0)).cast("long"))
    starts = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(before)))
    folded = blocks.withColumn("__starts", starts).groupBy(*keys)
    return folded.agg(F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.sum(F.bit_count("bits")).alias("scans"), (F.sum("__starts") - 1).alias("reopened"), F.sum("sightings").alias("sightings"), *more)
