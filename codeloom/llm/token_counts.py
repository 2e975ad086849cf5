"""Exact histogram of encoded lengths, and what its suffix sums answer.

Texts are encoded where they are read; only (length, documents) pairs are
shuffled, after partial sums.  Suffix sums run over blocks of lengths, so no task
gets all distinct lengths: the totals of the blocks after each block, then the lengths within it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from codeloom.llm.bytewords import slices, text_buffers
from codeloom.llm.subword import encoder
from codeloom.llm.worker import small_batches
from codeloom.storage import materialize
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of a block of the suffix sums.
SPAN = 4096


def _length_batches(tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in slices(offs):
                sizes, rows = np.unique(np.diff(enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).bounds), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(rows, pa.int64())], names=["length", "docs"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``length, docs``: how many texts encode to each number of ids.

    A null or empty text has length 0.  Repeated rows count each.  Other columns
    are not read.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_length_batches(tokenizer), "length long, docs long")
    return parts.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, the sums over lengths at least as large, and for it as a context limit.

    ``length, docs, tokens``: the histogram and its ids.
    ``docs_at_least, tokens_at_least``: sums over this and larger lengths.
    ``truncated_tokens``: ids left if every document is cut to this length.
    ``docs_truncated, tokens_lost``: documents that such a limit cuts, and ids it cuts off.
    ``rank``: share of documents of at most this length, so quantile q is the smallest length with ``rank >= q``.
    """
    # read twice below, so it is written once: the texts are encoded a single time
    histogram, _ = materialize(histogram.select("length", "docs"), "lengths")
    h = histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / SPAN).cast("long").alias("block"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    s = h.join(blocks, "block").select(
        "length", "docs", "tokens", "all_docs", "all_tokens",
        (F.sum("docs").over(within) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    lost = F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")
    longer = F.col("docs_at_least") - F.col("docs")
    return s.select("length", "docs", "tokens", "docs_at_least", "tokens_at_least", (F.col("all_tokens") - lost).alias("truncated_tokens"), longer.alias("docs_truncated"), lost.alias("tokens_lost"), ((F.col("all_docs") - longer) / F.col("all_docs")).alias("rank"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Ids left if every document is cut to ``limit`` ids, for any limit."""
    above = sums.filter(F.col("length") > limit).agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t")).first()
    total = sums.agg(F.max("tokens_at_least")).first()[0] or 0
    return int(total - (above.t or 0) + limit * (above.d or 0))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents does not exceed."""
    return sums.filter(F.col("rank") >= q).agg(F.min("length")).first()[0]
