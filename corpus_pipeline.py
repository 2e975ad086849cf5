"""A corpus from raw documents to packed training sequences.

Each stage reads what the stage before it wrote.  ``run`` applies all of them to
the ``documents`` of a folder.  The last stage's rows depend on how its input is
dealt over tasks and two stages have no SQL form, so there is no SQL
for the whole; tests compare it with a brute-force version.
"""

from __future__ import annotations

from codeloom.llm.decontaminate import remove_contamination
from codeloom.llm.exact_dedup import keep_one_per_text
from codeloom.llm.near_dedup import keep_one_per_class
from codeloom.llm.packing import packed
from codeloom.llm.subword import tokenizer_path
from codeloom.llm.toxicity import drop_toxic, fit, fold
from codeloom.sources.tables import table
from codeloom.storage import materialize, remove, scratch
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from four fifths of the labels.

    A null or empty text has no toxic word and stays, and so does everything if the labels lack a class.
    """
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return drop_toxic(docs, fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays; null and empty texts are one group, a null id is the smallest."""
    return keep_one_per_text(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate classes, the row with the smallest id stays; rows without words or id all stay."""
    return keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; rows that lose their last word go, null and empty texts stay."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"), drop_emptied=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: No SQL: the toxicity model and the packing cannot be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``; each but the last is written and reread.

    Extra columns pass through all stages but the last; an empty table gives no rows.
    Once a stage is written, what it read and its own intermediate tables are deleted.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
