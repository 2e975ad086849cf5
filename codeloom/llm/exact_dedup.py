"""Exact duplicate detection by skew-safe combining, in DataFrame functions only.

Three combining stages, each of which groups by the whole text beside its
digest, so that a digest collision never merges two texts:

1. *locally*: the partial aggregation of each task leaves one row per text and task;
2. *salted*: those rows merge per (digest, salt), the salt being the task's number
   modulo ``salts``, so a text that fills a third of the table meets in ``salts`` tasks;
3. *globally*: the salt winners of each text merge.

The groups of two or more rows are written to the shared folder with their texts.  Every
row then finds its group by SHA-256, xxHash64 *and* text.  Only rows that may be in a group bring their texts to that join: a
broadcast bit set of bounded size tells the others.  Groups with over a thousandth of the
grouped rows, of which there are fewer than a thousand, are dealt over ``salts`` tasks.
"""

from __future__ import annotations

from codeloom.llm.bitset import marked
from codeloom.storage import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group with over one in so many grouped rows is hot.
HOT_SHARE = 1000


def fold_case(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null gives the empty text.

    Where every character is one byte, ``lower`` does just that, and faster.
    """
    filled = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(F.translate(filled, _UPPER, _LOWER))


def duplicate_groups(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``digest, check, body, keep_id, group_size``."""
    body = docs.select(F.col(id_col).alias("id"), fold_case(F.col(text_col)).alias("body"))
    keyed = body.select("id", "body", F.sha2("body", 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "body").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("rows"))
    merged = salted.groupBy("digest", "body").agg(F.max("winner").alias("keep_id"), F.sum("rows").alias("group_size"))
    return merged.select("digest", F.xxhash64("body").alias("check"), "body", "keep_id", "group_size")


def _repeated(docs: DataFrame, salts: int, id_col: str, text_col: str) -> DataFrame:
    """The groups of two or more rows, written."""
    return materialize(duplicate_groups(docs, salts, id_col, text_col).filter("group_size > 1"), "dup-groups")[0]


def _keyed(docs: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with digest, check and text of each row, and whether it may be in a group."""
    body = fold_case(F.col(text_col))
    rows = docs.withColumns({"__body": body, "__sha": F.sha2(body, 256), "__check": F.xxhash64(body)})
    return marked(rows, F.col("__sha"), groups.select("digest"), "__maybe")


def _with_groups(rows: DataFrame, groups: DataFrame, salts: int, id_col: str) -> DataFrame:
    """The rows of ``_keyed`` with ``__keep`` and ``__size`` of their group, null without one."""
    limit = (groups.agg(F.sum("group_size")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("group_size") > limit).select(F.col("digest").alias("h_digest"), F.col("check").alias("h_check")).distinct())
    rows = rows.join(hot, (F.col("__sha") == F.col("h_digest")) & (F.col("__check") == F.col("h_check")), "left")
    spread = F.pmod(F.xxhash64(id_col) + F.spark_partition_id(), F.lit(salts))
    rows = rows.withColumn("__salt", F.when(F.col("h_digest").isNotNull(), spread).otherwise(F.lit(0)).cast("int")).drop("h_digest", "h_check")
    each = F.when(F.col("group_size") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = groups.select(F.col("digest").alias("g_digest"), F.col("check").alias("g_check"), F.col("body").alias("g_body"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"), F.explode(each).alias("g_salt"))
    same = (F.col("__sha") == F.col("g_digest")) & (F.col("__check") == F.col("g_check")) & (F.col("__salt") == F.col("g_salt")) & (F.col("__body") == F.col("g_body"))
    return rows.join(dealt, same, "left").drop("g_digest", "g_check", "g_body", "g_salt", "__salt")


def exact_duplicates(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of equal texts, A-Z folded: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest id of its group stays.  A null text counts as
    empty; empty texts are one group.  Rows that repeat an id within a group
    count singly in ``group_size`` and share the decision.  A null id is
    smaller than any other; in a group of null ids only, ``keep_id`` is null and
    the rows are kept.  Other columns of ``docs`` are not read.  An empty table
    gives no rows.
    """
    groups = _repeated(docs, salts, id_col, text_col)
    keyed = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), groups, "__text")
    rows = keyed.select("doc_id", "__sha", "__check", F.when(F.col("__maybe"), F.col("__body")).alias("__body"))
    rows = _with_groups(rows, groups, salts, "doc_id")
    keep = F.when(F.col("__size").isNotNull(), F.col("__keep")).otherwise(F.col("doc_id"))
    size = F.coalesce("__size", F.lit(1)).cast("long")
    return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_one_per_text(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of repeated rows one stays.

    Nulls, empty texts and empty tables are as in ``exact_duplicates``.  Rows that can be in no group of equal texts stay
    where they are; only the others are shuffled.  Columns whose names begin with two underscores, as this operator's own do, are kept too.
    """
    groups = _repeated(docs, salts, id_col, text_col)
    names = [f"c{n}" for n in range(len(docs.columns))]  # names of its own clash with no column
    own = docs.toDF(*names)
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    keyed = _keyed(own, groups, own_text)
    alone = keyed.filter(~F.col("__maybe")).select(*names)
    rows = _with_groups(keyed.filter("__maybe"), groups, salts, own_id)
    stay = rows.filter(F.col("__size").isNull() | F.col("__keep").eqNullSafe(F.col(own_id))).dropDuplicates(["__sha", "__check", "__body"])
    return alone.unionAll(stay.select(*names)).toDF(*docs.columns)
