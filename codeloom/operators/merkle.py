"""Hash trees over keyed rows: equal parts of two tables are told by one hash each, and are never opened.

The key's SHA-256 places a row in the tree: its first ``depth`` hex digits name the leaf node, fewer digits the nodes above.  A leaf node's
digest is of its rows in order, and an inner node's of its at most sixteen children in order, so equal digests mean equal rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from codeloom.storage import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a leaf node has on average at most.
LEAF_ROWS = 256


@dataclass(frozen=True)
class Tree:
    """``nodes(level, prefix, digest, rows)`` and the ``rows(prefix, key, hash)`` below the leaf nodes."""

    nodes: DataFrame
    rows: DataFrame
    depth: int

    def root(self) -> str:
        """The digest of all rows; that of nothing for none."""
        top = self.nodes.filter("level = 0").first()
        return top.digest if top else "0" * 64


def depth_for(rows: int) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / LEAF_ROWS, 16)))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda s: F.concat_ws(":", *[s[f"c{n}"] for n in range(len(parts))])), "\n"), 256)


def tree(table: DataFrame, key: str, value: str, depth: int | None = None) -> Tree:
    """The tree of ``key, value`` rows, of which equal ones count once; trees of equal ``depth`` can be compared.

    ``value`` is a hash of the row's content, and as nulls and keys are told apart by their own hashes, any text may be in either.
    """
    place = F.sha2(F.concat(F.when(F.col(key).isNull(), "n").otherwise("k"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    content = F.sha2(F.concat(F.when(F.col(value).isNull(), "n").otherwise("v"), F.coalesce(F.col(value).cast("string"), F.lit(""))), 256)
    rows, _ = materialize(table.select(place.alias("place"), content.alias("content"), F.col(key).alias("key"), F.col(value).alias("hash")).distinct(), "leaves")
    depth = depth_for(rows.count()) if depth is None else depth
    rows = rows.withColumn("prefix", F.substring("place", 1, depth))
    level, _ = materialize(rows.groupBy("prefix").agg(_digest(F.col("place").alias("c0"), F.col("content").alias("c1")).alias("digest"), F.count(F.lit(1)).alias("rows")), "nodes")
    nodes = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(F.substring("prefix", 1, d).alias("up")).agg(_digest(F.col("prefix").alias("c0"), F.col("digest").alias("c1")).alias("digest"), F.sum("rows").alias("rows"))
        level, _ = materialize(up.withColumnRenamed("up", "prefix"), "nodes")
        nodes = nodes.unionByName(level.withColumn("level", F.lit(d)))
    return Tree(nodes, rows.select("prefix", "key", "hash"), depth)


def differences(before: Tree, after: Tree) -> tuple[DataFrame, int]:
    """``key, old_hash, new_hash, status`` of rows that were added, removed or changed, and how many nodes were opened for it.

    From the root down, only children of nodes that differ are looked at, and only rows of leaf nodes that do.
    A key with several hashes is paired with each of them.
    """
    if before.depth != after.depth:
        raise ValueError("trees of different depths cannot be compared")
    spark = before.nodes.sparkSession
    opened = 0
    open_ = spark.createDataFrame([("",)], "prefix string")
    for d in range(before.depth + 1):
        parent = F.substring("prefix", 1, max(d - 1, 0))

        def children(t: Tree, name: str, d=d, parent=parent, open_=open_) -> DataFrame:
            own = t.nodes.filter(F.col("level") == d).withColumn("__up", parent)
            return own.join(open_.withColumnRenamed("prefix", "__up"), "__up", "left_semi").select("prefix", F.col("digest").alias(name))

        pairs = children(before, "a").join(children(after, "b"), "prefix", "full_outer")
        looked, _ = materialize(pairs.select("prefix", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs")), "opened")
        opened += looked.count()
        open_ = looked.filter("differs").select("prefix")
    a, b = (t.rows.join(open_, "prefix", "left_semi").select(F.col("key"), F.col("hash").alias(name), F.lit(True).alias(f"in_{name}")) for t, name in ((before, "old_hash"), (after, "new_hash")))
    joined = a.withColumnRenamed("key", "old_key").join(b.withColumnRenamed("key", "new_key"), F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    status = F.when(F.col("in_old_hash").isNull(), "added").when(F.col("in_new_hash").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    named = joined.select(F.when(F.col("in_old_hash").isNull(), F.col("new_key")).otherwise(F.col("old_key")).alias("key"), "old_hash", "new_hash", status.alias("status"))
    return named.filter("status <> 'unchanged'"), opened


def identity(table: DataFrame, key: str, value: str) -> str:
    """One hash of all ``key, value`` rows, whatever their order; other rows have another one."""
    return tree(table, key, value).root()
