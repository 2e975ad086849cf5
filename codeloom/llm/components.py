"""Connected components of a link table, as loops over DataFrames.

Each round gives every vertex the smallest label among itself, its neighbours
and its label's own label (pointer jumping), until no label changes.  Rounds are
cut by written tables; the driver sees only one count per round, and the few vertices and labels
that hold over a thousandth of all rows, whose labels are broadcast.
"""

from __future__ import annotations

from codeloom.llm.skew import hot_keys, skew_join
from codeloom.storage import materialize, remove
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``v, label`` for each vertex of ``links(a, b)``; the label is the smallest id reachable.

    Null ends are ignored.  An empty link table gives no rows.
    """
    spark = links.sparkSession
    links = links.filter("a is not null and b is not null and a <> b")
    both, edges_path = materialize(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("v", "u"), "edges")
    hubs = hot_keys(both, "u")
    # the first round needs no labels: the smallest of a vertex and its neighbours
    labels, path = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "labels")
    for _ in range(max_rounds):
        large = hot_keys(labels, "label") if hubs else []
        near = skew_join(both, labels.select(F.col("v").alias("u"), F.col("label").alias("near")), "u", hubs).groupBy("v").agg(F.min("near").alias("near"))
        best = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = skew_join(best, up, "label", large, "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new, new_path = materialize(new, "labels")
        changed = new.filter("label <> old").limit(1).count()
        remove(spark, path)
        labels, path = new.select("v", "label"), new_path
        if not changed:
            remove(spark, edges_path)
            return labels
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")
