"""An inverted index with block maxima: the best documents of many queries, without reading what cannot be among them.

Documents are dealt into blocks; a posting list is cut where blocks end, and each cut knows the largest count in it.  The sum of these over a query's
terms bounds every score of a block.  A term's k-th largest count is reached by k documents, so a query's k-th best score is no smaller, which
rules out all blocks with a smaller bound.  Queries meet blocks, not documents: a task scores the queries in one block and
gives their k best of it, so no row is made for a document that a query finds, only k per query and block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from codeloom.storage import materialize
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Queries that one task has at most, about: for more the posting lists of a block are given to several tasks.
TASK_QUERIES = 1 << 16


def build(words: DataFrame, block: Column) -> DataFrame:
    """``term, block, top, entries(array of id, n)`` of ``words(id, term)``, written.

    ``block`` is a column of the id that deals documents into blocks of bounded size, so that no list is longer than a block.  Null terms and ids are left out.
    """
    counts = words.filter("id is not null and term is not null").groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    cut = counts.groupBy("term", block.cast("long").alias("block")).agg(F.max("n").alias("top"), F.array_sort(F.collect_list(F.struct("id", "n"))).alias("entries"))
    return materialize(cut, "postings")[0]


def _block_scorer(k: int, schema: T.StructType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    out = to_arrow_schema(schema)

    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        entries = lists["entries"].combine_chunks()
        flat = entries.flatten()
        counts, bounds = flat.field("n").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False))])
        ids, at = np.unique(flat.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
        known, tops = {t: n for n, t in enumerate(lists["term"].to_pylist())}, lists["top"].to_pylist()
        queries, found, scores = [], [], []
        read = total = 0
        of_all = np.zeros(len(ids), dtype=np.int64)
        for query, terms, least in zip(*(asked[c].to_pylist() for c in ("query", "terms", "least")), strict=True):
            cuts = [known[t] for t in terms if t in known]
            size = sum(int(bounds[n + 1] - bounds[n]) for n in cuts)
            total += size
            if not cuts or sum(tops[n] for n in cuts) < (least or 0):
                continue
            read += size
            of_all[:] = 0
            for n in cuts:
                of_all[at[bounds[n] : bounds[n + 1]]] += counts[bounds[n] : bounds[n + 1]]  # an id stands once in a list
            best = np.flatnonzero(of_all >= (least or 1))
            if len(best) > k:
                best = best[of_all[best] >= np.partition(of_all[best], -k)[-k]]
            best = best[np.argsort(-of_all[best], kind="stable")[:k]]  # of equal scores the smaller id stands first
            queries += [query] * len(best)
            found.append(best)
            scores.append(of_all[best])
        none = [np.zeros(0, dtype=np.int64)]
        rows = [pa.array([*queries, None], out.field("query").type), pa.concat_arrays([pa.array(ids[np.concatenate(found or none)], out.field("id").type), pa.nulls(1, out.field("id").type)])]
        rows += [pa.array([*np.concatenate(scores or none).tolist(), None], pa.int64()), *(pa.array([None] * len(queries) + [n], pa.int64()) for n in (read, total))]
        return pa.Table.from_arrays(rows, schema=out)

    return run


def top(index: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
    """``query, id, score, position`` of the ``k`` best documents of every query, and the share of its terms' postings that was read.

    ``queries(query, term)`` has a row a term; repeated ones count once.  A document's score is how often the query's terms stand in it; of equal
    scores the smaller id is better.  Documents without a term are not found, and a query without any gives no rows.
    """
    asked, _ = materialize(queries.filter("query is not null and term is not null").select("query", "term").distinct(), "queries")
    lists = index.join(asked.select("term").distinct(), "term", "left_semi")
    most = lists.select("term", F.explode(F.slice(F.sort_array("entries.n", asc=False), 1, k)).alias("n"))
    least = most.groupBy("term").agg(F.get(F.sort_array(F.collect_list("n"), asc=False), F.lit(k - 1)).alias("least"))  # null without k documents
    wanted = asked.join(least, "term", "left").groupBy("query").agg(F.collect_list("term").alias("terms"), F.max("least").alias("least"))
    wanted, _ = materialize(wanted, "queries")
    parts = 1 + wanted.count() // TASK_QUERIES
    lists = lists.select("term", "block", "top", "entries", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = wanted.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).crossJoin(F.broadcast(index.select(F.col("block").alias("in")).distinct()))
    kinds = {"query": queries.schema["query"].dataType, "id": index.schema["entries"].dataType.elementType["id"].dataType}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in ("query", "id", "score", "read", "total")])
    scored = lists.groupBy("block", "part").cogroup(met.groupBy("in", "part")).applyInArrow(_block_scorer(k, schema), schema)
    scored, _ = materialize(scored, "scores")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = scored.filter("query is not null").withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)
    read, total = scored.filter("query is null").agg(F.sum("read"), F.sum("total")).first()
    return found.select("query", "id", "score", F.col("position").cast("long").alias("position")), (read or 0) / max(total or 0, 1)
