"""Runs labelled cases: each is a small project that a rule, or a flow between functions, should find or not."""

from __future__ import annotations

from codeloom.operators import code_index, rule_scan, taint
from codeloom.operators.state import snapshot
from codeloom.sources.cases import files_of
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the category of a flow is called among the rules of a case.
FLOW_RULE = "interproc-"


def detections(cases: DataFrame) -> DataFrame:
    """``cases`` with ``detected``: whether one of their ``rules`` found something; and ``failed``: whether the run was cut short.

    Cases of the engine ``graph`` are traced, all as projects of one index; the others are scanned by the bundled rules.
    """
    files = files_of(cases.filter("engine = 'graph'")).select(F.col("id").alias("project"), "path", "content")
    index = snapshot(code_index.index_files(files), "case-index")
    flows, ended = taint.trace(index, stored=True)
    owners = code_index.facts(index, "symbols").select(F.col("id").alias("sink_symbol"), F.col("project").alias("id"))
    traced = flows.select("sink_symbol", "category").join(owners, "sink_symbol").select("id", F.concat(F.lit(FLOW_RULE), "category").alias("rule"))
    # a rule scan knows paths only, so the case's number goes in front
    named = files_of(cases.filter("engine <> 'graph'")).select(F.concat_ws("/", "id", "path").alias("path"), "content")
    # which rules match is all that counts, so no match gets a fingerprint, and the first shuffle has one row a case that has any
    scanned = rule_scan.matches(named).filter("note is null").select(F.substring_index("file", "/", 1).alias("id"), F.col("rule_id").alias("rule"))
    found = traced.unionByName(scanned).groupBy("id").agg(F.collect_set("rule").alias("found"))  # bounded by the number of rules
    hit = F.coalesce(F.arrays_overlap("found", "rules"), F.lit(False))
    return cases.join(found, "id", "left").withColumn("detected", hit).withColumn("failed", (F.col("engine") == "graph") & F.lit(not ended)).drop("found")
