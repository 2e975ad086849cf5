"""Scans text tables for secrets and other patterns and writes a report.

``findings/source=.../severity=...`` (Parquet): one row per fingerprint, with a masked preview instead of what was found, and
``status`` against the findings of an earlier report, if one is given: new, unchanged or resolved.
``summary/source=...`` (JSON lines): per rule the findings of each status, the rows they are in, and ``exit_code``: 1 if one
that is not resolved reaches the threshold.
``sources/source=...`` (JSON lines): how many rows were read and findings stand, and the verdict: FAIL with a new finding that reaches the threshold, WARN with another
new one, else PASS.
``sarif/source=...``: the findings that stand as SARIF documents of bounded size, if the config asks for them.

Every source has a folder of its own, which a run replaces as a whole: a rerun gives the same files' content, and a run that was
stopped is mended by the next.  Texts are read once; only findings are shuffled.
"""

from __future__ import annotations

import logging
import sys

from codeloom.functions import severity
from codeloom.functions.identity import finding_fingerprint
from codeloom.operators import compare
from codeloom.operators.spans import line_matches
from codeloom.sinks import report
from codeloom.sources.tables import table
from jobs.common import Config, main
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("scan_report")
FINDINGS = "severity string, rule_id string, row_id string, line long, preview string, occurrences long, fingerprint string, status string"
SOURCES = "rows long, findings long, resolved long, verdict string"
SUMMARY = "rule_id string, severity string, new long, unchanged long, resolved long, rows long, occurrences long, exit_code long"


def masked(match: Column, shown: int) -> Column:
    """The first characters of what was found, and a star for each other one."""
    return F.rpad(F.substring(match, 1, shown), F.char_length(match), "*")


def findings(spark: SparkSession, rows: DataFrame, source: dict, config: Config) -> DataFrame:
    """The findings of one source, each fingerprint once.

    A null id is an empty one and a null text has no match.  Rows that repeat an id add to ``occurrences``.
    """
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source["id"]]
    rows = rows.select(F.concat_ws("/", *ids).alias("row_id"), F.col(source["text"]).cast("string").alias("text"))
    rules = spark.createDataFrame([(r["rule_id"], r["pattern"], severity.parse(r["severity"])) for r in config["rules"]], "rule_id string, pattern string, severity string")
    found = line_matches(rows, rules, "row_id", "text").groupBy("severity", "rule_id", F.col("id").alias("row_id"), "line", "match").agg(F.count(F.lit(1)).alias("occurrences"))
    file = F.concat(F.lit(source["table"] + "/"), "row_id")
    fingerprint = finding_fingerprint(file, F.col("line"), F.lit("scan"), F.col("rule_id"), F.array("match"))
    preview = masked(F.col("match"), config["shown_characters"])
    return found.select("severity", "rule_id", "row_id", "line", preview.alias("preview"), "occurrences", fingerprint.alias("fingerprint"))


def against(found: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``found`` with ``status``, and those of ``earlier`` that are resolved; a finding that was resolved before is new again."""
    if earlier is None:
        return found.withColumn("status", F.lit("new"))
    known = earlier.filter("status <> 'resolved'").select(*found.columns)
    gone = compare.only_in(known, found, "fingerprint").withColumn("status", F.lit("resolved"))
    old = known.select("fingerprint", F.lit("unchanged").alias("__old"))
    return found.join(old, "fingerprint", "left").select(*found.columns, F.coalesce("__old", F.lit("new")).alias("status")).unionByName(gone)


def summary(found: DataFrame, threshold: str) -> DataFrame:
    """Counts per rule of written findings."""
    here = F.col("status") != "resolved"
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "resolved")]
    rows = F.count_distinct(F.when(here, F.col("row_id"))).alias("rows")
    per_rule = found.groupBy("rule_id", "severity").agg(*counts, rows, F.coalesce(F.sum(F.when(here, F.col("occurrences"))), F.lit(0)).alias("occurrences"))
    reached = (severity.rank(F.col("severity")) >= severity.LEVELS.index(severity.parse(threshold))) & (F.col("new") + F.col("unchanged") > 0)
    return per_rule.withColumn("exit_code", reached.cast("long"))


def verdict(found: DataFrame, rows: int, threshold: str) -> DataFrame:
    """One row about a source: its written findings against the report before."""
    new = F.col("status") == "new"
    reached = severity.rank(F.col("severity")) >= severity.LEVELS.index(severity.parse(threshold))
    none = F.lit(False)
    judged = compare.verdict(F.coalesce(F.bool_or(new & reached), none), none, F.coalesce(F.bool_or(new), none))
    gone = F.col("status") == "resolved"
    return found.agg(F.count_if(~gone).alias("findings"), F.count_if(gone).alias("resolved"), judged.alias("verdict")).withColumn("rows", F.lit(rows).cast("long"))


def read_findings(spark: SparkSession, out: str) -> DataFrame:
    """All findings of a report, with ``source`` and ``severity`` from their folders."""
    return spark.read.schema(f"{FINDINGS}, source string").parquet(f"{out}/findings")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{SUMMARY}, source string").json(f"{out}/summary")


def read_sources(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{SOURCES}, source string").json(f"{out}/sources")


def run(spark: SparkSession, tables: str, out: str, config: Config, baseline: str | None = None) -> int:
    """Scan the configured text tables and write findings and a summary; 1 if a finding reaches the threshold, else 0."""
    if baseline and baseline.rstrip("/") == out.rstrip("/"):
        raise ValueError("the baseline must be another report than the one that is written")
    earlier = read_findings(spark, baseline) if baseline else None
    for source in config["sources"]:
        name = source["table"]
        rows = table(spark, tables, name)
        before = earlier.filter(F.col("source") == name) if earlier is not None else None
        against(findings(spark, rows, source, config), before).write.mode("overwrite").partitionBy("severity").parquet(f"{out}/findings/source={name}")
        own = spark.read.schema(FINDINGS).parquet(f"{out}/findings/source={name}")
        summary(own, config["threshold"]).coalesce(1).write.mode("overwrite").json(f"{out}/summary/source={name}")
        verdict(own, rows.count(), config["threshold"]).coalesce(1).write.mode("overwrite").json(f"{out}/sources/source={name}")
        if config.get("sarif"):
            named = own.filter("status <> 'resolved'").select(F.concat(F.lit(f"{name}/"), "row_id").alias("file"), "line", F.col("rule_id").alias("title"), "severity", "fingerprint")
            report.write_sarif(named, f"{out}/sarif/source={name}", tool="scan_report")
        r = spark.read.schema(SOURCES).json(f"{out}/sources/source={name}").first()
        LOG.info("%s: read %d rows of %s/%s.parquet, wrote %d findings and %d resolved ones to %s: %s", name, r.rows, tables, name, r.findings, r.resolved, out, r.verdict)
    code = read_summary(spark, out).agg(F.max("exit_code")).first()[0] or 0
    LOG.info("exit code %d at threshold %s", code, config["threshold"])
    return code


if __name__ == "__main__":
    sys.exit(main("scan_report", run, baseline="folder of an earlier report to compare with"))
