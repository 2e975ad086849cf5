"""JSON reports of outside scanners, and other JSON text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = "STRUCT<line: INT, col: INT>"
SEMGREP = f"STRUCT<results: ARRAY<STRUCT<path: STRING, check_id: STRING, start: {_PLACE}, extra: STRUCT<message: STRING, severity: STRING>>>, errors: ARRAY<STRING>>"
BANDIT = "STRUCT<results: ARRAY<STRUCT<filename: STRING, line_number: INT, col_offset: INT, test_id: STRING, issue_id: STRING, issue_text: STRING, issue_severity: STRING, issue_confidence: STRING>>, errors: ARRAY<STRING>>"
#: Confidence of a finding by what the scanner says.
BANDIT_CONFIDENCE = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}
SEMGREP_CONFIDENCE = 0.9


def parse_props(events: DataFrame) -> DataFrame:
    """``event_id, k, rejected`` of a JSON text column ``props``; what does not parse is rejected, not dropped."""
    parsed = F.from_json("props", "k LONG", {"mode": "PERMISSIVE"})
    return events.select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("rejected"))


def read_report(reports: DataFrame, scanner: str) -> tuple[DataFrame, DataFrame]:
    """Findings and notes of JSON documents ``reports(report, json)`` of ``semgrep`` or ``bandit``.

    A malformed document or result becomes a note; the others still count.
    """
    schema = {"semgrep": SEMGREP, "bandit": BANDIT}[scanner]
    doc = reports.select("report", F.from_json("json", schema).alias("d"))
    rows = doc.select("report", F.explode("d.results").alias("r"))
    if scanner == "semgrep":
        found = rows.select("report", F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.start.col").alias("column"), F.col("r.check_id").alias("title"), F.col("r.extra.message").alias("description"), F.col("r.extra.severity").alias("raw"), F.lit(SEMGREP_CONFIDENCE).alias("confidence"))
    else:
        level = F.upper("r.issue_confidence")
        confidence = F.when(level == "HIGH", 0.9).when(level == "MEDIUM", 0.7).otherwise(0.5)
        found = rows.select("report", F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), (F.col("r.col_offset") + 1).alias("column"), F.coalesce("r.test_id", "r.issue_id").alias("title"), F.col("r.issue_text").alias("description"), F.col("r.issue_severity").alias("raw"), confidence.alias("confidence"))
    from codeloom.functions.severity import parse_col

    found = found.withColumn("severity", parse_col(F.col("raw"))).drop("raw")
    whole = F.col("file").isNotNull() & F.col("line").isNotNull() & F.col("title").isNotNull()
    bad = found.filter(~whole).select("report", F.lit("malformed result").alias("note"))
    errors = doc.select("report", F.explode("d.errors").alias("e")).select("report", F.concat(F.lit("scanner error: "), F.col("e")).alias("note"))
    broken = doc.filter("d is null or d.results is null").select("report", F.lit("malformed report").alias("note"))
    return found.filter(whole), bad.unionByName(errors).unionByName(broken)
