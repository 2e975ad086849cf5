"""Checks of JSON records: a small schema language, limits, and rules across records.

Documents come as rows ``doc, json``; errors come back as rows, so one bad document
hides no other.
"""

from __future__ import annotations

from typing import Any

from codeloom.functions.json_checks import text_errors
from codeloom.functions.severity import LEVELS
from codeloom.operators.ledger import failing, reference_violations, unsorted_rows
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = {"type": "object", "required": ["file", "line"], "additionalProperties": False, "properties": {"file": {"type": "string", "visibleContent": True}, "line": {"type": "integer", "minimum": 1}}}
_STEP = {"type": "object", "required": ["kind", "location", "detail"], "additionalProperties": False, "properties": {"kind": {"enum": ["entrypoint", "propagation", "sink"]}, "location": _PLACE, "detail": {"type": "string", "visibleContent": True}}}
#: The form of one finding of an audit, by its verdict.
FINDING_SCHEMA: dict[str, Any] = {
    "type": "object",
    "required": ["fingerprint", "title", "verdict", "severity"],
    "properties": {"fingerprint": {"type": "string", "pattern": "^[0-9a-f]{16,64}$"}, "title": {"type": "string", "visibleContent": True, "maxLength": 200}, "verdict": {"enum": ["confirmed", "needs_validation", "rejected"]}, "severity": {"enum": ["info", "low", "medium", "high", "critical"]}, "impact": {"enum": ["info", "low", "medium", "high", "critical"]}, "trace": {"type": "array", "items": _STEP, "minItems": 1}, "reason": {"type": "string", "visibleContent": True}},
    "oneOf": [{"properties": {"verdict": {"const": "confirmed"}}, "required": ["trace", "impact"]}, {"properties": {"verdict": {"const": "needs_validation"}}, "required": ["reason"]}, {"properties": {"verdict": {"const": "rejected"}}, "required": ["reason"]}],
}


def finding_errors(text: Column) -> Column:
    """What a finding of the right form breaks beyond it, as an array of texts."""
    value = F.try_parse_json(text)
    level = F.array(*[F.lit(x) for x in LEVELS])

    def text_of(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "string")

    kinds = F.coalesce(F.transform(F.try_variant_get(value, "$.trace", "array<variant>"), lambda s: F.try_variant_get(s, "$.kind", "string")), F.array().cast("array<string>"))
    whole = (F.size(kinds) > 0) & (F.try_element_at(kinds, F.lit(1)) == "entrypoint") & (F.try_element_at(kinds, F.lit(-1)) == "sink")
    inner = F.forall(F.slice(kinds, F.lit(2), F.greatest(F.size(kinds) - 2, F.lit(0))), lambda k: F.coalesce(k == "propagation", F.lit(False)))
    confirmed = text_of("verdict") == "confirmed"
    above = F.array_position(level, text_of("severity")) > F.array_position(level, text_of("impact"))

    def there(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()

    rules = {
        "$.trace: goes from an entry point over propagations to a sink": confirmed & ~F.coalesce(whole & inner, F.lit(False)),
        "$.severity: above the impact": confirmed & above,
        "$.reason: not for a confirmed finding": confirmed & there("reason"),
        "$.impact: only for a confirmed finding": ~confirmed & there("impact"),
    }
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda e: e.isNotNull())


def validate(documents: DataFrame, schema: dict[str, Any] | None = None) -> DataFrame:
    """``doc, error`` for everything that is wrong with documents ``doc, json`` (at most 100 each); a null document is no JSON."""
    found = text_errors(F.col("json"), FINDING_SCHEMA, finding_errors(F.col("json"))) if schema is None else text_errors(F.col("json"), schema)
    return documents.select(F.col("doc").cast("string").alias("doc"), F.explode(found).alias("error"))


def unit_id(kind: Column, path: Column, scope: Column) -> Column:
    """The id that a coverage unit must have."""
    return F.concat(F.lit("unit-"), F.substring(F.sha2(F.concat_ws("\n", kind, path, scope), 256), 1, 16))


def ledger_errors(units: DataFrame, attempts: DataFrame, snapshot: str) -> DataFrame:
    """``violation, id`` of a coverage ledger.

    ``units(unit, position, kind, path, scope, status, owner)``, ``attempts(unit, attempt, source_snapshot, result)``.
    """
    last = attempts.groupBy("unit").agg(F.max_by("result", "attempt").alias("last"), F.max_by("source_snapshot", "attempt").alias("seen"))
    joined = units.join(last, "unit", "left")
    done = F.col("status") == "complete"
    rows = failing(joined, "unit", {
        "wrong id": F.col("unit") == unit_id(F.col("kind"), F.col("path"), F.col("scope")),
        "unknown status": F.col("status").isin("pending", "in_progress", "complete", "blocked", "excluded"),
        "complete without success": ~done | (F.coalesce("last", F.lit("")) == "success"),
        "stale attempt": ~done | F.col("seen").eqNullSafe(F.lit(snapshot)),
        "no owner": F.coalesce("owner", F.lit("")) != "",
    })
    order = unsorted_rows(units, None, "position", "unit").select(F.lit("not sorted").alias("violation"), F.col("unit").alias("id"))
    stray = reference_violations(units, attempts.select("unit").distinct(), "unit", ("never tried", "attempt without unit", "repeated")).filter("violation = 'attempt without unit'").select("violation", F.col("unit").alias("id"))
    return rows.unionByName(order).unionByName(stray)


def review_errors(findings: DataFrame, reviews: DataFrame, snapshot: str) -> DataFrame:
    """``violation, id``: confirmed findings need a fresh review by somebody else.

    ``findings(fingerprint, verdict, discoverer)``, ``reviews(fingerprint, verifier, source_snapshot)``.
    """
    confirmed = findings.filter("verdict = 'confirmed'")
    joined = confirmed.join(reviews, "fingerprint", "left")
    rows = failing(joined, "fingerprint", {"not reviewed": F.col("verifier").isNotNull(), "own review": F.col("verifier").isNull() | (F.col("verifier") != F.col("discoverer")), "stale review": F.col("verifier").isNull() | (F.col("source_snapshot") == snapshot)})
    stray = reviews.join(findings, "fingerprint", "left_anti").select(F.lit("review without finding").alias("violation"), F.col("fingerprint").alias("id"))
    return rows.unionByName(stray).distinct()


def new_revisions(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs ``json`` whose content is not stored yet, under the hash of their content: ``revision, json``."""
    fresh = runs.select(F.sha2("json", 256).alias("revision"), "json").dropDuplicates(["revision"])
    return fresh.join(stored.select("revision"), "revision", "left_anti")


def history(revisions: DataFrame, latest: DataFrame) -> DataFrame:
    """Revisions with a mark on the latest one of each run."""
    mark = latest.select("run", "revision").withColumn("__m", F.lit(True))
    return revisions.join(mark, ["run", "revision"], "left").withColumn("latest", F.coalesce("__m", F.lit(False))).drop("__m")
