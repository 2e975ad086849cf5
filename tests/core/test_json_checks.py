"""JSON checks as columns against a plain interpreter of the same schemas."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from typing import Any

import pytest
from codeloom.functions import json_checks
from codeloom.functions.json_checks import MAX_DEPTH, MAX_ITEMS, MAX_VALUES
from codeloom.operators import records
from pyspark.sql import functions as F

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_type(value: Any, name: str) -> bool:
    if name in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, int if name == "integer" else int | float)
    return isinstance(value, _TYPES[name]) and not (name != "boolean" and isinstance(value, bool))


def errors_of(value: Any, schema: dict[str, Any], at: str = "$") -> Iterator[str]:
    """What a value breaks of a schema."""
    if "type" in schema and not is_type(value, schema["type"]):
        yield f"{at}: expected {schema['type']}"
        return
    if "const" in schema and value != schema["const"]:
        yield f"{at}: expected {schema['const']!r}"
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not one of the allowed values"
    if "oneOf" in schema:
        fits = sum(next(errors_of(value, s, at), None) is None for s in schema["oneOf"])
        if fits != 1:
            yield f"{at}: fits {fits} of the alternatives"
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{at}: does not have the expected form"
        if schema.get("visibleContent") and not any(c.isprintable() and not c.isspace() for c in value):
            yield f"{at}: has no visible content"
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 1 << 30):
            yield f"{at}: wrong length"
    if is_type(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        yield f"{at}: out of range"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", MAX_ITEMS):
            yield f"{at}: wrong number of items"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield f"{at}: items repeat"
        for n, v in enumerate(value[:MAX_ITEMS]):
            yield from errors_of(v, schema.get("items", {}), f"{at}[{n}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{at}.{name}: missing"
        for name, v in value.items():
            if name in known:
                yield from errors_of(v, known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{name}: not allowed"


def limit_errors(value: Any) -> Iterator[str]:
    """Whether a document is too deep or has too many values."""
    stack, count = [(value, 1)], 0
    while stack:
        v, depth = stack.pop()
        count += 1
        if depth > MAX_DEPTH:
            yield "$: nested too deep"
            return
        if count > MAX_VALUES:
            yield "$: too many values"
            return
        stack.extend((x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))


def finding_errors(finding: dict[str, Any]) -> Iterator[str]:
    """What a finding breaks beyond its form."""
    order = ["info", "low", "medium", "high", "critical"]
    kinds = [s.get("kind") for s in finding.get("trace", []) if isinstance(s, dict)]
    if finding.get("verdict") == "confirmed":
        if not kinds or kinds[0] != "entrypoint" or kinds[-1] != "sink" or any(k != "propagation" for k in kinds[1:-1]):
            yield "$.trace: goes from an entry point over propagations to a sink"
        if finding.get("impact") in order and finding.get("severity") in order and order.index(finding["severity"]) > order.index(finding["impact"]):
            yield "$.severity: above the impact"
        if "reason" in finding:
            yield "$.reason: not for a confirmed finding"
    elif "impact" in finding:
        yield "$.impact: only for a confirmed finding"


SCHEMA = {
    "type": "object",
    "required": ["a", "odd name"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 0, "maximum": 9},
        "odd name": {"enum": ["x", "y", 3]},
        "t": {"type": "string", "pattern": "^b", "visibleContent": True, "minLength": 2, "maxLength": 4},
        "l": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "number"}},
        "n": {"type": "null"},
        "o": {"oneOf": [{"type": "boolean"}, {"const": "c"}, {"type": "string"}], "properties": {"z": {"type": "object"}}},
        "i": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}}},
    },
}
VALUES = [0, 5, 12, -1, 2.5, 7.0, "x", "y", 3, "b", "bc", "bcdef", "  ", "", None, True, False, [], [1], [1, 1], [1, "a", 2, 3], {}, {"k": "v"}, {"k": 1}, [{"k": "v"}, {}], "c", {"z": 1}]


def plain(text, schema):
    try:
        value = json.loads(text or "", parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
    except (ValueError, RecursionError):
        return ["$: no JSON"]
    found = list(limit_errors(value)) or list(errors_of(value, schema))
    if not found and schema is records.FINDING_SCHEMA:
        found = list(finding_errors(value))
    return sorted(found[:100])


def checked(spark, texts, schema=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, json string")
    out: dict = {str(n): [] for n in range(len(texts))}
    for r in records.validate(docs, schema).collect():
        out[r.doc].append(r.error)
    return [sorted(out[str(n)]) for n in range(len(texts))]


def test_schemas(spark):
    rng = random.Random(5)
    docs = [{k: rng.choice(VALUES) for k in rng.sample([*SCHEMA["properties"], "more"], rng.randint(0, 8))} for _ in range(250)]
    docs += [{"a": 1, "odd name": "x", "t": "bc", "l": [1, 2.5], "n": None, "o": True, "i": [{"k": "v"}]}]
    texts = [json.dumps(d) for d in docs] + ["", "{", None, "[1]", "null", '"s"', '{"a": 1.0, "odd name": 3}', '{"a": "}{][,\\"", "odd name": "x"}']
    assert checked(spark, texts, SCHEMA) == [plain(t, SCHEMA) for t in texts]


def test_limits(spark):
    def nested(n, inner):
        return "[" * n + inner + "]" * n

    texts = [nested(63, "1"), nested(64, "1"), nested(64, ""), nested(65, ""), '{"a":' * 64 + "{}" + "}" * 64, '["' + "[" * 90 + '"]', '["\\"' + "[" * 90 + '"]', "[" + ",".join(["1"] * 50) + "]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(json_checks.limit_errors(F.col("t")).alias("e")).collect()
    assert [r.e for r in rows] == [list(limit_errors(json.loads(t))) for t in texts]
    many = spark.createDataFrame([(texts[-1],)], "t string")
    assert [many.select(json_checks.limit_errors(F.col("t"), max_values=n)).first()[0] for n in (51, 50)] == [[], ["$: too many values"]]


def test_findings(spark):
    rng = random.Random(2)

    def step(kind):
        return {"kind": kind, "location": {"file": rng.choice(["a", " "]) if rng.random() < 0.2 else "a", "line": rng.choice([1, 0]) if rng.random() < 0.2 else 3}, "detail": "d"}

    docs = []
    for _ in range(200):
        d = {"fingerprint": "0" * 16, "title": "t", "verdict": rng.choice(["confirmed", "confirmed", "rejected", "needs_validation"]), "severity": rng.choice(["low", "high"])}
        if d["verdict"] == "confirmed" or rng.random() < 0.2:
            d["impact"] = rng.choice(["info", "medium", "critical"])
        if rng.random() < 0.7:
            d["trace"] = [step(rng.choice(["entrypoint", "propagation", "sink"])) for _ in range(rng.randint(0, 2))] + [step("sink")]
            d["trace"][0]["kind"] = rng.choice(["entrypoint", d["trace"][0]["kind"]])
        if d["verdict"] != "confirmed" or rng.random() < 0.1:
            d["reason"] = "r"
        docs.append(json.dumps(d))
    got = checked(spark, docs)
    assert got == [plain(t, records.FINDING_SCHEMA) for t in docs]
    assert [] in got and len({e for row in got for e in row}) > 6


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', "NaN", '{"a": 01}'])
def test_what_is_no_json(spark, text):
    """Repeated names and signs that JSON lacks are refused."""
    assert checked(spark, [text], {}) == [["$: no JSON"]]
