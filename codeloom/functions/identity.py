"""Stable SHA-256 identities of JSON key tuples, as columns and in Python.

The identity of a tuple is the SHA-256, in hex, of its compact JSON.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The escapes of JSON strings that have a short form.
_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_CONTROL = [c for c in range(32) if chr(c) not in "\b\f\n\r\t"]


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def identity(value: Any) -> str:
    """Identity of a JSON value; tuples are arrays, and maps are sorted by key."""
    return hashlib.sha256(_ENCODER.encode(value).encode()).hexdigest()


def json_string(text: Column) -> Column:
    """A string as a JSON string literal, with lower-case escapes of control characters."""
    out = text
    for raw, escaped in _SHORT:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for c in _CONTROL:
        rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    out = F.when(out.rlike("[\\x00-\\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_array(*parts: Column) -> Column:
    """A JSON array of parts that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_strings(values: Column) -> Column:
    """An array of strings as a JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(values, json_string)), F.lit("]"))


def identity_sql(*parts: Column) -> Column:
    """Identity of a tuple whose parts are JSON already: ``json_string``, casts of integers, ``json_strings``."""
    return F.sha2(json_array(*parts), 256)


def finding_fingerprint(file: Column, line: Column, category: Column, title: Column, evidence: Column) -> Column:
    """Identity of a finding: severity, confidence and description don't count."""
    return identity_sql(json_string(F.replace(file, F.lit("\\"), F.lit("/"))), line.cast("string"), json_string(category), json_string(title), json_strings(evidence))
