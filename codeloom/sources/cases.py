"""Labelled benchmark cases, checked before use."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, family string, split string, class string, positive boolean, rules array<string>, engine string, entrypoint string, files map<string,string>, rationale string"


def check(doc: dict[str, Any]) -> list[dict[str, Any]]:
    """The cases of a corpus document; a ValueError says what is wrong."""
    if doc.get("schema_version") != 1 or not isinstance(doc.get("cases"), list):
        raise ValueError("a corpus has schema_version 1 and a list of cases")
    seen, split_of = set(), {}
    for c in doc["cases"]:
        if not c.get("id") or c["id"] in seen:
            raise ValueError(f"case ids are unique and not empty: {c.get('id')!r}")
        seen.add(c["id"])
        if c.get("split") not in ("development", "holdout"):
            raise ValueError(f"{c['id']}: unknown split")
        if split_of.setdefault(c.get("family"), c["split"]) != c["split"]:
            raise ValueError(f"{c['id']}: a family spans splits")
        if not isinstance(c.get("positive"), bool) or not c.get("files"):
            raise ValueError(f"{c['id']}: a case has a truth value and files")
        if any(p.startswith("/") or "\\" in p or ".." in p.split("/") for p in c["files"]):
            raise ValueError(f"{c['id']}: a path is not portable")
        if c.get("engine", "rules") == "graph" and c.get("entrypoint") not in c["files"]:
            raise ValueError(f"{c['id']}: a graph case has an entry point among its files")
    return doc["cases"]


def load(spark: SparkSession, text: str) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(c.get(n, "rules" if n == "engine" else None) for n in names) for c in check(json.loads(text))], SCHEMA)


def files_of(cases: DataFrame) -> DataFrame:
    """One row per file: ``id, path, content``."""
    return cases.select("id", F.explode("files").alias("path", "content"))
