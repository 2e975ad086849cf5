"""Audit runs: folders of four bounded JSON documents, read into tables and written to new folders."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = ("run", "coverage", "findings", "reviews")
MAX_BYTES = 2 << 20
RUN_FIELDS = ("run", "project", "source_snapshot", "started", "tool", "scope")
COVERAGE = "unit string, position int, kind string, path string, scope string, status string, owner string, attempts array<struct<attempt: int, source_snapshot: string, result: string>>"
REVIEWS = "fingerprint string, verifier string, source_snapshot string, method string, observed_result string"


def read_documents(folder: str) -> dict[str, Any]:
    """The documents of a run; an error names what is missing, too large, a link or no JSON."""
    out, total = {}, 0
    for name in DOCUMENTS:
        path = Path(folder) / f"{name}.json"
        if path.is_symlink() or not path.is_file():
            raise ValueError(f"{path} is no plain file")
        size = path.stat().st_size
        total += size
        if size > MAX_BYTES or total > MAX_BYTES:
            raise ValueError("the documents of a run have at most 2 MiB together")
        try:
            out[name] = json.loads(path.read_text("utf-8"))
        except ValueError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
    unknown = set(out["run"]) - set(RUN_FIELDS)
    if unknown or "run" not in out["run"] or "source_snapshot" not in out["run"]:
        raise ValueError(f"the run has unknown or missing fields: {sorted(unknown)}")
    return out


def tables(spark: SparkSession, documents: dict[str, Any]) -> dict[str, DataFrame]:
    """``coverage``, ``findings`` (as ``doc, json``) and ``reviews`` of a run."""

    def rows(items: list[dict[str, Any]], schema: str) -> DataFrame:
        parsed = spark.createDataFrame([(json.dumps(x),) for x in items], "j string").select(F.from_json("j", schema).alias("r"))
        return parsed.select("r.*")

    found = [(str(f.get("fingerprint")), json.dumps(f, sort_keys=True)) for f in documents["findings"]]
    return {"coverage": rows(documents["coverage"], COVERAGE), "findings": spark.createDataFrame(found, "doc string, json string"), "reviews": rows(documents["reviews"], REVIEWS)}


def write_new(folder: str, documents: dict[str, Any]) -> None:
    """Write a run to a folder that must not exist yet."""
    target = Path(folder)
    target.mkdir(parents=True)
    for name in DOCUMENTS:
        (target / f"{name}.json").write_text(json.dumps(documents[name], indent=2, sort_keys=True, ensure_ascii=False) + "\n", "utf-8")


def new_run(folder: str, run: str, project: str, source_snapshot: str) -> dict[str, Any]:
    """Begin a run: a folder with empty documents."""
    documents = {"run": {"run": run, "project": project, "source_snapshot": source_snapshot}, "coverage": [], "findings": [], "reviews": []}
    write_new(folder, documents)
    return documents
