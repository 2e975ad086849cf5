"""Rule scans of source trees: files to findings and notes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from codeloom.functions.identity import finding_fingerprint
from codeloom.functions.rules import BUNDLED, load, scan_text
from codeloom.functions.text import language
from codeloom.operators.spans import first_per
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FILE_BYTES = 10 << 20
#: Texts that a task remembers the matches of, and their longest: copies of a small file are matched once a task.
KNOWN_TEXTS, KNOWN_CHARS = 1024, 8192
_FIELDS = {"rule_id": pa.string(), "severity": pa.string(), "message": pa.string(), "line": pa.int32(), "column": pa.int32(), "category": pa.string(), "confidence": pa.float64(), "match": pa.string(), "note": pa.string()}


def _scan_batches(rules: list[dict[str, Any]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(rules)
        # matches follow from text and language; only notes have the path in front
        known = lru_cache(KNOWN_TEXTS)(lambda text, lang: scan_text("", text, lang, loaded))
        for batch in batches:
            rows: list[dict[str, Any]] = []
            for path, text, lang in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if text is None:
                    found, notes = [], [f"{path}: too large or unreadable"]
                elif len(text) <= KNOWN_CHARS:
                    found, notes = known(text, lang)
                    notes = [path + n for n in notes]
                else:
                    found, notes = scan_text(path, text, lang, loaded)
                rows += [{"file": path} | {k: f.get(k) for k in _FIELDS} for f in found]
                rows += [{"file": path, "note": n} for n in notes]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"file": pa.string()} | _FIELDS))

    return run


def distinct_findings(found: DataFrame) -> DataFrame:
    """Findings with each fingerprint once: of several the first by file, line and column, whichever of these there are."""
    order = [F.col(c) for c in ("file", "line", "column") if c in found.columns]
    return first_per(found, ["fingerprint"], *order)


def rule_reach(found: DataFrame) -> DataFrame:
    """Per rule the files it has findings in, and the findings: ``rule_id, files, hits``."""
    return found.groupBy("rule_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("hits"))


def matches(files: DataFrame, rules: list[dict[str, Any]] | None = None) -> DataFrame:
    """What the rules match in ``files(path, content)``, in one pass that shuffles nothing; rows with a ``note`` are no matches."""
    rules = BUNDLED if rules is None else rules
    load(rules)  # errors belong to the caller, not to tasks
    rows = files.select("path", F.when(F.octet_length("content") <= MAX_FILE_BYTES, F.col("content")), language(F.col("path")).alias("language"))
    schema = "file string, rule_id string, severity string, message string, line int, column int, category string, confidence double, match string, note string"
    return rows.mapInArrow(_scan_batches(rules), schema)


def scan(files: DataFrame, rules: list[dict[str, Any]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, each fingerprint once, and notes of ``files(path, content)``."""
    out = matches(files, rules)
    evidence = F.array(F.concat_ws(":", "line", "column"), F.col("match"))
    found = out.filter("note is null").drop("note").withColumn("title", F.col("rule_id")).withColumn("evidence", evidence)
    marked = found.withColumn("fingerprint", finding_fingerprint(F.col("file"), F.col("line"), F.col("category"), F.col("title"), F.col("evidence")))
    return distinct_findings(marked), out.filter("note is not null").select("file", "note")
