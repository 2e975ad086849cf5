"""Findings as JSON, SARIF 2.1.0, terminal text and Markdown.

Rendering is for people and tools that read one document; ``write_json`` and ``write_sarif`` write any number of
findings, as a table of JSON lines and as documents of bounded size.
"""

from __future__ import annotations

import json
from typing import Any

from codeloom.functions.severity import LEVELS, SARIF_LEVELS, sarif_level
from codeloom.functions.text import file_uri
from codeloom.operators.prefix import ordinals
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLORS = {"critical": 35, "high": 31, "medium": 33, "low": 36, "info": 37}


def _rows(findings: DataFrame) -> list[dict[str, Any]]:
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    return [r.asDict(recursive=True) for r in findings.orderBy(F.desc(order), "file", "line", "title").toLocalIterator()]


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def to_json(findings: DataFrame, outcome: str = "complete", notes: list[str] | None = None) -> str:
    return json.dumps({"outcome": outcome, "notes": notes or [], "findings": _rows(findings)}, indent=2, ensure_ascii=False, default=str)


def to_sarif(findings: DataFrame, tool: str = "codeloom", version: str = "0.1.0") -> str:
    results, rules = [], {}
    for f in _rows(findings):
        rules.setdefault(f["title"], {"id": f["title"], "shortDescription": {"text": f.get("message") or f["title"]}})
        place = {"artifactLocation": {"uri": file_uri(f["file"])}, "region": {"startLine": max(1, f["line"])}}
        results.append({"ruleId": f["title"], "level": SARIF_LEVELS[f["severity"]], "message": {"text": f.get("message") or f["title"]}, "locations": [{"physicalLocation": place}], "partialFingerprints": {"primary": f.get("fingerprint")}})
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": list(rules.values())}}, "results": results}]}, indent=2, ensure_ascii=False)


def _file_uri(path: Column) -> Column:
    """``file_uri`` of a column: every byte but letters, digits, ``_.-~`` and slashes as its code."""
    out = F.url_encode(path)
    for raw, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(raw), F.lit(wanted))
    return F.concat(F.lit("file:///"), out)


def write_sarif(findings: DataFrame, path: str, tool: str = "codeloom", version: str = "0.1.0", per_file: int = 5000) -> None:
    """Any number of findings as SARIF documents of at most ``per_file`` results each, one a folder ``shard=...`` of ``path``.

    Results are in the order of ``to_sarif``, numbered by prefix sums, so no task holds more than a document.  A null message is the title.
    """
    worst = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    columns = {c: F.col(c) for c in ("file", "line", "title", "severity", "fingerprint")} | {"message": F.coalesce("message", "title") if "message" in findings.columns else F.col("title")}
    rows = findings.select(*[c.alias(n) for n, c in columns.items()])
    order = [F.desc(worst), F.col("file"), F.col("line"), F.col("title"), F.col("fingerprint")]
    text = lambda c: F.struct(c.alias("text"))
    place = F.struct(F.struct(F.struct(_file_uri(F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line").cast("long"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("title").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), text(F.col("message")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    numbered = ordinals(rows, [], order, "n").select(F.floor((F.col("n") - 1) / per_file).cast("long").alias("shard"), "n", result.alias("result"), F.struct(F.col("title").alias("id"), F.col("message").alias("text")).alias("rule"))
    shards = numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("n", "result"))).alias("results"), F.array_sort(F.collect_set("rule")).alias("rules"))
    rules = F.transform("rules", lambda r: F.struct(r["id"].alias("id"), text(r["text"]).alias("shortDescription")))
    first = F.filter(rules, lambda r, n: (n == 0) | (F.get(rules, n - 1)["id"] != r["id"]))  # a rule once, with its first message
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), first.alias("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.transform("results", lambda r: r["result"]).alias("results"))
    document = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    shards.select("shard", F.to_json(document).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def to_terminal(findings: DataFrame, color: bool = True) -> str:
    lines = []
    for f in _rows(findings):
        text = "".join(c if c.isprintable() else "�" for c in f"{f['file']}:{f['line']} {f['title']}")
        label = f["severity"].upper()
        lines.append(f"\x1b[{_COLORS[f['severity']]}m{label:8}\x1b[0m {text}" if color else f"{label:8} {text}")
    return "\n".join([*lines, f"{len(lines)} findings"])


def escape_markdown(text: str) -> str:
    out = "".join("\\" + c if c in "\\`*_{}[]()#+-.!|" else c for c in text)
    return " ".join(out.replace("<", "&lt;").replace(">", "&gt;").split())


def to_markdown(findings: DataFrame, coverage: DataFrame | None = None) -> str:
    out = ["# Report", ""]
    if coverage is not None:
        cols = coverage.columns
        out += ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *("| " + " | ".join(escape_markdown(str(v)) for v in r) + " |" for r in coverage.toLocalIterator()), ""]
    for f in _rows(findings):
        out += [f"## {escape_markdown(f['title'])}", "", f"{f['severity']}, {escape_markdown(f['file'])}:{f['line']}", "", "```json", json.dumps(f, ensure_ascii=False, default=str), "```", ""]
    return "\n".join(out)


def artifact_descriptors(documents: DataFrame) -> DataFrame:
    """``name, sha256, bytes`` of documents ``name, json``."""
    return documents.select("name", F.sha2("json", 256).alias("sha256"), F.octet_length("json").alias("bytes"))
