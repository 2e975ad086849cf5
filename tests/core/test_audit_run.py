"""Audit runs: states, owners, evidence, links and revisions against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from codeloom.functions.text import normalize_target
from codeloom.operators import audit_run, lexical
from codeloom.operators.audit_run import ATTEMPT_STATES, REVISIONS, STATES
from codeloom.plans.engine import Engine
from codeloom.sinks import report
from pyspark.sql import functions as F

CHECK = "array<struct<agent: string, paths: array<string>, artifact: string>>"
ATTEMPT = f"status: string, owner: string, wave: int, reviewed: array<string>, checks: {CHECK}, results: array<string>, unresolved: array<string>"
UNITS = f"unit string, status string, owner string, wave int, reviewed array<string>, checks {CHECK}, results array<string>, unresolved array<string>, attempts array<struct<{ATTEMPT}>>"


def plain(unit):
    unit = dict(zip([c.split()[0] for c in ("unit", "status", "owner", "wave", "reviewed", "checks", "results", "unresolved", "attempts")], unit, strict=True))
    names = ("status", "owner", "wave", "reviewed", "checks", "results", "unresolved")
    tries = [dict(zip(names, a, strict=True)) for a in unit["attempts"] or []] + [{n: unit[n] for n in names}]
    out = []
    for n, t in enumerate(tries):
        states = list(STATES) if n == len(tries) - 1 else ATTEMPT_STATES
        if t["status"] not in states:
            out.append("unknown status")
        for k, part in enumerate(("owner", "reviewed", "checks", "unresolved", "results")):
            sign, some = (STATES[t["status"]][k] if t["status"] in states else "*"), bool((t[part] or "").strip() if part == "owner" else t[part])
            out += [f"no {part}"] if sign == "+" and not some else [f"{part} not allowed"] if sign == "-" and some else []
        checked = {p for c in t["checks"] or [] for p in c[1]}
        reviewed = set(t["reviewed"] or [])
        out += [f"no check reads {p}" for p in reviewed - checked] + [f"not counted as reviewed: {p}" for p in checked - reviewed]
        past = tries[:n]
        owners = {p["owner"] for p in past} - {None}
        used = {c[2] for p in past for c in p["checks"] or []} - {None}
        out += ["waves do not grow"] if t["wave"] is None or t["wave"] <= max([0, *(p["wave"] for p in past)]) else []
        out += ["owner comes back"] if t["owner"] in owners else []
        out += ["check of an earlier owner"] if any(c[0] in owners for c in t["checks"] or []) else []
        out += ["artifact comes back"] if any(c[2] in used for c in t["checks"] or []) else []
    return sorted(out)


def test_units(spark):
    rng = random.Random(7)

    def some(values):
        return rng.choice([None, [], [], *[rng.sample(values, rng.randint(1, len(values))) for _ in range(3)]])

    def attempt(states):
        checks = rng.choice([None, [], *[[(rng.choice("abc"), rng.sample(["p", "q", "r"], rng.randint(1, 2)), rng.choice([None, "x", "y", "z"])) for _ in range(rng.randint(1, 2))] for _ in range(3)]])
        reviewed = sorted({p for c in checks or [] for p in c[1]}) if rng.random() < 0.6 else some(["p", "q", "r"])
        return (rng.choice(states), rng.choice([None, " ", "a", "b", "c"]), rng.randint(0, 4), reviewed, checks, some(["f1", "f2"]), some(["why"]))

    units = []
    for i in range(300):
        s, owner, wave, reviewed, checks, results, unresolved = attempt([*STATES, "odd", None])
        units.append((f"u{i}", s, owner, wave, reviewed, checks, results, unresolved, rng.choice([None, [], [attempt([*ATTEMPT_STATES, "planned"]) for _ in range(rng.randint(1, 3))]])))
    units.append(("good", "covered", "c", 2, ["p"], [("c", ["p"], "z")], [], None, [("blocked", "a", 1, ["q"], [("a", ["q"], "x")], None, ["why"])]))
    got: dict = {u[0]: [] for u in units}
    for r in audit_run.unit_errors(spark.createDataFrame(units, UNITS)).collect():
        got[r.id].append(r.violation)
    assert {k: sorted(v) for k, v in got.items()} == {u[0]: plain(u) for u in units}
    assert got["good"] == [] and len({v.split(":")[0].split(" reads ")[0] for vs in got.values() for v in vs}) >= 15


def test_evidence(spark):
    manifest = spark.createDataFrame([("a", 3), ("b", 0)], "path string, lines int")
    places = [("f", "a", 1), ("f", "a", 3), ("f", "a", 4), ("f", "a", 0), ("g", "b", 1), ("g", "c", 1), ("g", None, 1), ("h", "a", None), ("h", "a", 4)]
    got = audit_run.evidence_errors(spark.createDataFrame(places, "id string, file string, line long"), manifest).collect()
    line, file = "line outside the file", "file outside the snapshot"
    assert sorted((r.violation, r.id, r.file or "", r.line) for r in got) == sorted([(line, "f", "a", 4), (line, "f", "a", 0), (line, "g", "b", 1), (file, "g", "c", 1), (file, "g", "", 1), (line, "h", "a", 4)])
    units = spark.createDataFrame([("u", "planned", None, 1, ["a", "x"], [("o", ["x", "y"], None)], None, None, None), ("v", "planned", None, 1, None, None, None, None, None)], UNITS)
    assert sorted((r.id, r.file) for r in audit_run.evidence_errors(audit_run.paths_of(units), manifest).collect()) == [("u", "x"), ("u", "y")]


def test_links(spark):
    units = spark.createDataFrame([(f"u{i}", "candidate", owner, 1, None, None, results, None, None) for i, (owner, results) in enumerate([("a", ["f1", "f2", "f9"]), ("b", ["f1", "f3", "f5"]), ("c", None)])], UNITS)
    findings = spark.createDataFrame([("f1", "confirmed"), ("f2", "confirmed"), ("f3", "confirmed"), ("f4", "rejected"), ("f5", "confirmed")], "fingerprint string, verdict string")
    reviews = spark.createDataFrame([("f1", "a", "c"), ("f2", "a", "a"), ("f2", "a", "c"), ("f3", "c", "d"), ("f8", "a", "c")], "fingerprint string, discoverer string, verifier string")
    got = {(r.violation, r.id) for r in audit_run.link_errors(units, findings, reviews).collect()}
    assert got == {("result without finding", "f9"), ("finding without unit", "f4"), ("review without finding", "f8"), ("reviewed twice", "f2"), ("not reviewed", "f5"), ("reviewed by its discoverer", "f2"), ("discovered by somebody without the unit", "f3")}


def test_revisions(spark):
    def runs(*rows):
        return spark.createDataFrame([(p, f"r{n}", "s", "complete", text, n) for p, text, n in rows], "project string, run string, snapshot string, status string, json string, arrived int")

    kept = spark.createDataFrame([], REVISIONS)
    kept = audit_run.import_runs(kept, runs(("p", "one", 1), ("p", "two", 2), ("p", "one", 3), ("q", "one", 1)))
    assert sorted((r.project, r.run, r.number, r.latest) for r in kept.collect()) == [("p", "r1", 1, True), ("p", "r2", 2, False), ("q", "r1", 1, True)]
    kept = audit_run.import_runs(kept, runs(("p", "three", 5), ("p", "four", 4)))
    assert sorted((r.project, r.run, r.number, r.latest) for r in kept.collect()) == [("p", "r1", 1, False), ("p", "r2", 2, False), ("p", "r4", 3, False), ("p", "r5", 4, True), ("q", "r1", 1, True)]
    page = audit_run.history(kept, "p", 3).collect()
    assert [(r.position, r.run, r.latest, r.has_more) for r in page] == [(0, "r5", True, True), (1, "r4", False, True), (2, "r2", False, True)]
    assert [r.has_more for r in audit_run.history(kept, "p", 4).collect()] == [False] * 4
    assert audit_run.history(kept, "none", 4).collect() == []
    with pytest.raises(ValueError):
        audit_run.history(kept, "p", 0)


def test_engine_verbs(spark, tmp_path):
    e = Engine(spark, "p", f"file://{tmp_path}/s", root="/home/x/p")
    files = spark.createDataFrame([("a.py", "import os\n\ndef run(x):\n    os.system(x)\n\ndef main():\n    run(input())\n\ndef runner():\n    run(1)\n"), ("b.py", "x = hashlib.md5(y)\n")], "path string, content string")
    e.index(files)
    units = spark.createDataFrame([("u", "candidate", "a", 1, ["a.py", "no.py"], [("a", ["a.py", "no.py"], None)], ["f1"], None, None)], UNITS)
    findings = spark.createDataFrame([("f1", "confirmed")], "fingerprint string, verdict string")
    reviews = spark.createDataFrame([("f1", "a", "b")], "fingerprint string, discoverer string, verifier string")
    places = spark.createDataFrame([("f1", "a.py", 10), ("f1", "a.py", 11), ("f1", "b.py", 1)], "id string, file string, line int")
    assert {tuple(r) for r in e.check_audit(units, findings, reviews, places, files).collect()} == {("file outside the snapshot", "u"), ("line outside the file", "f1")}
    assert e.audit_history().collect() == []
    for text in ("one", "two", "one"):
        e.import_audits(spark.createDataFrame([("r", "s", "complete", text, 1)], "run string, snapshot string, status string, json string, arrived int"))
    assert [(r.number, r.latest, r.has_more) for r in e.audit_history(1).collect()] == [(2, False, True)]
    assert [(r.number, r.latest) for r in e.audit_history(2).collect()] == [(2, False), (1, True)]
    found, complete = e.scan_file(files, "/home/x/p/./a.py")
    assert complete and [(r.file, r.title) for r in found.collect()] == [("a.py", "flow to command-injection")]
    assert [r.title for r in e.scan_file(files, "b.py")[0].collect()] == ["python-insecure-hash-function"]
    with pytest.raises(LookupError):
        e.scan_file(files, "c.py")
    assert [(r.name, r.omitted) for r in e.find_symbols("run", 1).collect()] == [("run", 0)]
    assert [(r.name, r.omitted) for r in e.find_symbols("UN", 1).collect()] == [("run", 1)]
    assert [r.omitted for r in e.relationships("run", True, 1).collect()] == [1]
    assert [tuple(r) for r in e.search(files, [r"main\(\):\n +run", "md5", "md5", "no such"]).collect()] == [(r"main\(\):\n +run", "a.py", 6, "main():\n    run"), ("md5", "b.py", 1, "md5")]
    got = e.excerpts(files, "where is hashlib used?").first()
    assert (got.path, got.start_line, got.end_line, got.text) == ("b.py", 1, 1, "1: x = hashlib.md5(y)\n")


@pytest.mark.parametrize(("target", "want"), [("./a/b.py", "a/b.py"), (" a\\b.py:12 ", "a/b.py:12"), ("/r/p/x.py:3", "x.py:3"), ("/r/p", "."), ("name", "name"), (".//./x", "x"), ("a..b", "a..b")])
def test_targets(target, want):
    assert normalize_target(target, "/r/p/") == want


@pytest.mark.parametrize("target", ["", " ", "x" * 513, "é" * 257, "../x", "a/../../x:3", "/r/pq/x", "/etc", "C:/x", "a\nb"])
def test_targets_that_cannot_be(target):
    with pytest.raises(ValueError):
        normalize_target(target, "/r/p")


def test_sarif_shards(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a b.py", "ü/*~.py", "c+d.py"]), rng.randint(-1, 9), f"rule{rng.randint(0, 3)}", rng.choice(["low", "high", "critical", "medium", "info"]), rng.choice([None, "m1", "m2"]), f"f{i}") for i in range(57)]
    df = spark.createDataFrame(rows, "file string, line int, title string, severity string, message string, fingerprint string")
    for _ in range(2):  # written anew
        report.write_sarif(df, f"file://{tmp_path}/s", per_file=20)
    documents = [json.loads(p.read_text()) for k in range(3) for p in sorted((tmp_path / "s" / f"shard={k}").glob("*.txt"))]
    results = [r for d in documents for r in d["runs"][0]["results"]]
    assert [len(d["runs"][0]["results"]) for d in documents] == [20, 20, 17]
    whole = json.loads(report.to_sarif(df))["runs"][0]["results"]
    key = lambda r: r["partialFingerprints"]["primary"]
    assert sorted(results, key=key) == sorted(whole, key=key)
    order = {"error": 0, "warning": 1, "note": 2}
    assert [order[r["level"]] for r in results] == sorted(order[r["level"]] for r in results)
    for d in documents:
        driver = d["runs"][0]["tool"]["driver"]
        assert [r["id"] for r in driver["rules"]] == sorted({r["ruleId"] for r in d["runs"][0]["results"]}) and d["version"] == "2.1.0" and d["$schema"]


def test_excerpts(spark):
    texts = ["", None, "one\r\ntwo\n", "\n" * 5, "x" * 3000, "\n".join(f"line {i}" for i in range(100)), "\n".join(("word " if i in (30, 60) else "") + "y" * 90 for i in range(100)) + "\n", "é" * 1300 + "\nword"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", lexical.excerpt(F.col("t"), ["word"]).alias("e")).orderBy("n").collect()
    for (_, got), text in zip(rows, texts, strict=True):
        lines = [x.removesuffix("\r") for x in (text or "").split("\n")]
        lines = lines[:-1] if lines[-1] == "" else lines
        hits = [i for i, x in enumerate(lines) if "word" in x]
        first = max(0, (hits[-1] if hits else 0) - 8)
        want, n = "", 0
        for i, x in enumerate(lines[first : first + 40]):
            if len((want + f"{first + i + 1}: {x}\n").encode()) > 2500:
                break
            want, n = want + f"{first + i + 1}: {x}\n", n + 1
        assert (got is None) == (n == 0)
        assert got is None or tuple(got) == (first + 1, first + n, want)
