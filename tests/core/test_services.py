"""State, sources, reports, jobs, records, streams and the engine's verbs."""

from __future__ import annotations

import json
import subprocess

import pytest
from codeloom.functions import classify, identity, rules, severity, text
from codeloom.operators import jobs, records, state
from codeloom.plans.engine import CONTEXT_KEY, Engine
from codeloom.sinks import report
from codeloom.sources import cases, git, rule_folder, scanner_json, tree
from codeloom.streaming import lifecycle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_identities_agree(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=12), min_size=20, max_size=40))
    def run(values):
        rows = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "s string, n int")
        got = rows.select("s", "n", identity.identity_sql(identity.json_string(F.col("s")), F.col("n").cast("string"), identity.json_strings(F.array("s", F.lit("a\x1b")))).alias("i")).collect()
        assert all(r.i == identity.identity([r.s, r.n, [r.s, "a\x1b"]]) for r in got)

    run()


def test_scalars(spark):
    df = spark.createDataFrame([("a/b.py", "é x\n  y  z\nlast", "pkg.mod.name")], "path string, t string, name string")
    r = df.select(
        text.language(F.col("path")).alias("lang"), text.collapse_space(F.col("t"), 5).alias("c"), text.last_segment(F.col("name")).alias("last"), text.parent_scope(F.col("name")).alias("up"),
        text.span_line(F.col("t"), F.lit(6)).alias("line"), text.span_column(F.col("t"), F.lit(2)).alias("col"), text.line_window(F.col("t"), F.lit(3), 1, 5).alias("w"), text.escape_markdown(F.lit("a*b<c>\nd")).alias("md"),
        severity.parse_col(F.lit("ERROR")).alias("sev"), text.portable_path(F.lit("a/../b")).alias("pp"), text.is_hex(F.lit("0" * 40), 40, 64).alias("hex"), text.normalize_path(F.lit("./a\\b")).alias("np"),
    ).first()
    assert (r.lang, r.c, r.last, r.up, r.line, r.col, r.w, r.md, r.sev, r.pp, r.hex, r.np) == ("python", "é x y", "name", "pkg.mod", 2, 4, ["  y  z", "last"], "a\\*b&lt;c&gt; d", "high", False, True, "a/b")
    assert text.query_words("The é-cat, a cat!") == ["the", "cat"] and text.file_uri("a b/ü") == "file:///a%20b/%C3%BC"
    assert classify.sink_type("std::fs::open") == "path-traversal" and classify.sink_type("subprocess.run") is None and classify.is_source("req.body[0]") and not classify.is_source("req.bodyguard")


def test_lifecycle_of_scans(spark):
    schema = "fingerprint string, file string, severity string, scan_id string, created_at string, resolved_at string"
    now = spark.createDataFrame([], schema)
    seen = []
    for n, batch in enumerate([["a", "b"], ["a"], ["a", "b"]]):
        found = spark.createDataFrame([(f, f"{f}.py", "high") for f in batch], "fingerprint string, file string, severity string")
        scanned = spark.createDataFrame([("a.py",), ("b.py",)], "file string")
        now = state.snapshot(state.apply_scan(now, found, scanned, f"s{n}", F.lit(f"t{n}")), "t")
        seen.append({r.fingerprint: (r.created_at, r.resolved_at) for r in now.collect()})
    assert seen == [{"a": ("t0", None), "b": ("t0", None)}, {"a": ("t0", None), "b": ("t0", "t1")}, {"a": ("t0", None), "b": ("t0", None)}]
    kept = state.apply_scan(now, now.filter("false").select("fingerprint", "file", "severity"), spark.createDataFrame([("a.py",)], "file string"), "s", F.lit("t9"), complete=False)
    assert kept.filter("resolved_at is not null").count() == 0


def test_versions_swap_once(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.replace(spark.range(2), 0) == 1
    assert t.replace(spark.range(3), 1) == 2 and t.read().count() == 3 and t.read(1).count() == 2
    with pytest.raises(RuntimeError):
        t.replace(spark.range(4), 1)


def test_tree_and_git(spark, tmp_path):
    for path, data in {"a.py": b"x = 1", "src/b.py": b"y", "node_modules/c.js": b"z", "p.png": b"\x89", "bad.py": b"\xff\xfe", "out/d.py": b"d"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_bytes(data)
    files = tree.read_tree(spark, f"file://{tmp_path}", ignore=["out/", "# note"])
    assert {r.path: r.content for r in files.collect()} == {"a.py": "x = 1", "src/b.py": "y", "bad.py": None}
    good, rest = tree.within_budget(files, count=1)
    assert [r.path for r in good.collect()] == ["a.py"] and {r.path: r.reason for r in rest.collect()} == {"bad.py": "not UTF-8", "src/b.py": "too many files"}
    assert tree.only_paths(files, spark.createDataFrame([("a.py",), ("a.py",)], "path string")).count() == 1
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "a.py", "src", "bad.py")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2")
    (tmp_path / "src/b.py").unlink()
    got = {r.path: r.status for r in git.changes(spark, str(tmp_path)).collect()}
    assert got["a.py"] == "changed" and got["src/b.py"] == "deleted" and got["p.png"] == "changed"
    assert {r.path: r.content for r in git.tree_at(spark, str(tmp_path), "HEAD").collect()} == {"a.py": "x = 1", "src/b.py": "y", "bad.py": None}
    with pytest.raises(subprocess.CalledProcessError):
        git.resolve_ref(str(tmp_path), "nothing")


def test_scanner_reports(spark):
    semgrep = {"results": [{"path": "a.py", "check_id": "r", "start": {"line": 3, "col": 2}, "extra": {"message": "m", "severity": "ERROR"}}, {"path": "b.py"}], "errors": ["e"]}
    bandit = {"results": [{"filename": "a.py", "line_number": 1, "col_offset": 4, "test_id": "B1", "issue_text": "t", "issue_severity": "LOW", "issue_confidence": "MEDIUM"}]}
    found, notes = scanner_json.read_report(spark.createDataFrame([("s", json.dumps(semgrep)), ("x", "{")], "report string, json string"), "semgrep")
    assert [(r.file, r.line, r.column, r.severity, r.confidence) for r in found.collect()] == [("a.py", 3, 2, "high", 0.9)]
    assert sorted(r.note for r in notes.collect()) == ["malformed report", "malformed result", "scanner error: e"]
    found, _ = scanner_json.read_report(spark.createDataFrame([("b", json.dumps(bandit))], "report string, json string"), "bandit")
    assert [(r.column, r.title, r.confidence) for r in found.collect()] == [(5, "B1", 0.7)]


def test_reports(spark):
    df = spark.createDataFrame([("a b.py", 3, "r1", "high", "m", "f1"), ("c.py", 1, "r2", "info", "n\x1b", "f2")], "file string, line int, title string, severity string, message string, fingerprint string")
    sarif = json.loads(report.to_sarif(df))
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["error", "note"] and sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "file:///a%20b.py"
    assert json.loads(report.to_json(df))["findings"][0]["title"] == "r1" and report.to_terminal(df, color=False).splitlines()[0].startswith("HIGH")
    assert "r1" in report.to_markdown(df, df.select("file")) and severity.threshold_exit(df, "high").first().exit_code == 1 and severity.threshold_exit(df, "critical").first().exit_code == 0


def test_jobs(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    store = jobs.Jobs(spark, f"file://{tmp_path}/jobs")
    job = store.create("j", "d1", files)
    running = store.move(job, "running")
    with pytest.raises(RuntimeError):
        store.move(job, "cancelled")
    with pytest.raises(ValueError):
        store.move(running, "pending")
    assert [r.path for r in jobs.pending(files, files.filter("path = 'a'"), 1).collect()] == ["b"]
    paused = store.move(running, "paused", done=1)
    assert store.resume(paused, "d1", files.orderBy(F.desc("path"))).state == "running"
    assert store.resume(store.move(store.all()["j"], "paused"), "d2", files).state == "stale"
    assert jobs.manifest_identity(files) != jobs.manifest_identity(files.limit(2))


def test_records(spark):
    step = lambda k: {"kind": k, "location": {"file": "a", "line": 1}, "detail": "d"}
    good = {"fingerprint": "0" * 16, "title": "t", "verdict": "confirmed", "severity": "low", "impact": "high", "trace": [step("entrypoint"), step("sink")]}
    bad = [good | {"severity": "critical"}, good | {"trace": [step("sink")]}, good | {"fingerprint": "x"}, {k: v for k, v in good.items() if k != "impact"}, good | {"title": " "}]
    docs = spark.createDataFrame([("good", json.dumps(good)), *((f"bad{n}", json.dumps(b)) for n, b in enumerate(bad)), ("none", "{")], "doc string, json string")
    assert {r.doc for r in records.validate(docs).collect()} == {"none", *(f"bad{n}" for n in range(len(bad)))}
    units = spark.createDataFrame([("u1", 1, "k", "p", "s", "complete", "me"), ("u0", 2, "k", "p", "s", "odd", "")], "unit string, position int, kind string, path string, scope string, status string, owner string")
    tries = spark.createDataFrame([("u1", 1, "old", "success"), ("u9", 1, "new", "success")], "unit string, attempt int, source_snapshot string, result string")
    got = {(r.violation, r.id) for r in records.ledger_errors(units, tries, "new").collect()}
    assert {("stale attempt", "u1"), ("unknown status", "u0"), ("no owner", "u0"), ("not sorted", "u0"), ("attempt without unit", "u9"), ("wrong id", "u1")} <= got
    findings = spark.createDataFrame([("f1", "confirmed", "a"), ("f2", "confirmed", "a"), ("f3", "rejected", "a")], "fingerprint string, verdict string, discoverer string")
    reviews = spark.createDataFrame([("f1", "a", "new"), ("f9", "b", "new")], "fingerprint string, verifier string, source_snapshot string")
    assert {(r.violation, r.id) for r in records.review_errors(findings, reviews, "new").collect()} == {("own review", "f1"), ("not reviewed", "f2"), ("review without finding", "f9")}
    runs = spark.createDataFrame([("{}",), ("{}",), ("[]",)], "json string")
    first = records.new_revisions(spark.createDataFrame([], "revision string"), runs)
    assert first.count() == 2 and records.new_revisions(first, runs).count() == 0


def test_cases(spark):
    case = {"id": "a", "family": "f", "split": "development", "class": "xss", "positive": True, "rules": ["r"], "files": {"a.py": "x"}}
    assert cases.files_of(cases.load(spark, json.dumps({"schema_version": 1, "cases": [case]}))).count() == 1
    for wrong in ({"id": ""}, {"split": "x"}, {"files": {}}, {"files": {"../a": ""}}, {"engine": "graph"}):
        with pytest.raises(ValueError):
            cases.check({"schema_version": 1, "cases": [case | wrong]})


def test_stream_of_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(n, *rows):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(dict(zip(("scan", "file", "severity", "fingerprint"), r, strict=True))) + "\n" for r in rows))

    def run():
        lifecycle.run_available(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", f"file://{tmp_path}/cp").awaitTermination()
        return {r.fingerprint: (r.first_seen, r.last_seen, r.scans) for r in lifecycle.current(spark, f"file://{tmp_path}/state").collect()}

    add(1, (1, "a", "low", "x"), (1, "b", "low", "y"))
    assert run() == {"x": (1, 1, 1), "y": (1, 1, 1)}
    add(2, (2, "a", "high", "x"))
    assert run() == {"x": (1, 2, 2), "y": (1, 1, 1)}
    assert run() == {"x": (1, 2, 2), "y": (1, 1, 1)}
    add(3, (9, "c", "low", "x"), (9, "c", "low", "x"), (1, "b", "low", "y"))
    assert run() == {"x": (1, 9, 3), "y": (1, 1, 1)}
    x = {r.fingerprint: r for r in lifecycle.current(spark, f"file://{tmp_path}/state").collect()}["x"]
    assert (x.file, x.severity, x.reopened, x.sightings) == ("c", "low", 1, 4)


def test_engine(spark, tmp_path):
    bad = "import os\n\ndef run(x):\n    os.system(x)\n\ndef main():\n    run(input())\n"
    good = bad.replace("os.system(x)", "print(x)")

    def files(code):
        return spark.createDataFrame([("a.py", code)], "path string, content string")

    e = Engine(spark, "p", f"file://{tmp_path}/s")
    e.index(files(bad))
    assert e.status().first().complete and [r.name for r in e.find_symbols("RUN").collect()] == ["run"]
    assert e.relationships("run", callers=True).count() == 1
    flows, complete = e.trace("a.py")
    assert complete and flows.count() == 1
    assert "direct neighbour" in {x for r in e.context("main").collect() for x in r.reasons}
    e.create_baseline(files(bad))
    assert e.verify(files("\n" + bad))[0] == "PASS"
    assert e.verify(files(good))[0] == "PASS"
    verdict, found = e.verify(files(bad))
    assert verdict == "FAIL" and {r.finding_status for r in found.collect()} == {"regressed"}
    assert e.verify(files("def ("))[0] == "WARN"
    e.create_baseline(files(bad + "\nimport hashlib\nx = hashlib.md5(run)\n"))
    assert [(r.title, r.severity, r.omitted) for r in e.findings(limit=1).collect()] == [("flow to command-injection", "high", 1)]
    assert [(r.title, r.omitted) for r in e.findings("HASH").collect()] == [("python-insecure-hash-function", 0)]
    assert e.findings("hash", severity_from="high").count() == 0 == e.findings(status="resolved").count()
    assert [tuple(r) for r in e.reach_of_rules(files("x = hashlib.md5(y)\nz = hashlib.md5(x)\n")).collect()] == [("python-insecure-hash-function", 1, 2)]
    shown = e.explain(found, files(bad)).first()
    assert shown.symbol == "run" and "    os.system(x)" in shown.excerpt
    assert e.tidy() > 0 and e.tidy() == 0 and e.findings().count() == 2


def test_command_line(tmp_path, capsys):
    from codeloom.__main__ import main, parser

    assert main(["rules"]) == 0 and len(capsys.readouterr().out.splitlines()) == 22
    args = parser().parse_args(["--state", "s", "scan", "x", "--format", "sarif"])
    assert (args.verb, args.path, args.format, args.threshold) == ("scan", "x", "sarif", "high")
    with pytest.raises(SystemExit):
        parser().parse_args(["diff", "x"])


def test_audit_runs(spark, tmp_path):
    from codeloom.sources import audit

    docs = audit.new_run(f"{tmp_path}/r", "r1", "p", "snap")
    with pytest.raises(FileExistsError):
        audit.new_run(f"{tmp_path}/r", "r1", "p", "snap")
    docs["coverage"] = [{"unit": "u1", "position": 1, "status": "complete", "attempts": [{"attempt": 1, "source_snapshot": "snap", "result": "success"}]}]
    docs["findings"] = [{"fingerprint": "f", "title": "t"}]
    audit.write_new(f"{tmp_path}/s", docs)
    t = audit.tables(spark, audit.read_documents(f"{tmp_path}/s"))
    assert t["coverage"].select(F.explode("attempts.result")).first()[0] == "success" and t["reviews"].count() == 0
    assert records.validate(t["findings"]).count() >= 2
    (tmp_path / "s/run.json").write_text('{"run": "r", "source_snapshot": "x", "odd": 1}')
    with pytest.raises(ValueError, match="odd"):
        audit.read_documents(f"{tmp_path}/s")


def test_nested_ignore_files(spark, tmp_path):
    texts = {".gitignore": "*.tmp\n/top.py\n", "top.py": "1", "x.tmp": "2", "a/top.py": "3", "a/.gitignore": "made/\n!keep.tmp\nb.py\n", "a/keep.tmp": "4", "a/other.tmp": "5", "a/made/c.py": "6", "a/deep/b.py": "7", "b.py": "8", "ab/b.py": "9", "a/__init__.py": "10", "_in/x.py": "11", "_in/y.tmp": "12", "__pycache__/z.py": "13"}
    for path, text_ in texts.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(text_)
    assert {r.path for r in tree.read_tree(spark, f"file://{tmp_path}").collect()} == {"a/top.py", "a/keep.tmp", "b.py", "ab/b.py", "a/__init__.py", "_in/x.py"}


def test_rule_folders(spark, tmp_path):
    rule = "rules:\n  - id: {}\n    message: m\n    severity: INFO\n    languages: [regex]\n    pattern-regex: x\n"
    for path, name in {"b.yml": "two", "a/z.yaml": "one", "c.txt": "none"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(rule.format(name))
    found = rule_folder.read_rules(spark, f"file://{tmp_path}")
    assert [r["id"] for r in found] == ["one", "two"] and all(n is not None for _, n in rules.load(found))
    (tmp_path / "d.yml").write_text("- no mapping")
    with pytest.raises(rules.RuleError, match="d.yml"):
        rule_folder.read_rules(spark, f"file://{tmp_path}")
    (tmp_path / "none").mkdir()
    with pytest.raises(rules.RuleError):
        rule_folder.read_rules(spark, f"file://{tmp_path}/none")


def test_maps_and_manifests(spark):
    rows = [({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, True), ({"a": "1"}, {"a": "2"}, False), ({"a": None}, {"a": None}, True), ({}, {}, True), (None, None, True), (None, {}, False)]
    df = spark.createDataFrame(rows, "a map<string, string>, b map<string, string>, want boolean")
    assert all(r.got == r.want for r in df.select(state.same_map(F.col("a"), F.col("b")).alias("got"), "want").collect())
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None)], "path string, hash string")
    two = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", None), ("e", "5")], "path string, hash string")
    assert {r.path for r in state.manifest_mismatches(one, two).collect()} == {"b", "c"}


def test_remembered_context(spark, tmp_path):
    e = Engine(spark, "p", f"file://{tmp_path}/s")
    assert e.recall("k") is None
    e.remember("k", "1")
    e.remember("k", "2")
    e.index(spark.createDataFrame([("a.py", "def f():\n    return g()\n\ndef g():\n    return 1\n")], "path string, content string"))
    e.save_context("g")
    kept = json.loads(e.recall(CONTEXT_KEY))
    assert e.recall("k") == "2" and kept["target"] == "g" and [x["qualified"] for x in kept["context"]][:2] == ["g", "f"]


def test_kept_closure_of_calls(spark, tmp_path):
    """After every change of the tree the kept closure is that of the calls there are."""
    e = Engine(spark, "p", f"file://{tmp_path}/s")
    chain = "def a():\n    return b()\n\ndef b():\n    return c()\n\ndef c():\n    return 1\n"
    for code, want in (
        (chain, {("a", "b"), ("a", "c"), ("b", "c")}),
        (chain.replace("return c()", "return 2"), {("a", "b")}),
        (chain.replace("return 1", "return a()"), {(x, y) for x in "abc" for y in "abc"}),
    ):
        e.index(spark.createDataFrame([("m.py", code)], "path string, content string"))
        names = {r.id: r.name for r in e.find_symbols("m.py").collect()}
        assert {(names[r.src], names[r.dst]) for r in e.reach().collect()} == want
    web = "import os\n\ndef run(x):\n    os.system(x)\n\ndef main():\n    run(input())\n"
    e.index(spark.createDataFrame([("w.py", web)], "path string, content string"))
    assert [(r.sink_path, r.sources, r.overflow) for r in e.sinks().collect()] == [("w.py", ["input"], False)]
