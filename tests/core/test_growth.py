"""Steps whose cost must follow the input, and results that ties and sums leave open."""

from __future__ import annotations

import ast

from codeloom.functions import python_frontend, rules, syntax
from codeloom.operators import case_run, code_index, fixpoint, lexical, postings, resolve, rule_scan, taint
from codeloom.plans.registry import ORACLE_SQL, QUERIES
from codeloom.sources.samples import RULE_CASES, sample_cases, sample_tree
from codeloom.storage import materialize
from pyspark.sql import functions as F


def oracle(name, folder):
    """Rows of the query's SQL over the Parquet tables in ``folder``."""
    import duckdb

    c = duckdb.connect()
    for path in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return sorted(c.execute(ORACLE_SQL[name]).fetchall(), key=str)


def rows_of(name, spark, folder):
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=str)


def test_definitions_of_one_scope_meet_references_once(spark):
    """Very many definitions and references share a scope: their product would have 10^10 rows."""
    refs = spark.range(100000).select("id", F.lit("com.example").alias("scope"))
    defs = refs.select(F.col("scope").alias("def_scope"), F.col("id").alias("target"))
    defs = defs.union(spark.createDataFrame([("com", 7), ("org", 8), ("org", 8)], "def_scope string, target long"))
    more = spark.createDataFrame([(-1, "org.a"), (-1, "net.b"), (-2, None), (-3, "com.other.x")], "id long, scope string")
    found = resolve.nearest_scope(refs.union(more), defs, "id", "scope", "def_scope", "target")
    got = found.groupBy("scope", "depth", "target", "resolved").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([("com.example", 2, 0, False, 100000), ("org.a", 1, 8, True, 1), ("net.b", None, None, False, 1), (None, None, None, False, 1), ("com.other.x", 1, 7, True, 1)], key=str)


def test_first_inserted_row_stays(spark, tmp_path):
    """Rows tie in order and number, within a file and over files that are read by several tasks, the larger one first."""
    lines = tmp_path / "lineitem.parquet"
    for n, size in enumerate((3000, 30000)):
        rows = spark.range(size).select((F.col("id") % 700).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), (F.col("id") * 7919 % 30011 + n * 100000).alias("l_partkey"))
        written = tmp_path / f"w{n}"
        rows.coalesce(1).write.parquet(str(written))
        lines.mkdir(exist_ok=True)
        next(written.glob("*.parquet")).rename(lines / f"part-{n}.parquet")
    assert rows_of("insert_or_ignore", spark, tmp_path) == oracle("insert_or_ignore", tmp_path)


def test_rows_without_part_or_number_bring_no_part(spark, tmp_path):
    """The least number may be that of a row without a part, whose order then gets the part of another row, also of a tied one; an order may have none."""
    rows = [(1, 1, None), (1, 1, 7), (1, 1, 6), (1, 2, 5), (2, 1, None), (2, 3, 9), (2, 3, 4), (3, None, 8), (4, None, None), (5, None, 3), (5, 6, None), (None, 2, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = rows_of("insert_or_ignore", spark, tmp_path)
    assert got == oracle("insert_or_ignore", tmp_path) == sorted([(1, 1, 7), (2, 1, 9), (3, None, None), (4, None, None), (5, 6, None), (None, 2, 1)], key=str)


def test_narrowest_band_of_prices(spark, tmp_path):
    """Bands that are equally wide in cents differ in the last bits of their prices' difference; a size is null."""
    rows = [(0, "a", 7, 900.0), (1, "a", 7, 950.2), (2, "a", 5, 900.1), (3, "a", 5, 950.3), (4, "b", None, 10.0), (5, "b", None, 20.0), (6, "b", 2, 10.0), (7, "b", 2, 20.0)]
    rows += [(10 + n, f"c{n % 3}", n % 13, 900 + n * 37 % 1000 / 10) for n in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert rows_of("narrowest_enclosing", spark, tmp_path) == oracle("narrowest_enclosing", tmp_path)


def test_search_makes_no_row_per_found_document(spark, monkeypatch):
    """Each of 300 queries finds each of 3,000 documents: only the best of a block are written, also where a block's queries are dealt over tasks."""
    written = []
    monkeypatch.setattr(postings, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
    monkeypatch.setattr(postings, "TASK_QUERIES", 100)
    words = spark.range(3000).select("id", F.explode(F.array(F.lit("a"), F.lit("a"), F.lit("b"), F.when(F.col("id") % 1000 == 999, F.lit("a")))).alias("term"))
    index = postings.build(words, F.floor(F.col("id") / 1000))
    queries = spark.range(300).select(F.col("id").alias("query"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("term"))
    found, _ = postings.top(index, queries, 2)
    assert {tuple(r)[1:] for r in found.collect()} == {(999, 4, 1), (1999, 4, 2)} and found.count() == 600
    assert max(df.count() for df, _ in written) <= 300 * 3 * 2 + 3 * 4


def test_excerpt_reads_a_text_twice(spark):
    """Its lines are split once as they are and once in lower case, not for every line that is shown."""
    texts = spark.createDataFrame([("a\nb word\n",)], "t string").select(lexical.excerpt(F.col("t"), ["word"]).alias("e"))
    assert texts._jdf.queryExecution().analyzed().toString().count("split(") == 2
    assert tuple(texts.first().e) == (1, 2, "1: a\n2: b word\n")


def test_ranked_context_sends_few_rows_of_a_target(spark):
    """A target with very many candidates is limited before its window; tiers that share a reason or a candidate count once."""
    many = spark.range(20000).select(F.lit("t").alias("target"), F.format_string("k%05d", "id").alias("key"))
    some = spark.createDataFrame([("t", "k00007"), ("t", "k00007"), ("u", "x"), (None, "y")], "target string, key string")
    ranked = resolve.ranked_context([(many, 80, "b"), (some, 100, "a"), (some, 25, "c"), (some, 10, "b")], 2)
    got = sorted(map(tuple, ranked.collect()), key=str)
    assert got == sorted([("t", "k00007", 100, ["a", "b", "c"], 1, 19998), ("t", "k00000", 80, ["b"], 2, 19998), ("u", "x", 100, ["a", "c", "b"], 1, 0), (None, "y", 100, ["a", "c", "b"], 1, 0)], key=str)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_steps_shuffle_no_edges(spark, monkeypatch):
    """Edges are dealt once; where nothing is small enough for a broadcast, a round shuffles its frontier, what it finds and what is known."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    monkeypatch.setattr(fixpoint, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, label))
    try:
        edges = spark.range(5).select("id", F.col("id") + 1).union(spark.createDataFrame([(0, 1), (0, 9), (9, 2), (3, None), (None, 7)], "a long, b long")).toDF("src", "dst")
        got = sorted(map(tuple, fixpoint.shortest_steps(edges, spark.createDataFrame([(0,), (0,)], "node long")).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(0, 0, None), (1, 1, 0), (9, 1, 0), (2, 2, 1), (3, 3, 2), (4, 4, 3), (None, 4, 3), (5, 5, 4)], key=str)
    assert len(plans) == 7 and not any("hashpartitioning(src" in p for p in plans[1:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def shuffled_rows(spark, work):
    """What ``work`` returns, and the rows that its stages sent to others."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def stages():
        bus.waitUntilEmpty()
        listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {listed.apply(n).stageId(): listed.apply(n).shuffleWriteRecords() for n in range(listed.size())}

    before = set(stages())
    out = work()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_closures_shuffle_a_pair_when_it_is_found(spark):
    """Ways of two edges, of which a change touches few: edges are dealt twice and found pairs once; the known closure is read where it lies."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.range(2000).select(F.concat(F.lit("a"), F.col("id") % 100).alias("src"), F.concat(F.lit("b"), "id").alias("dst"))
    edges = edges.union(spark.range(6000).select(F.concat(F.lit("b"), F.col("id") % 2000), F.concat(F.lit("c"), F.col("id"))))
    removed, added = (spark.createDataFrame([r], "src string, dst string") for r in (("b7", "c7"), ("c7", "d")))

    def work():
        known = fixpoint.closure(edges)
        return known.count(), set(map(tuple, fixpoint.maintained(known, edges, removed, added).collect()))

    try:
        (size, got), rows = shuffled_rows(spark, work)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert size == 14000 and len(got) == 13999 and ("c7", "d") in got and not {("b7", "c7"), ("a7", "c7"), ("b7", "d")} & got
    assert rows < 3 * 8000 + 6000 + 500
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_files_of_a_tree_are_dealt_over_tasks(spark):
    """Rows of few bytes are made into files that take long to read, so they stay in all partitions."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        index = materialize(code_index.index_files(sample_tree(docs)), "index")[0].filter("path like 'mod%'")
        files = index.groupBy(F.input_file_name()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(files) == 12 and sum(r["count"] for r in files) == 400


def test_calls_of_a_file_do_not_split_it_again(monkeypatch):
    """A file of many calls is split into lines once; calls over several lines, with other signs than ASCII, keep their text."""
    code = "x = 'é'; f('ü', y)\r\ng(h(\f1),\r\n  'ö', [\n 2])\n" + "f(1)\n" * 300
    want = {(c.lineno, ast.get_source_segment(code, c)) for c in ast.walk(ast.parse(code)) if isinstance(c, ast.Call)}
    monkeypatch.setattr(python_frontend.ast, "get_source_segment", None)
    found = python_frontend.extract("p", "a.py", code)
    assert not found.notes and {(c["line"], c["snippet"]) for c in found.calls} == {(n, python_frontend.clip(t)) for n, t in want}


def test_affected_files_look_up_no_owner(spark):
    """Callees come with their files: symbols are read for resolving calls only; a call within the changed file brings no other file."""
    files = {"a.py": "from b import f\ndef g():\n    return f()\n", "b.py": "from c import h\ndef f():\n    return h() or i()\ndef i():\n    return 1\n", "c.py": "def h():\n    return 2\n", "d.py": "from a import g\ng()\n"}
    index = code_index.index_files(spark.createDataFrame([("p", p, c) for p, c in files.items()], "project string, path string, content string"))
    found = code_index.affected_files(spark.createDataFrame([("b.py",)], "path string"), index)
    assert found._jdf.queryExecution().analyzed().toString().count("explode(symbols") <= 3
    assert sorted(r.path for r in found.collect()) == ["a.py", "b.py", "c.py"]


def test_trace_leaves_out_functions_without_outside_input(spark, monkeypatch):
    """Of 40 modules that pass values round, none enters the rounds: only what calls link with the one that reads input; a deep tree is traced as a whole."""
    files = {f"m{n}.py": f"def a{n}(x):\n    return x\n\ndef b{n}(x):\n    return a{n}(a{n}(x))\n" for n in range(40)}
    files |= {"web.py": "from store import find\n\ndef view():\n    return find(input('a'))\n", "store.py": "import sqlite3\n\ndef find(x):\n    return sqlite3.connect('x').cursor().execute('|' + x)\n"}
    index = code_index.index_files(spark.createDataFrame([("p", p, c) for p, c in files.items()], "project string, path string, content string"))
    given = []
    monkeypatch.setattr(taint, "fixpoint", lambda base, *a, **k: given.append(base.count()) or fixpoint.fixpoint(base, *a, **k))
    for steps in (40, 1):
        monkeypatch.setattr(taint, "NEAR_STEPS", steps)
        flows, complete = taint.trace(index)
        assert complete and [(r.source_path, r.source_line, r.sink_path, r.sink_line) for r in flows.collect()] == [("web.py", 4, "store.py", 4)]
    assert given[0] <= 12 and given[1] >= 120


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cases_send_their_rules_only(spark, monkeypatch):
    """Which rules match is all that counts: no match of a case gets a fingerprint."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit("x").alias("text"))
    monkeypatch.setattr(rule_scan, "finding_fingerprint", None)
    judged = case_run.detections(sample_cases(docs))
    assert sorted((r.engine, r.positive, r.n) for r in judged.filter("positive = detected and not failed").groupBy("engine", "positive").agg(F.count("*").alias("n")).collect()) == [
        ("graph", False, 2), ("graph", True, 2), ("rules", False, 58), ("rules", True, 58),
    ]


def test_files_are_extracted_in_one_pass(spark):
    """Files that can't be read are notes of the same pass, so what a tree is made of is made once."""
    rows = [("p", "a.py", "def f():\n    return 1\n"), ("p", "b.py", None), ("p", "c.py", "#" * (code_index.MAX_FILE_BYTES + 1)), ("p", "d.py", "")]
    index = code_index.index_files(spark.createDataFrame(rows, "project string, path string, content string"))
    assert "Union" not in plan_of(index)
    found = {r.path: r for r in index.collect()}
    assert [found[p].notes for p in ("b.py", "c.py")] == [["b.py: too large or unreadable"], ["c.py: too large or unreadable"]] and found["b.py"].symbols is found["c.py"].revision is None
    assert [s.name for s in found["a.py"].symbols] == ["<module>", "f"] and found["d.py"].notes == [] and len(found["d.py"].symbols) == 1


def test_texts_without_a_sink_are_not_followed(monkeypatch):
    """A rule of mode taint walks a file only if a name of its sinks is in the code, and one of its sources; comments and strings are none."""
    loaded = [(r, n) for r, n in rules.load(rules.BUNDLED) if n is None]
    assert [f["rule_id"] for f in rules.scan_text("a.js", RULE_CASES["taint-process-env-to-spawn"][1], "javascript", loaded)[0]] == ["taint-process-env-to-spawn"]
    monkeypatch.setattr(rules, "_EVENT", None)
    for text in ("const a = process.env.A; f(a);", "// spawn(process.env.A)\nconst a = 'spawn(';", "JSON.parse(x); const y = f(x);"):
        assert rules.scan_text("a.js", text, "javascript", loaded) == ([], [])


def test_scanner_goes_from_mark_to_mark():
    """Comments, strings, templates and expressions are found between other signs as they were sign by sign."""
    text = "a = b / c; // d\nx = /[/]'/g.test(y) ? `t${'u'}` : \"v\\\"\"; /* ' */ z(1)"
    assert [text[a:b] for a, b in syntax.parse(text, "javascript").literals] == ["// d", "/[/]'/g", '"v\\""', "/* ' */"]
    text = "fn f<'a>(x: &'a str) { let bar = br#\"q\"#; let c = 'r'; /* /* n */ */ g(r\"s\"); }"
    assert [text[a:b] for a, b in syntax.parse(text, "rust").literals] == ['br#"q"#', "'r'", "/* /* n */ */", 'r"s"']


def test_copies_of_a_file_are_matched_once(spark, monkeypatch):
    """A task remembers the matches of small texts; paths and notes are each file's own, and a language is not another's."""
    seen = []
    monkeypatch.setattr(rule_scan, "scan_text", lambda path, text, lang, loaded: seen.append((text, lang)) or rules.scan_text(path, text, lang, loaded))
    text, broken = RULE_CASES["js-expose-process-env"][1], "f("
    files = [(f"{n}/a.js", text, "javascript") for n in range(50)] + [("a.rs", text, "rust"), ("b/c.js", broken, "javascript"), ("d.js", broken, "javascript"), ("e.js", None, "javascript")]
    batch = spark.createDataFrame(files, "path string, content string, language string").toArrow().to_batches()
    out = [r for b in rule_scan._scan_batches(rules.BUNDLED)(batch) for r in b.to_pylist()]
    assert sorted(seen) == sorted([(text, "javascript"), (text, "rust"), (broken, "javascript")])
    assert {r["file"] for r in out if r["note"] is None} == {f"{n}/a.js" for n in range(50)}
    assert sorted(r["note"].split(":")[0] for r in out if r["note"]) == ["b/c.js", "d.js", "e.js"]


def test_calls_bring_what_their_callee_takes(spark):
    """Callees come with their parameters, and calls meet no window: the nearest scope is told by the least and the greatest of one grouping."""
    code = "def f(a):\n    def f(b):\n        return f(b)\n    return f(a)\n\nclass K:\n    def m(self, c):\n        return self.n(c)\n    def n(self, d):\n        return m(d)\n"
    index = code_index.index_files(spark.createDataFrame([("p", "a.py", code), ("p", "b.py", "from a import f\nfrom a import K as f\nf(1)\n"), ("p", "c.py", "import a\na.f(1)\n")], "project string, path string, content string"))
    calls = code_index.resolve_calls(index)
    assert "Window" not in plan_of(calls)
    found = {(r.path, r.line): (r.resolved, r.callee_path, r.callee_parameters) for r in calls.collect()}
    assert found == {("a.py", 3): (True, "a.py", ["b"]), ("a.py", 4): (True, "a.py", ["b"]), ("a.py", 8): (True, "a.py", ["d"]), ("a.py", 10): (False, None, None), ("b.py", 3): (False, None, None), ("c.py", 2): (True, "a.py", ["a"])}
