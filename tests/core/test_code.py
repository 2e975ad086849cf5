"""Index, resolution and flows of small source trees."""

from __future__ import annotations

from codeloom.operators import code_index, taint
from pyspark.sql import functions as F

WEB = """
from flask import request
from store import find, safe_find
from lib.html import escape_html

def view():
    name = request.args["name"]
    return find(name)

def safe():
    return safe_find(request.args["name"])

def page(res):
    res.send(escape_html(request.form["x"]))

def page_open(res):
    res.send(request.form["y"])
"""
STORE = """
def build(value, suffix=""):
    return "select " + value + suffix

def find(value):
    query = build(value)
    cursor.execute(query)

def safe_find(value):
    cursor.execute("select ?", value)

class Box:
    def put(self, x):
        self.go(x)
    def go(self, x):
        import os
        os.system(x)
"""


def tree(spark, **files: str):
    return spark.createDataFrame([("p", name.replace("__", "/") + ".py", text) for name, text in files.items()], "project string, path string, content string")


def flows(spark, **files: str):
    found, complete = taint.trace(code_index.index_files(tree(spark, **files)))
    assert complete
    return sorted((r.source_path, r.sink_path, r.category, r.confidence) for r in found.collect())


def test_index_and_resolution(spark):
    index = code_index.index_files(tree(spark, web=WEB, store=STORE, bad="def (:"))
    s = code_index.status(index).first()
    assert (s.files, s.complete) == (3, False)
    calls = {(r.path, r.name, r.line): r.resolved for r in code_index.resolve_calls(index).collect()}
    assert calls["web.py", "find", 8] and calls["store.py", "build", 6] and calls["store.py", "self.go", 14]
    assert not calls["store.py", "cursor.execute", 7]
    imports = {r.module: (r.resolved, r.target_path) for r in code_index.resolve_imports(index).collect()}
    assert imports["store"] == (True, "store.py") and imports["flask"] == (False, None)
    kinds = {r.kind for r in code_index.edges(index).collect()}
    assert kinds == {"CALLS", "IMPORTS", "READS_FROM", "WRITES_TO", "SANITIZED_BY"}


def test_ambiguous_import_is_unresolved(spark):
    index = code_index.index_files(tree(spark, main="import util\nutil.f()", util="def f(): pass", src__util="def f(): pass"))
    assert [r.resolved for r in code_index.resolve_imports(index).collect()] == [False]
    both = code_index.index_files(tree(spark, main="from util import f\ndef f(): pass\nf()", util="def f(): pass"))
    assert [r.resolved for r in code_index.resolve_calls(both).collect()] == [False]


def test_flows_over_files(spark):
    assert flows(spark, web=WEB, store=STORE) == [("web.py", "store.py", "sql-injection", "medium"), ("web.py", "web.py", "xss", "medium")]


CASES = [
    ("x = input()\nos.system(x)", ["command-injection"]),
    ("x = input()\nx = 'a'\nos.system(x)", []),
    ("x = input()\nif c:\n    x = 'a'\nos.system(x)", ["command-injection"]),
    ("x = 'a'\nfor i in y:\n    os.system(x)\n    x = input()", ["command-injection"]),
    ("subprocess.run(input(), shell=True)", ["command-injection"]),
    ("subprocess.run(input())", []),
    ("os.system(quote(input()))", []),
    ("res.send(quote(input()))", ["xss"]),
    ("def f(a, b):\n    return a\nos.system(f('x', input()))", []),
    ("def f(a, b):\n    return b\nos.system(f('x', b=input()))", ["command-injection"]),
    ("def f(a):\n    return a\ng = f(input())\nos.system(f('x'))", []),
    ("def f():\n    return input()\nos.system(f())", ["command-injection"]),
    ("o.a = input()\no.b = 'x'\nos.system(o.b)", []),
    ("o.a = input()\nos.system(o.a)", ["command-injection"]),
]


def test_flow_semantics(spark):
    """Every case is a file of its own in one tree."""
    rows = [("p", f"case{n}.py", code) for n, (code, _) in enumerate(CASES)]
    found, complete = taint.trace(code_index.index_files(spark.createDataFrame(rows, "project string, path string, content string")))
    got = {r.path: r.c for r in found.groupBy(F.col("sink_path").alias("path")).agg(F.array_sort(F.collect_list("category")).alias("c")).collect()}
    assert complete
    assert {n: got.get(f"case{n}.py", []) for n in range(len(CASES))} == {n: c for n, (_, c) in enumerate(CASES)}


def test_unresolved_calls_lower_confidence(spark):
    assert flows(spark, m="os.system(mystery(input()))") == [("m.py", "m.py", "command-injection", "low")]


def test_frameworks(spark):
    api = "from fastapi import FastAPI\nimport os\napp = FastAPI()\n@app.get('/{x}')\ndef f(x: str, n: int):\n    os.system(x)\n    os.system(n)"
    assert len(flows(spark, m=api)) == 1
    assert flows(spark, m=api.replace("from fastapi", "from other")) == []


def test_refresh_keeps_unchanged(spark):
    first = code_index.index_files(tree(spark, web=WEB, store=STORE)).cache()
    marked = first.withColumn("notes", F.array(F.lit("kept")))
    again = {r.path: r.notes for r in code_index.refresh(marked, tree(spark, web=WEB, store=STORE + "\nx = 1\n", new="y = 2")).collect()}
    assert again == {"web.py": ["kept"], "store.py": [], "new.py": []}


def test_identity_ignores_moved_lines(spark):
    a, _ = taint.trace(code_index.index_files(tree(spark, web=WEB, store=STORE)))
    b, _ = taint.trace(code_index.index_files(tree(spark, web="\n\n" + WEB, store=STORE)))
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}
    found = taint.flow_findings(a).collect()
    assert {f.severity for f in found} == {"high"} and {f.confidence for f in found} == {0.65}
    assert taint.of_target(a, "store.py").count() == 1


SERVER = """
import { find as look } from './lib/store';
import express from 'express';
const cp = require('child_process');
const app = express();
app.get('/x', (r, res) => {
  const name = r.query.name;
  look(name);
  const { a, b } = req.body;
  res.send(`hi ${escapeHtml(a)}`);
  res.send(`hi ${b}`);
});
class Box { put(x) { this.go(x); } go(x) { cp.exec(x); } }
new Box().put('fixed');
"""
LIB = """
export function build(v) { let q = 'a'; if (v) { q = "select " + v; } return q; }
export const find = (v) => { db.query(build(v)); };
export function safe(v) { db.query("select ?", [v]); }
"""
RUST = """
use crate::util::read;
fn main() { let p = std::env::args(); read(p); /* open(p) */ }
"""


def test_scripts(spark):
    rows = [("p", "app/server.ts", SERVER), ("p", "app/lib/store.js", LIB), ("p", "src/main.rs", RUST), ("p", "src/util.rs", "pub fn read(p: String) { std::fs::read_to_string(p); }"), ("p", "broken.js", "f((")]
    index = code_index.index_files(spark.createDataFrame(rows, "project string, path string, content string"))
    notes = [n for r in index.collect() for n in r.notes]
    assert len(notes) == 1 and notes[0].startswith("broken.js")
    resolved = {(r.path, r.name): r.resolved for r in code_index.resolve_calls(index).collect()}
    assert resolved["app/server.ts", "look"] and resolved["app/lib/store.js", "build"] and resolved["app/server.ts", "self.go"] and resolved["src/main.rs", "read"]
    symbols = {(r.qualified, r.kind) for r in code_index.facts(index, "symbols").collect()}
    assert {("Box", "class"), ("Box.put", "method"), ("find", "function"), ("read", "function"), ("main", "function")} <= symbols
    found, complete = taint.trace(index)
    assert complete
    assert sorted((r.source, r.sink_path, r.category) for r in found.collect()) == [("req.body", "app/server.ts", "xss"), ("req.query.name", "app/lib/store.js", "sql-injection")]


ROUTES = {
    "inline": ("import make from 'express'; const app = make(); app.get('/x', asked => db.query(asked.query.q));", True),
    "router": ("import { Router as make } from 'express'; const r = make();\nr.post('/x', (asked, out) => { db.query(asked.body.q); });", True),
    "member": ("const e = require('express'); const r = e.Router(); function handle(asked) { db.query(asked.params.q); } r.put('/x', guard, handle);", True),
    "renamed": ("const app = require('fastify')(); const first = asked => db.query(asked.query.q); const second = first; app.get('/x', second);", True),
    "plugin": ("import make from 'fastify'; const app = make(); async function outer(inner) { inner.register(deep => { deep.get('/x', asked => db.query(asked.query.q)); }); }\napp.register(outer);", True),
    "alias": ("const app = require('express')(); const same = app;\nsame.get('/x', asked => db.query(asked.query.q));", True),
    "unproven": ("const app = express(); app.get('/x', asked => db.query(asked.query.q));", False),
    "other module": ("import make from 'expresso'; const app = make(); app.get('/x', asked => db.query(asked.query.q));", False),
    "no route": ("import make from 'express'; const app = make(); app.listen(asked => db.query(asked.query.q));", False),
    "outside": ("import make from 'express'; const app = make(); app.get('/x', asked => 1); function f(asked) { db.query(asked.query.q); }", False),
    "second parameter": ("import make from 'express'; const app = make(); app.get('/x', (a, asked) => db.query(asked.query.q));", False),
    "shadowed": ("import make from 'express'; const app = make(); app.get('/x', asked => { { const asked = {query: {q: 'a'}}; db.query(asked.query.q); } });", False),
    "many aliases": ("const express = require('express'); const app = express(); const h0 = (asked, res) => { db.query(asked.query.q); }; " + "".join(f"const h{i + 1} = h{i}; " for i in range(40)) + "app.get('/x', h40);", True),
    "aliases that go round": ("const express = require('express'); const app = express(); let a = b; let b = a; app.get('/x', a);", False),
    "other field": ("function f(req) { const box = {raw: req.query.q, safe: 'a'}; db.query(box.safe); }", False),
    "field": ("function f(req) { const box = {raw: req.query.q, safe: 'a'}; db.query(box.raw); }", True),
}


def test_routes(spark):
    rows = [(name, "a.js", text) for name, (text, _) in ROUTES.items()]
    rows.append(("python", "a.py", "from fastapi import FastAPI as Web\napp = Web()\n@app.get('/x')\nasync def route(q: str):\n    cursor.execute('select ' + q)\n"))
    rows.append(("python safe", "a.py", "from web import FastAPI as Web\napp = Web()\n@app.get('/x')\nasync def route(q: str):\n    cursor.execute('select ' + q)\n"))
    index = code_index.index_files(spark.createDataFrame(rows, "project string, path string, content string"))
    found, complete = taint.trace(index)
    owner = {r.id: r.project for r in code_index.facts(index, "symbols").collect()}
    assert complete
    assert {owner[r.sink_symbol] for r in found.collect()} == {n for n, (_, flows) in ROUTES.items() if flows} | {"python"}


def test_guards_of_flows(spark):
    code = "import os\n\n@login_required\ndef main():\n    if check_permission(1):\n        run(input())\n    login_required()\n\ndef run(x):\n    os.system(x)\n"
    bare = "import os\n\ndef main():\n    os.system(input())\n\n@login_required\ndef other():\n    return 1\n"
    index = code_index.index_files(spark.createDataFrame([("p", "a.py", code), ("q", "a.py", bare)], "project string, path string, content string"))
    notes = {(r.project, r.name) for r in code_index.facts(index, "annotations").filter("kind = 'security_guard'").collect()}
    flows, _ = taint.trace(index)
    guards = {r.source_line: r.guards for r in taint.flow_guards(flows, index).collect()}
    assert guards == {6: sorted({n for p, n in notes if p == "p"}), 4: []} and guards[6]
