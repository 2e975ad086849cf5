"""Source trees and labelled cases that Spark derives from a table of documents: as many files as it has rows.

Every document is a Python module of four functions, which calls into the module of its source.  Every source also has a service that builds a query
from its argument, and routes that hand it outside input: one flow over two files.
"""

from __future__ import annotations

from codeloom.sources.cases import SCHEMA as CASES
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUP = "def second(a):\n    return a\n"
_SERVICE = "import sqlite3\n\ndef build(name):\n    return 'select * from t where n = ' + name\n\ndef find(name):\n    cursor = sqlite3.connect('x').cursor()\n    return cursor.execute(build(name))\n"
_ROUTES = "from flask import Flask, request\nfrom {} import find\n\napp = Flask('x')\n\n@app.route('/find')\ndef view():\n    return find(request.args['name'])\n\napp.run(debug=True)\n"
_FLOW = {"service.py": _SERVICE, "routes.py": _ROUTES.format("service")}


def group_name(source: Column) -> Column:
    """A source as part of a file name; null is ``none``."""
    return F.coalesce(F.regexp_replace(source, "[^A-Za-z0-9_]", "_"), F.lit("none"))


def _ids(docs: DataFrame) -> DataFrame:
    """Each id once, nulls left out, with the source and size of one of its rows.

    They are dealt over all tasks: what is made of a row costs far more than its few bytes, by which Spark would put them together
    (a deal by the id alone would fall to the grouping, whose partitions are merged).
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(group_name(F.col("source"))).alias("group"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    return ids.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id"))


def sample_tree(docs: DataFrame) -> DataFrame:
    """``project, path, content``: a module per id of ``docs(doc_id, source, text)``, and three files per source."""
    ids = _ids(docs)
    body = F.concat(F.lit("from group_"), "group", F.lit(" import second as other\n\ndef first(a):\n    return second(a)\n\ndef second(a):\n    return a + "), F.col("bytes").cast("string"), F.lit("\n\ndef third(a, b=None):\n    return first(b)\n\ndef fourth(a):\n    return other(third(a))\n"))
    modules = ids.select(F.lit("sample").alias("project"), F.concat(F.lit("mod_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))

    def named(kind: str, text: Column) -> Column:
        return F.struct(F.concat(F.lit(f"{kind}_"), "group", F.lit(".py")).alias("path"), text.alias("content"))

    routes = F.format_string(_ROUTES.format("service_%s"), F.col("group"))
    files = ids.select("group").distinct().select(F.explode(F.array(named("group", F.lit(_GROUP)), named("service", F.lit(_SERVICE)), named("routes", routes))).alias("f"))
    return modules.unionByName(files.select(F.lit("sample").alias("project"), "f.path", "f.content"))


#: Per bundled rule a file name, a text it finds and one it does not.
RULE_CASES = {
    "javascript-detect-child-process": ("a.js", "function f(cmd) { const x = cmd; exec(x); }", "function f(cmd) { exec('ls'); }"),
    "javascript-detect-eval-with-expression": ("a.js", "const h = location.hash; eval(h);", "eval('1 + 1');"),
    "javascript-detect-insecure-websocket": ("a.txt", "open ws://remote.example/x", "open ws://localhost:80/x "),
    "js-expose-process-env": ("a.ts", "const e = process.env.KEY;", "// process.env\nconst s = 'process.env';"),
    "js-insecure-websocket-server": ("a.js", "const w = new WebSocketServer({port: 1});", "const w = 'new WebSocketServer(';"),
    "javascript-jwt-decode-unverified": ("a.js", "const c = jwt.decode(token, {a: 1});", "const c = jwt.verify(token, key);"),
    "javascript-permissive-cors": ("a.js", "app.use(cors({ credentials: true, origin: true }));", "app.use(cors({ origin: 'https://a' }));"),
    "taint-process-env-to-spawn": ("a.js", "const p = process.env.P; spawn(p);", "const p = process.env.P; spawn('ls');"),
    "taint-user-input-to-json-parse": ("a.js", "let b = req.body; JSON.parse(b);", "JSON.parse('{}');"),
    "js-unsafe-json-parse": ("a.js", "JSON.parse(raw.toString());", "JSON.parse(fixed);"),
    "python-debug-server": ("a.py", "app.run(host='x', debug=True)", "app.run(debug=False)"),
    "python-insecure-hash-function": ("a.py", "hashlib.md5(x)", "hashlib.md5(x, usedforsecurity=False)"),
    "python-unverified-ssl-context": ("a.py", "c = ssl._create_unverified_context(1)", "c = ssl.create_default_context()"),
    "rust-args": ("a.rs", "fn main() { let a = std::env::args(); }", "fn main() { /* std::env::args() */ }"),
    "rust-args-os": ("a.rs", "fn main() { let a = std::env::args_os(); }", "fn main() { }"),
    "rust-current-exe": ("a.rs", "fn main() { let a = std::env::current_exe(); }", "fn main() { }"),
    "rust-temp-dir": ("a.rs", "fn main() { let a = std::env::temp_dir(); }", 'fn main() { let a = "std::env::temp_dir()"; }'),
    "rust-insecure-hashes": ("a.rs", "fn main() { let h = md5::Md5::new(); }", "fn main() { let h = sha2::Sha256::new(); }"),
    "rust-reqwest-accept-invalid": ("a.rs", "fn main() { let c = reqwest::Client::builder().user_agent(\"x\").danger_accept_invalid_certs(true); }", "fn main() { let c = reqwest::Client::builder().danger_accept_invalid_certs(false); }"),
    "rust-rustls-dangerous": ("a.rs", "fn main() { c.dangerous().set_certificate_verifier(v); }", "fn main() { c.set(v); }"),
    "rust-ssl-verify-none": ("a.rs", "fn main() { b.set_verify(openssl::ssl::SSL_VERIFY_NONE); }", "fn main() { b.set_verify(openssl::ssl::SSL_VERIFY_PEER); }"),
    "rust-unsafe-usage": ("a.rs", "fn main() { unsafe { *p } }", "fn main() { safe(); }"),
}


def _numbered(docs: DataFrame, kinds: list[tuple], schema: str) -> DataFrame:
    """Each id of ``docs`` with one of ``kinds``, by the remainder of the id; a kind has several rows."""
    spark = docs.sparkSession
    number = F.pmod("doc_id", F.lit(1 + max(k[0] for k in kinds)))
    return _ids(docs).join(F.broadcast(spark.createDataFrame(kinds, schema)), number == F.col("number"))


def rule_tree(docs: DataFrame) -> DataFrame:
    """``path, content``: per id a file that a rule finds, below some empty lines, and one that it does not; rules take turns over ids."""
    rows = [(n, f"{rule}/{kind}.{name.rsplit('.', 1)[1]}", text) for n, (rule, (name, *texts)) in enumerate(RULE_CASES.items()) for kind, text in zip(("bad", "good"), texts, strict=True)]
    lines = F.repeat(F.lit("\n"), F.pmod("doc_id", F.lit(5)).cast("int"))
    return _numbered(docs, rows, "number int, name string, case string").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("/"), "name").alias("path"), F.concat(lines, "case").alias("content"))


def sample_cases(docs: DataFrame) -> DataFrame:
    """Labelled cases, as ``sources.cases`` loads them: per id what one rule finds and what not, or projects with and without a flow."""
    spans = [(n, f"{rule}.{kind}", "rules", kind == "bad", rule, {name: text}) for n, (rule, (name, *texts)) in enumerate(RULE_CASES.items()) for kind, text in zip(("bad", "good"), texts, strict=True)]
    spans += [(len(RULE_CASES), f"flow.{kind}", "graph", kind == "bad", "interproc-sql-injection", _FLOW if kind == "bad" else _FLOW | {"routes.py": _FLOW["routes.py"].replace("request.args['name']", "'name'")}) for kind in ("bad", "good")]
    rows = _numbered(docs, [(n, name, engine, positive, rule, next(iter(files)), files) for n, name, engine, positive, rule, files in spans], "number int, name string, engine string, positive boolean, class string, entrypoint string, files map<string, string>")
    columns = {"id": F.concat_ws(".", "name", F.col("doc_id").cast("string")), "family": F.col("name"), "split": F.lit("development"), "rules": F.array("class"), "rationale": F.lit("")}
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in (x.split()[0] for x in CASES.split(", "))])
