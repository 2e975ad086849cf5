"""Source trees as tables: files to facts, facts to resolved edges.

``files(project, path, content)`` is the input.  Extraction runs per file in Arrow
batches and shuffles nothing; resolution is joins on generated keys, so its cost follows the
number of calls and imports, not their product with files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from codeloom.functions.identity import identity, json_string
from codeloom.functions.python_frontend import extract
from codeloom.functions.script_frontend import extract_script
from codeloom.functions.text import language
from codeloom.operators.resolve import scope_ladder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Changes when extraction gives other facts, so that stored ones are made anew.
REVISION = 2
MAX_FILE_BYTES = 1 << 20

_S, _I = T.StringType(), T.IntegerType()


def _list(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


SCHEMA = T.StructType([
    T.StructField("project", _S), T.StructField("path", _S), T.StructField("language", _S), T.StructField("content_hash", _S), T.StructField("revision", _I),
    T.StructField("symbols", _list(("id", _S), ("name", _S), ("qualified", _S), ("kind", _S), ("start_line", _I), ("end_line", _I), ("parameters", T.ArrayType(_S)))),
    T.StructField("imports", _list(("module", _S), ("imported", _S), ("local", _S), ("line", _I), ("whole", T.BooleanType()))),
    T.StructField("calls", _list(("call", _S), ("owner", _S), ("scope", _S), ("name", _S), ("line", _I), ("snippet", _S), ("sanitizer", _S), ("sink", _S))),
    T.StructField("annotations", _list(("id", _S), ("owner", _S), ("kind", _S), ("category", _S), ("name", _S), ("line", _I))),
    T.StructField("hops", _list(("owner", _S), ("origin", _S), ("target", _S), ("line", _I), ("category", _S), ("name", _S), ("snippet", _S))),
    T.StructField("notes", T.ArrayType(_S)),
])


def _extract_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)
    for batch in batches:
        rows = []
        for project, path, content, lang in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if content is None:
                rows.append({"project": project, "path": path, "language": lang, "notes": [f"{path}: too large or unreadable"]})
                continue
            row = {"project": project, "path": path, "language": lang, "content_hash": identity(content), "revision": REVISION}
            if lang in ("python", "javascript", "typescript", "rust"):
                facts = extract(project, path, content) if lang == "python" else extract_script(project, path, content, lang)
                row |= {k: getattr(facts, k) for k in ("symbols", "imports", "calls", "annotations", "hops", "notes")}
            else:
                row |= {"symbols": [], "imports": [], "calls": [], "annotations": [], "hops": [], "notes": [f"{path}: no extraction for {lang or 'this kind of file'}"]}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def index_files(files: DataFrame) -> DataFrame:
    """One row of facts per file.  Files over 1 MiB give a note in place of facts."""
    rows = files.select("project", "path", F.when(F.octet_length("content") <= MAX_FILE_BYTES, F.col("content")).alias("content"), language(F.col("path")).alias("language"))
    return rows.mapInArrow(_extract_batches, SCHEMA)


def refresh(previous: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of ``files``, taking over those of unchanged content and revision."""
    now = files.withColumn("content_hash", F.sha2(json_string(F.coalesce("content", F.lit(""))), 256))
    known = previous.filter(F.col("revision") == REVISION)
    stale = now.join(known.select("project", "path", "content_hash"), ["project", "path", "content_hash"], "left_anti")
    kept = known.join(now.select("project", "path", "content_hash"), ["project", "path", "content_hash"], "left_semi")
    return kept.select(*SCHEMA.names).unionByName(index_files(stale).select(*SCHEMA.names))


def facts(index: DataFrame, kind: str) -> DataFrame:
    """``symbols``, ``imports``, ``calls``, ``annotations`` or ``hops`` of all files, a row each."""
    return index.select("project", "path", F.explode(kind).alias("f")).select("project", "path", "f.*")


def call_uid(call: Column) -> Column:
    """Name of a call over all projects, for rows with ``project`` and ``path``."""
    return F.concat_ws("#", "project", "path", call)


def import_candidates(imports: DataFrame) -> DataFrame:
    """Imports with every path that they may mean: ``candidate, symbol``."""
    script, rust = F.col("path").rlike(r"\.(?:js|jsx|ts|tsx)$"), F.col("path").endswith(".rs")
    near = script & F.col("module").rlike(r"^\.\.?(?:/|$)")
    # steps up from the file's folder: dots of Python, ../ of scripts
    up = F.when(near, F.size(F.filter(F.split("module", "/"), lambda x: x == "..")) + 1).when(script | rust, 0).otherwise(F.length(F.regexp_extract("module", r"^(\.*)", 1)))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up + 1, F.lit(0))), "/")
    dotted = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    name = F.when(near, F.regexp_replace("module", r"^(?:\.\.?/)+", "")).when(rust, F.replace(F.regexp_replace("module", "^(?:crate|self)(?:::)?", ""), F.lit("::"), F.lit("/"))).when(script, F.col("module")).otherwise(dotted)

    def joined(*x: Column) -> Column:
        return F.array_join(F.filter(F.array(*x), lambda p: p != ""), "/")

    roots = F.when(up > 0, F.array(base)).when(rust, F.array(F.lit("src"), folder)).otherwise(F.array(F.lit(""), F.lit("src"), folder, F.lit("app")))
    kinds = [(script, (".ts", ".tsx", ".js", ".jsx", "", "/index.ts", "/index.js")), (rust, (".rs", "/mod.rs"))]
    tails = F
    for when, ends in kinds:
        tails = tails.when(when, F.array(*map(F.lit, ends)))
    tails = tails.otherwise(F.array(F.lit(".py"), F.lit("/__init__.py")))

    def paths(root_name: Column, symbol: Column) -> Column:
        return F.flatten(F.transform(root_name, lambda s: F.transform(tails, lambda t: F.struct(F.concat(s, t).alias("candidate"), symbol.alias("symbol")))))

    as_module = paths(F.transform(roots, lambda r: joined(r, name)), F.col("imported"))
    nested = paths(F.transform(roots, lambda r: joined(r, name, F.col("imported"))), F.lit(None).cast("string"))
    as_member = F.when(F.col("imported").isNotNull() & ~script, nested).otherwise(F.array().cast(as_module_type()))
    exploded = imports.withColumn("c", F.explode(F.array_distinct(F.concat(as_module, as_member))))
    return exploded.select(*imports.columns, "c.candidate", "c.symbol")


def as_module_type() -> str:
    return "array<struct<candidate: string, symbol: string>>"


def resolve_imports(index: DataFrame) -> DataFrame:
    """Every import with its file: ``target_path, symbol, resolved`` if exactly one candidate exists."""
    imports = facts(index, "imports")
    there = index.select(F.col("project").alias("p"), F.col("path").alias("candidate")).distinct()
    hits = import_candidates(imports).join(there, "candidate").filter("p = project")
    keys = ["project", "path", "module", "imported", "local", "line", "whole"]
    one = hits.groupBy(*keys).agg(F.min("candidate").alias("target_path"), F.max("candidate").alias("last"), F.min_by("symbol", "candidate").alias("symbol"))
    on = None
    right = one.select(*[F.col(k).alias(f"_{k}") for k in keys], "target_path", "last", "symbol")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    joined = imports.join(right, on, "left").withColumn("resolved", F.coalesce(F.col("target_path") == F.col("last"), F.lit(False)))
    return joined.select(*keys, F.when(F.col("resolved"), F.col("target_path")).alias("target_path"), F.when(F.col("resolved"), F.col("symbol")).alias("symbol"), "resolved")


def resolve_calls(index: DataFrame) -> DataFrame:
    """Every call with its callee: ``callee, callee_path, callee_parameters, resolved``; several or no candidates leave it unresolved."""
    calls = facts(index, "calls").withColumn("uid", call_uid(F.col("call")))
    # a callee comes with its file and parameters, so no symbol is looked up again
    callee = F.struct(F.col("id").alias("callee"), F.col("path").alias("callee_path"), F.col("parameters").alias("callee_parameters"))
    symbols = facts(index, "symbols").filter("kind in ('function', 'method', 'class')").select(F.col("project").alias("sp"), F.col("path").alias("spath"), F.col("qualified").alias("sq"), callee.alias("to"), F.col("kind").alias("skind"))
    first = F.regexp_extract("name", r"^([^.]+)", 1)
    rest = F.regexp_replace("name", r"^[^.]+\.?", "")
    imports = resolve_imports(index).filter("resolved").select(F.col("project").alias("ip"), F.col("path").alias("ipath"), "local", "module", "whole", "imported", "target_path", "symbol")
    via = calls.select("uid", "project", "path", "name", first.alias("first"), rest.alias("rest")).join(imports, (F.col("ip") == F.col("project")) & (F.col("ipath") == F.col("path")) & (F.col("local") == F.col("first")))
    # what the name means in the imported file
    inner = (
        F.when(F.col("symbol").isNotNull(), F.concat_ws(".", "symbol", F.when(F.col("rest") != "", F.col("rest"))))
        .when(F.col("imported").isNotNull() | F.col("whole"), F.col("rest"))
        .otherwise(F.when(F.col("name").startswith(F.concat(F.col("module"), F.lit("."))), F.expr("substring(name, length(module) + 2)")))
    )
    depth = F.lit(None).cast("int").alias("depth")
    imported = via.select("uid", "project", "target_path", inner.alias("wanted")).join(symbols, (F.col("sp") == F.col("project")) & (F.col("spath") == F.col("target_path")) & (F.col("sq") == F.col("wanted"))).select("uid", depth, "to")
    # in the same file: the nearest enclosing scope, and for a member of the own class that one's
    own = F.regexp_extract("name", r"^(?:self|cls)\.([^.]+)$", 1)
    ladder = F.transform(scope_ladder(F.col("scope")), lambda s: F.struct(F.when(s["prefix"] == "", F.col("name")).otherwise(F.concat_ws(".", s["prefix"], F.col("name"))).alias("wanted"), s["depth"].alias("depth")))
    sibling = F.array(F.struct(F.concat_ws(".", F.regexp_replace("scope", r"\.?[^.]*$", ""), own).alias("wanted"), F.lit(None).cast("int").alias("depth")))
    steps = calls.select("uid", "project", "path", F.explode(F.when(own == "", ladder).when(own != "", sibling)).alias("s")).select("uid", "project", "path", "s.*")
    fits = F.col("depth").isNull() | (F.col("skind") != "method")
    near = steps.join(symbols, (F.col("sp") == F.col("project")) & (F.col("spath") == F.col("path")) & (F.col("sq") == F.col("wanted"))).filter(fits).select("uid", "depth", "to")
    # the first and last of what the deepest scope has, or another way leads to
    deep = F.struct((-F.col("depth")).alias("up"), "to")
    found = imported.union(near).groupBy("uid").agg(
        F.min(F.when(F.col("depth").isNull(), F.col("to"))).alias("low"), F.max(F.when(F.col("depth").isNull(), F.col("to"))).alias("high"),
        F.min(F.when(F.col("depth").isNotNull(), deep))["to"].alias("near"), F.max(F.when(F.col("depth").isNotNull(), F.struct("depth", "to")))["to"].alias("near_high"),
    )
    low, high = F.least("low", "near"), F.greatest("high", "near_high")
    found = found.select("uid", low.alias("to"), (low["callee"] == high["callee"]).alias("one"))
    joined = calls.join(found, "uid", "left").withColumn("resolved", F.coalesce("one", F.lit(False)))
    return joined.withColumns({c: F.when(F.col("resolved"), F.col(f"to.{c}")) for c in ("callee", "callee_path", "callee_parameters")}).drop("one", "to")


def edges(index: DataFrame) -> DataFrame:
    """All typed edges ``src, dst, kind, path, line, name, resolved``, each once."""
    calls = resolve_calls(index).select(F.col("owner").alias("src"), F.coalesce("callee", F.concat(F.lit("unresolved:"), "name")).alias("dst"), F.lit("CALLS").alias("kind"), "path", "line", "name", "resolved")
    node = F.sha2(F.concat(F.lit("["), json_string(F.col("project")), F.lit(","), json_string(F.coalesce("target_path", "path")), F.lit(',"file"]')), 256)
    here = F.sha2(F.concat(F.lit("["), json_string(F.col("project")), F.lit(","), json_string(F.col("path")), F.lit(',"file"]')), 256)
    imports = resolve_imports(index).select(here.alias("src"), F.when(F.col("resolved"), node).otherwise(F.concat(F.lit("unresolved:"), "module")).alias("dst"), F.lit("IMPORTS").alias("kind"), "path", "line", F.col("local").alias("name"), "resolved")
    kind = F.when(F.col("kind") == "source", "READS_FROM").when(F.col("kind") == "security_sink", "WRITES_TO").when(F.col("kind") == "sanitizer", "SANITIZED_BY").when(F.col("kind") == "security_guard", "GUARDED_BY").otherwise("DEFINES")
    notes = facts(index, "annotations").select(F.col("owner").alias("src"), F.col("id").alias("dst"), kind.alias("kind"), "path", "line", "name", (F.col("kind") != "security_guard").alias("resolved"))
    return calls.unionByName(imports).unionByName(notes).dropDuplicates(["src", "dst", "kind", "line", "name"])


def status(index: DataFrame) -> DataFrame:
    """Counters of an index, one row: files, symbols, calls, imports, annotations in all and by kind, notes, complete."""
    kinds = {"sources": "source", "sinks": "security_sink", "sanitizers": "sanitizer", "guards": "security_guard"}
    sizes = {c: F.size(c) for c in ("symbols", "calls", "imports", "annotations", "notes")}

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("annotations", lambda a: a["kind"] == kind))

    sizes |= {c: of_kind(kind) for c, kind in kinds.items()}
    per_file = index.select(F.lit(1).alias("file"), *[F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias(c) for c, n in sizes.items()])
    total = per_file.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes])
    return total.withColumn("complete", F.col("notes") == 0)


def call_status(index: DataFrame) -> DataFrame:
    """``calls, resolved_calls`` of an index, one row."""
    return resolve_calls(index).agg(F.count(F.lit(1)).alias("calls"), F.count_if("resolved").alias("resolved_calls"))


def affected_files(changed: DataFrame, *indexes: DataFrame) -> DataFrame:
    """``path`` of the ``changed(path)`` files, and of those whose symbols call or are called by symbols of theirs.

    Calls count in every given index, before and after a change, so that removed and introduced ones are covered.
    """
    out = changed.select("path")
    for index in indexes:
        # an owner is a symbol of the file its call is in, and a callee comes with its file, so no symbol is looked up
        files = resolve_calls(index).filter("resolved").select(F.col("path").alias("a"), F.col("callee_path").alias("b")).filter("a <> b").distinct()
        both = files.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("f")).select("f.*")
        out = out.union(both.join(changed.select(F.col("path").alias("a")).distinct(), "a", "left_semi").select("b"))
    return out.distinct()
