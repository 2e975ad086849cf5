"""Flows of outside input into dangerous calls, over function borders, by joins.

Facts are hops within functions (see the Python frontend).  Rounds compose them:

* an argument that a resolved callee passes to its return value continues where the call's result goes;
* an argument that a callee passes to a dangerous call reaches that call;
* outside input that a callee returns continues where its calls' results go;
* an unresolved call may pass on any argument, with low confidence, unless it is a sanitizer, which
  makes the value safe for its category.

Every return goes back to the call it came from, so values of one caller do not
leak to others.  Rounds are those of ``codeloom.operators.fixpoint``: joins have the facts of the round before on one
side, and only new facts are written.  The number of rounds follows the
depth of calls, and all state is in tables.
"""

from __future__ import annotations

from functools import reduce

from codeloom.functions.classify import SINKS
from codeloom.functions.identity import json_array, json_string, json_strings
from codeloom.operators.code_index import call_uid, facts, resolve_calls
from codeloom.operators.fixpoint import Facts, FurtherError, bounded_sets, fixpoint, meets, shortest_steps
from codeloom.storage import materialize, remove
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = tuple(SINKS)
#: Confidence of findings of certain and of uncertain flows.
CONFIDENCE = {"medium": 0.65, "low": 0.35}
_KEY = ["owner", "origin", "target", "mask"]


def _bit(category: Column) -> Column:
    out = F.lit(0)
    for n, c in enumerate(CATEGORIES):
        out = F.when(category == c, 1 << n).otherwise(out)
    return out


#: Where a value comes from: a parameter ``P``, the result ``R`` of a call, or outside input ``S``.
ORIGIN = "struct<kind: string, call: string, slot: string, symbol: string, path: string, line: int, name: string>"
#: Where it goes: an argument ``A`` of a call, the function's return ``RET``, or a dangerous call ``K``.
TARGET = "struct<kind: string, call: string, slot: string, symbol: string, path: string, line: int, category: string, name: string, snippet: string>"


def _filled(schema: str, fields: dict[str, Column]) -> Column:
    """A struct of ``schema`` with the given fields, the others null."""
    kinds = dict(part.split(": ") for part in schema.removeprefix("struct<").removesuffix(">").split(", "))
    return F.struct(*[fields.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])


def _composed(facts: Facts, calls: DataFrame) -> DataFrame:
    """What facts of the last round make, together with all others."""

    def part(rows: DataFrame, n: int, **names: str) -> DataFrame:
        """Columns of a fact under the given names, the others numbered."""
        return rows.select(*[F.col(old).alias(new) for new, old in names.items()], *[F.col(c).alias(f"{c}{n}") for c in ("mask", "low", "steps")])

    def made(rows: DataFrame, parts: tuple[int, ...], target: str, owner: str = "owner", safe: Column | None = None, uncertain: Column | None = None) -> DataFrame:
        mask, low = safe if safe is not None else F.lit(0), uncertain if uncertain is not None else F.lit(False)
        for n in parts:
            mask, low = mask.bitwiseOR(F.col(f"mask{n}")), low | F.col(f"low{n}")
        steps = F.concat(*[F.col(f"steps{n}") for n in parts])
        return rows.select(F.col(owner).alias("owner"), "origin", F.col(target).alias("target"), mask.alias("mask"), _way(low, steps))

    flat = facts.map(lambda rows: rows.select("owner", "origin", "target", "mask", "way.low", "way.steps"))
    passed = flat.only("target.kind = 'A'").map(lambda rows: part(rows, 1, owner="owner", origin="origin", uid="target.call", slot="target.slot").join(calls.drop("owner"), "uid"))
    after = flat.only("origin.kind = 'R'").map(lambda rows: part(rows, 3, uid="origin.call", then="target"))
    inner = flat.only("origin.kind = 'P' and target.kind in ('RET', 'K')").map(lambda rows: part(rows, 2, callee="owner", param="origin.slot", inner="target"))
    brought = flat.only("origin.kind = 'S' and target.kind = 'RET'").map(lambda rows: part(rows, 1, callee="owner", origin="origin").join(calls.select("uid", "callee", F.col("owner").alias("caller")), "callee"))

    safe = F.when(F.col("sanitizer").isNotNull(), _bit(F.col("sanitizer"))).otherwise(0)
    uncertain = F.col("sanitizer").isNull() & F.col("sink").isNull()
    slot = F.when(F.col("slot").rlike(r"^\d+$"), F.col("slot").cast("int")).otherwise(F.array_position("parameters", F.col("slot")).cast("int") - 1)
    bound = passed.only("callee is not null").map(lambda rows: rows.withColumn("param", slot.cast("string")))

    out = [made(p.join(a, "uid"), (1, 3), "then", safe=safe, uncertain=uncertain) for p, a in meets(passed.only("callee is null"), after)]
    out += [made(p.join(i, ["callee", "param"]).join(a, "uid"), (1, 2, 3), "then") for p, i, a in meets(bound, inner.only("inner.kind = 'RET'"), after)]
    out += [made(p.join(i, ["callee", "param"]), (1, 2), "inner") for p, i in meets(bound, inner.only("inner.kind = 'K'"))]
    out += [made(b.join(a, "uid"), (1, 3), "then", owner="caller") for b, a in meets(brought, after)]
    return reduce(DataFrame.unionByName, out)


def _way(low: Column, steps: Column) -> Column:
    """The value of a fact: a certain one is better than an uncertain one, then a short one."""
    return F.struct(low.alias("low"), F.size(steps).alias("n"), steps.alias("steps")).alias("way")


#: Steps over calls, from functions that read outside input, after which all functions count as near; deeper trees are traced as a whole.
NEAR_STEPS = 40


def _near_sources(base: DataFrame, calls: DataFrame) -> DataFrame | None:
    """``node``: hashes of the functions that resolved calls link with one that reads outside input; None if links go further than ``NEAR_STEPS``.

    A flow passes only such links, in either direction, so facts of other functions are part of no flow.  Hashes that meet keep a function too many.
    """
    ends = calls.filter("callee is not null").select(F.xxhash64("owner").alias("src"), F.xxhash64("callee").alias("dst"))
    start = base.filter("origin.kind = 'S'").select(F.xxhash64("owner").alias("node")).distinct()
    try:
        return shortest_steps(ends.union(ends.select("dst", "src")), start, NEAR_STEPS).select("node")
    except FurtherError:
        return None


def trace(index: DataFrame, max_rounds: int = 12, stored: bool = False) -> tuple[DataFrame, bool]:
    """All flows, and whether the rounds ended by themselves.  An index that is ``stored`` is read where it is.

    Only functions that calls link with outside input are traced.

    ``id, source_symbol, source_path, source_line, source, sink_symbol, sink_path, sink_line, sink, category, confidence, steps``
    """
    spark = index.sparkSession
    # rounds read these again and again, so files are extracted once
    made = []
    if not stored:
        index, path = materialize(index.select("project", "path", "symbols", "imports", "calls", "hops"), "index")
        made.append(path)
    calls, calls_path = materialize(resolve_calls(index).select("uid", "owner", "callee", "sanitizer", "sink", F.col("callee_parameters").alias("parameters")), "calls")
    hops = facts(index, "hops")
    kind, rest = F.regexp_extract("origin", "^([a-z]+)", 1), F.regexp_replace("origin", "^[a-z]+:", "")
    source = _filled(ORIGIN, {"kind": F.lit("S"), "symbol": F.col("owner"), "path": F.col("path"), "line": F.regexp_extract(rest, r"^(\d+):", 1), "name": F.regexp_replace(rest, r"^\d+:", "")})
    origin = F.when(kind == "result", _filled(ORIGIN, {"kind": F.lit("R"), "call": call_uid(rest)})).when(kind == "source", source).otherwise(_filled(ORIGIN, {"kind": F.lit("P"), "slot": rest}))
    argument = _filled(TARGET, {"kind": F.lit("A"), "call": call_uid(F.regexp_extract("target", r"^arg:(\d+):", 1)), "slot": F.regexp_replace("target", r"^arg:\d+:", "")})
    sink = _filled(TARGET, {"kind": F.lit("K"), "symbol": F.col("owner")} | {c: F.col(c) for c in ("path", "line", "category", "name", "snippet")})
    target = F.when(F.col("target") == "return", _filled(TARGET, {"kind": F.lit("RET")})).when(F.col("target").startswith("sink:"), sink).otherwise(argument)
    step = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    base = hops.select("owner", origin.alias("origin"), target.alias("target"), F.lit(0).alias("mask"), _way(F.lit(False), F.array(step)))
    near = _near_sources(base, calls)
    if near is not None:
        base, path = materialize(base.join(near, F.xxhash64("owner") == F.col("node"), "left_semi"), "hops")
        calls, calls_near = materialize(calls.join(near, F.xxhash64("owner") == F.col("node"), "left_semi"), "calls")
        made += [path, calls_near]
    known, complete = fixpoint(base, lambda found: _composed(found, calls), _KEY, "way", rank=lambda way: way["low"], max_rounds=max_rounds)
    known, _ = materialize(known.filter("origin.kind = 'S' and target.kind = 'K'"), "flows")
    remove(spark, calls_path, *made)
    flows = known.filter(F.col("mask").bitwiseAND(_bit(F.col("target.category"))) == 0)
    flows = flows.select(
        *[F.col(f"origin.{c}").alias(f"source_{c}") for c in ("symbol", "path", "line")], F.col("origin.name").alias("source"), *[F.col(f"target.{c}").alias(f"sink_{c}") for c in ("symbol", "path", "line")],
        F.col("target.name").alias("sink"), "target.snippet", "target.category", F.when(F.col("way.low"), "low").otherwise("medium").alias("confidence"), "way.steps",
    )
    # no line numbers in the identity: moving code does not make a new flow
    key = F.sha2(json_array(json_string(F.col("source_symbol")), json_string(F.col("source")), json_string(F.col("sink_symbol")), json_string(F.col("category")), json_string(F.col("snippet")), json_strings(F.array("sink"))), 256)
    rank = F.when(F.col("confidence") == "medium", 0).otherwise(1)
    best = flows.withColumn("id", key).groupBy("id").agg(F.min(F.struct(rank.alias("r"), F.size("steps").alias("n"), F.struct(*flows.columns).alias("f")))["f"].alias("f"))
    return best.select("id", "f.*"), complete


def flow_findings(flows: DataFrame) -> DataFrame:
    """Flows as findings of high severity."""
    return flows.select(
        F.col("sink_path").alias("file"), F.col("sink_line").alias("line"), F.col("category"), F.concat(F.lit("flow to "), "category").alias("title"), F.lit("high").alias("severity"),
        F.when(F.col("confidence") == "low", CONFIDENCE["low"]).otherwise(CONFIDENCE["medium"]).alias("confidence"),
        F.array(F.concat(F.lit("flow_id: "), "id")).alias("evidence"), "steps",
    )


def sink_sources(flows: DataFrame, most: int = 32) -> DataFrame:
    """``sink_path, sink_line, category, sources, overflow``: per dangerous place the first names of its sources, and whether there are more."""
    return bounded_sets(flows, ["sink_path", "sink_line", "category"], "source", most).withColumnRenamed("values", "sources")


def of_target(flows: DataFrame, target: str, category: str | None = None) -> DataFrame:
    """Flows that start or end at a symbol or file, or read a source, of that name."""
    hit = (F.col("source_symbol") == target) | (F.col("sink_symbol") == target) | (F.col("source_path") == target) | (F.col("sink_path") == target) | F.contains("source", F.lit(target)) | F.exists("steps", lambda s: s.startswith(target + ":"))
    return flows.filter(hit & (F.col("category") == category if category else F.lit(True)))


def touching(flows: DataFrame, paths: DataFrame) -> DataFrame:
    """Flows with a step in one of the files ``paths(path)``."""
    steps = flows.select("id", F.explode("steps").alias("step")).select("id", F.regexp_replace("step", r":\d+\z", "").alias("path"))
    return flows.join(steps.join(paths.select("path").distinct(), "path", "left_semi").select("id").distinct(), "id", "left_semi")


def flow_guards(flows: DataFrame, index: DataFrame) -> DataFrame:
    """``flows`` with ``guards``: names of the guards in the functions that a flow passes, sorted, each once; empty without any."""
    at = r"^(.*):(\d+)$"
    symbols = facts(index, "symbols")
    home = symbols.select(F.col("id").alias("sink_symbol"), "project").distinct()
    steps = flows.select("id", "sink_symbol", F.explode("steps").alias("step")).join(home, "sink_symbol")
    steps = steps.select("id", F.col("project").alias("of"), F.regexp_extract("step", at, 1).alias("in"), F.regexp_extract("step", at, 2).cast("int").alias("at")).distinct()
    guards = facts(index, "annotations").filter("kind = 'security_guard'").select(F.col("owner").alias("guarded"), F.col("name").alias("guard")).distinct()
    guarded = symbols.filter("kind <> 'module'").join(guards, F.col("id") == F.col("guarded")).select("project", "path", "start_line", "end_line", "guard")
    passed = steps.join(guarded, (F.col("of") == F.col("project")) & (F.col("in") == F.col("path")) & F.col("at").between(F.col("start_line"), F.col("end_line")))
    named = passed.groupBy("id").agg(F.array_sort(F.collect_set("guard")).alias("guards"))
    return flows.join(named, "id", "left").withColumn("guards", F.coalesce("guards", F.array().cast("array<string>")))


def flow_edges(flows: DataFrame, index: DataFrame) -> DataFrame:
    """Flows as edges ``src, dst, kind, path, line, name, resolved`` of kind FLOWS_TO, as ``code_index.edges`` has the others.

    They go from the annotation of the source to that of the dangerous call; a step without an annotation is its symbol.
    """
    notes = facts(index, "annotations").groupBy("owner", "kind", "line").agg(F.min("id").alias("note"))

    def at(kind: str, name: str) -> DataFrame:
        return notes.filter(F.col("kind") == kind).select(F.col("owner").alias(f"{name}_symbol"), F.col("line").alias(f"{name}_line"), F.col("note").alias(f"{name}_note"))

    placed = flows.join(at("source", "source"), ["source_symbol", "source_line"], "left").join(at("security_sink", "sink"), ["sink_symbol", "sink_line"], "left")
    return placed.select(
        F.coalesce("source_note", "source_symbol").alias("src"), F.coalesce("sink_note", "sink_symbol").alias("dst"), F.lit("FLOWS_TO").alias("kind"),
        F.col("sink_path").alias("path"), F.col("sink_line").alias("line"), F.col("id").alias("name"), (F.col("confidence") != "low").alias("resolved"),
    )
