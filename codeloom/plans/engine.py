"""The engine's verbs over a source tree and a folder of state.

Verbs give DataFrames; what is small by contract (pages, verdicts) is limited by
its parameters.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from codeloom.functions import severity
from codeloom.functions.identity import identity
from codeloom.functions.rules import BUNDLED
from codeloom.functions.text import line_window, normalize_target, query_words
from codeloom.operators import audit_run, code_index, compare, fixpoint, lexical, literals, resolve, rule_scan, spans, taint
from codeloom.operators.jobs import Jobs
from codeloom.operators.state import VersionedTable, latest_values, snapshot, text_filter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed value: where the newest context is kept.
CONTEXT_KEY = "ai.context.latest"


def _limit(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"a limit is between 1 and {most}")
    return n


def detector() -> str:
    """What finds: a hash of the rules and the extraction's revision."""
    return identity([BUNDLED, code_index.REVISION])


@dataclass
class Assessment:
    """Findings of one state of a tree."""

    findings: DataFrame
    complete: bool


class Engine:
    """One project: its files come as ``path, content``; indexes and baselines are kept under ``state``.  Targets may begin with ``root``."""

    def __init__(self, spark: SparkSession, project: str, state: str, root: str = "") -> None:
        self.spark, self.project, self.state, self.root = spark, project, state.rstrip("/"), root
        self.indexes = VersionedTable(spark, f"{self.state}/index")
        self.baselines = VersionedTable(spark, f"{self.state}/baseline")
        self.audits = VersionedTable(spark, f"{self.state}/audits")
        self.reached = VersionedTable(spark, f"{self.state}/reached")
        self.jobs = Jobs(spark, f"{self.state}/jobs")

    # index and graph

    def index(self, files: DataFrame) -> DataFrame:
        """Bring the stored index up to date; unchanged files are not read again."""
        seen = self.indexes.version()
        rows = files.select(F.lit(self.project).alias("project"), "path", "content")
        fresh = code_index.refresh(self.indexes.read(), rows) if seen else code_index.index_files(rows)
        self.indexes.replace(fresh, seen)
        return self.indexes.read()

    def snapshot(self) -> DataFrame:
        df = self.indexes.read()
        if df is None:
            raise LookupError("the project has no index yet")
        return df

    def status(self) -> DataFrame:
        return code_index.status(self.snapshot())

    def _select(self, target: str) -> DataFrame:
        """All symbols that a target selects: by id, name, qualified name, path or ``path:line``, else by a part of the name."""
        symbols = code_index.facts(self.snapshot(), "symbols").withColumn("at", F.concat_ws(":", "path", "start_line"))
        return resolve.select_tiered(symbols, normalize_target(target, self.root), ["id", "name", "qualified", "path", "at"], "name")

    def find_symbols(self, target: str, limit: int = 50) -> DataFrame:
        """The first ``limit`` symbols that ``target`` selects, in the order of files, each with how many are ``omitted``."""
        return resolve.listed(self._select(target), ["path", "start_line", "id"], _limit(limit, 200))

    def relationships(self, target: str, callers: bool, limit: int = 200) -> DataFrame:
        """The first ``limit`` callers or callees of the symbols that ``target`` selects, unresolved calls too, with how many are ``omitted``."""
        chosen = self._select(target).select(F.col("id").alias("node"))
        calls = code_index.edges(self.snapshot()).filter("kind = 'CALLS'").select("src", "dst")
        return resolve.listed(resolve.neighbours(calls, chosen, forward=not callers), ["node", "other"], _limit(limit, 200))

    def scan_file(self, files: DataFrame, path: str, depth: int = 8) -> tuple[DataFrame, bool]:
        """Rule findings in one file, and flows that pass it, and whether both are complete."""
        name = normalize_target(path, self.root)
        own = files.filter(F.col("path") == name)
        if own.isEmpty():
            raise LookupError(f"{name} is no file of the project")
        found, notes = rule_scan.scan(own)
        flows, ended = self.trace(depth=depth)
        passing = taint.flow_findings(taint.touching(flows, own.select("path"))).select("file", "line", "category", "title", "severity", "confidence")
        return found.select("file", "line", "category", "title", "severity", "confidence").unionByName(passing), ended and notes.isEmpty()

    def search(self, files: DataFrame, patterns: list[str]) -> DataFrame:
        """All matches of regular expressions in whole files: ``pattern, path, line, match``, in order of files and lines."""
        rules = [(p, p, "info") for p in dict.fromkeys(patterns)]
        found = literals.text_matches(files, rules, "path", "content")
        return found.select(F.col("rule_id").alias("pattern"), F.col("id").alias("path"), "line", "match").orderBy("path", "line", "pattern", "match")

    def excerpts(self, files: DataFrame, question: str, limit: int = 20) -> DataFrame:
        """The files that fit the words of a question best, each with numbered lines round its best one: ``path, score, start_line, end_line, text``."""
        words = query_words(question)
        scored = files.select("path", lexical.relevance(F.col("path"), F.col("content"), words).alias("score"), lexical.excerpt(F.col("content"), words).alias("e"))
        return scored.filter("e is not null").orderBy(F.desc("score"), "path").limit(_limit(limit, 20)).select("path", "score", "e.*")

    # audits

    def check_audit(self, units: DataFrame, findings: DataFrame, reviews: DataFrame, places: DataFrame, files: DataFrame) -> DataFrame:
        """``violation, id`` of an audit run of ``files``: states, links, and evidence ``places(id, file, line)`` and paths of units that are not in them."""
        manifest = files.select("path", (F.size(F.split("content", "\n")) - F.col("content").endswith("\n").cast("int")).alias("lines"))
        where = places.select(F.col("id").cast("string").alias("id"), "file", F.col("line").cast("long").alias("line")).unionByName(audit_run.paths_of(units))
        found = audit_run.unit_errors(units).unionByName(audit_run.link_errors(units, findings, reviews))
        return found.unionByName(audit_run.evidence_errors(where, manifest).select("violation", "id")).distinct()

    def import_audits(self, runs: DataFrame) -> DataFrame:
        """Keep the runs ``run, snapshot, status, json, arrived`` that are not kept yet, and point to the one that arrived last."""
        seen = self.audits.version()
        kept = self.audits.read() if seen else self.spark.createDataFrame([], audit_run.REVISIONS)
        self.audits.replace(audit_run.import_runs(kept, runs.withColumn("project", F.lit(self.project))), seen)
        return self.audits.read()

    def audit_history(self, size: int = 20) -> DataFrame:
        kept = self.audits.read()
        return audit_run.history(self.spark.createDataFrame([], audit_run.REVISIONS) if kept is None else kept, self.project, size)

    def reach(self) -> DataFrame:
        """``src, dst``: what calls reach over any number of resolved calls; kept, and brought up to date by the calls that came and went."""
        now = code_index.edges(self.snapshot()).filter("kind = 'CALLS' and resolved").select("src", "dst").distinct()
        seen = self.reached.version()
        if seen:
            before = self.reached.read()
            old, known = (before.filter(F.col("direct") == d).select("src", "dst") for d in (True, False))
            found = fixpoint.maintained(known, old, compare.rows_only_in(old, now), compare.rows_only_in(now, old))
        else:
            found = fixpoint.closure(now)
        self.reached.replace(now.withColumn("direct", F.lit(True)).unionByName(found.withColumn("direct", F.lit(False))), seen)
        return self.reached.read().filter(~F.col("direct")).select("src", "dst")

    def sinks(self, most: int = 32) -> DataFrame:
        """Dangerous places that outside input reaches, with the first ``most`` sources of each and whether there are more."""
        return taint.sink_sources(self.trace()[0], most)

    def trace(self, target: str | None = None, category: str | None = None, depth: int = 8) -> tuple[DataFrame, bool]:
        flows, complete = taint.trace(self.snapshot(), max_rounds=_limit(depth, 32) + 2, stored=True)
        if target is not None:
            flows = taint.of_target(flows, target, category)
        elif category is not None:
            flows = flows.filter(F.col("category") == category)
        return flows, complete

    def context(self, target: str, limit: int = 40) -> DataFrame:
        """What stands near a symbol, best first: itself, its file, direct and indirect neighbours."""
        symbols = code_index.facts(self.snapshot(), "symbols")
        chosen = self._select(target).select("id", F.col("path").alias("tpath"))
        own = chosen.select(F.lit(target).alias("target"), F.col("id").alias("key"))
        same_file = symbols.join(chosen.select("tpath").distinct(), F.col("path") == F.col("tpath"), "left_semi").select(F.lit(target).alias("target"), F.col("id").alias("key"))
        calls = code_index.edges(self.snapshot()).filter("kind = 'CALLS' and resolved").select("src", "dst")
        near = resolve.two_hops(calls, chosen.select(F.col("id").alias("node")))
        one = near.filter("hops = 1").select(F.lit(target).alias("target"), F.col("other").alias("key"))
        two = near.filter("hops = 2").select(F.lit(target).alias("target"), F.col("other").alias("key"))
        ranked = resolve.ranked_context([(own, 100, "target"), (one, 80, "direct neighbour"), (same_file, 70, "same file"), (two, 25, "indirect neighbour")], _limit(limit, 200))
        return ranked.join(symbols.select(F.col("id").alias("key"), "qualified", "path", "start_line"), "key", "left")

    def _memory(self) -> DataFrame:
        """The log of what was remembered, oldest values too."""
        path, schema = f"{self.state}/memory", "key string, value string, at long"
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def remember(self, key: str, value: str) -> None:
        """Keep ``value`` as the newest of ``key``: a row is appended, nothing is rewritten."""
        known = self._memory()
        self.spark.createDataFrame([(key, value, time.time_ns())], known.schema).write.mode("append").parquet(f"{self.state}/memory")

    def recall(self, key: str) -> str | None:
        row = latest_values(self._memory().filter(F.col("key") == key), "key", "value", "at").first()
        return row.value if row else None

    def findings(self, text: str = "", severity_from: str = "info", status: str = "active", limit: int = 50) -> DataFrame:
        """Findings of the baseline that contain ``text`` in their file, title or category, worst first, with how many are ``omitted``."""
        base = self.baselines.read()
        if base is None:
            raise LookupError("the project has no baseline yet")
        level = severity.rank(F.col("severity"))
        found = text_filter(base.filter((F.col("status") == status) & (level >= severity.LEVELS.index(severity.parse(severity_from)))), ["file", "title", "category"], text)
        return resolve.listed(found.withColumn("below", -level), ["below", "file", "line", "title", "key"], _limit(limit, 200)).drop("below")

    def reach_of_rules(self, files: DataFrame) -> DataFrame:
        """Per rule the files it has findings in, and the findings."""
        return rule_scan.rule_reach(rule_scan.scan(files)[0])

    def tidy(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions of every stored table; how many.  Results that still read them fail, so end these first."""
        if keep < 1:
            raise ValueError("the newest version stays")
        return sum(t.forget_before(t.version() - keep + 1) for t in (self.indexes, self.baselines, self.audits, self.reached))

    def save_context(self, target: str, limit: int = 40) -> DataFrame:
        """``context`` of a symbol, kept under ``CONTEXT_KEY`` as JSON."""
        near = self.context(target, limit)
        rows = near.orderBy("position").select("position", "score", "reasons", "qualified", "path", "start_line").toJSON().collect()
        self.remember(CONTEXT_KEY, json.dumps({"target": target, "context": [json.loads(r) for r in rows]}))
        return near

    # scans and comparison

    def assess(self, files: DataFrame) -> Assessment:
        """Rule findings and flows of a state, with keys that outlive moved lines."""
        index = code_index.index_files(files.select(F.lit(self.project).alias("project"), "path", "content"))
        found, notes = rule_scan.scan(files)
        flows, ended = taint.trace(index)
        flow = taint.flow_findings(flows).select("file", "line", "category", "title", "severity", "confidence", F.element_at("evidence", 1).alias("flow_id"))
        rules = found.select("file", "line", "category", "title", "severity", "confidence", F.lit(None).cast("string").alias("flow_id"))
        every = rules.unionByName(flow).join(files.select(F.col("path").alias("file"), "content"), "file", "left")
        text = F.try_element_at(F.split("content", "\n"), F.col("line"))
        keyed = every.withColumn("key", compare.logical_key(F.col("file"), F.col("title"), F.col("category"), text, F.col("flow_id"))).drop("content")
        complete = ended and notes.isEmpty() and code_index.status(index).first().complete
        return Assessment(keyed, complete)

    def diff(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Counts of unchanged, resolved, new and unclassified findings per key."""
        a, b = self.assess(before), self.assess(after)
        return compare.assessed_diff(a.findings, b.findings, "key", a.complete, b.complete)

    def create_baseline(self, files: DataFrame) -> DataFrame:
        state = self.assess(files)
        rows = state.findings.withColumn("status", F.lit("active")).withColumn("complete", F.lit(state.complete)).withColumn("detector", F.lit(detector()))
        self.baselines.replace(rows, self.baselines.version())
        return self.baselines.read()

    def verify(self, files: DataFrame) -> tuple[str, DataFrame]:
        """PASS, WARN or FAIL of a state against the baseline, and the findings with their status.

        FAIL: a new or returned finding of high severity and at least half confidence, or between complete states a new path of more than low confidence.
        WARN: either side is incomplete, the detector is not the baseline's, or anything is new.  Only complete states change the baseline.
        """
        seen = self.baselines.version()
        base = self.baselines.read()
        if base is None:
            raise LookupError("the project has no baseline yet")
        head = base.select("complete", "detector").first()
        before_complete = True if head is None else head.complete
        same_detector = head is None or head.detector == detector()
        now = self.assess(files)
        known = base.select("key", F.col("status").alias("old")).groupBy("key").agg(F.min("old").alias("old"))
        found = now.findings.join(known, "key", "left")
        status = F.when(F.col("old") == "resolved", "regressed").when(F.col("old") == "active", "unchanged").otherwise("new" if before_complete else "unclassified")
        marked = found.withColumn("finding_status", status).drop("old")
        flags = marked.agg(F.bool_or(F.col("finding_status").isin("new", "regressed") & F.col("severity").isin("high", "critical") & (F.col("confidence") >= 0.5)).alias("severe"), F.bool_or(F.col("finding_status") != "unchanged").alias("added"), F.bool_or((F.col("finding_status") != "unchanged") & F.col("flow_id").isNotNull() & (F.col("confidence") > taint.CONFIDENCE["low"])).alias("path")).first()
        both = now.complete and before_complete
        given = [F.lit(bool(x)) for x in (flags.severe, not both, flags.added, flags.path, not same_detector)]
        verdict = self.spark.range(1).select(compare.verdict(*given)).first()[0]
        if now.complete and before_complete:
            kept = base.drop("status").join(marked.select("key").distinct(), "key", "left_anti").withColumn("status", F.lit("resolved"))
            active = marked.drop("finding_status").withColumn("status", F.lit("active")).withColumn("complete", F.lit(True)).withColumn("detector", F.lit(detector()))
            self.baselines.replace(active.unionByName(kept.select(*active.columns)), seen)
        return verdict, marked

    def explain(self, findings: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
        """Findings with the narrowest symbol round them and the lines near them."""
        symbols = code_index.facts(self.snapshot(), "symbols").filter("kind <> 'module'").select(F.col("path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("qualified").alias("name"))
        numbered = snapshot(findings.withColumn("row", F.monotonically_increasing_id()), "findings")  # written, as the numbers are joined on
        placed = spans.narrowest_enclosing(numbered, symbols, ["file"], "line", "row", "name").withColumnRenamed("range_name", "symbol").drop("range_file", "range_start", "range_end", "row")
        return placed.join(files.select(F.col("path").alias("file"), "content"), "file", "left").withColumn("excerpt", line_window(F.col("content"), F.col("line"), around, around)).drop("content")
