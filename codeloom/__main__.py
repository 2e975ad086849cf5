"""Command line: ``python -m codeloom VERB PATH ...``.

Exit codes of ``scan`` and ``verify``: 0 fine, 1 findings at the threshold or FAIL, 2 incomplete or WARN.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 4)).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _show(df: DataFrame, limit: int = 200) -> None:
    for row in df.limit(limit).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--state", default=".codeloom", help="folder of indexes and baselines")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("scan", "index", "status", "symbols", "callers", "callees", "trace", "context", "baseline", "verify", "diff", "changes", "rules", "score", "jobs"):
        s = sub.add_parser(verb)
        if verb != "rules":
            s.add_argument("path")
        if verb in ("symbols", "callers", "callees", "context"):
            s.add_argument("target")
        if verb == "trace":
            s.add_argument("target", nargs="?")
            s.add_argument("--category")
        if verb == "scan":
            s.add_argument("--format", choices=("terminal", "json", "sarif", "markdown"), default="terminal")
            s.add_argument("--threshold", default="high")
        if verb in ("diff", "changes"):
            s.add_argument("--base", required=verb == "diff")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from codeloom.functions.rules import BUNDLED
    from codeloom.functions.severity import threshold_exit

    if args.verb == "rules":
        for r in BUNDLED:
            print(r["id"], r["severity"], ",".join(r["languages"]), r["message"], sep="\t")
        return 0
    spark = _session()
    from codeloom.operators import rule_scan
    from codeloom.plans.engine import Engine
    from codeloom.sinks import report
    from codeloom.sources import git, tree

    if args.verb == "score":
        from codeloom.operators.case_run import detections
        from codeloom.operators.score import confusion
        from codeloom.sources.cases import load

        with open(args.path, encoding="utf-8") as f:
            _show(confusion(detections(load(spark, f.read())).cache(), "class").orderBy(F.col("class").asc_nulls_first()))
        return 0
    engine = Engine(spark, os.path.abspath(args.path), _uri(args.state), root=os.path.abspath(args.path))
    if args.verb == "changes":
        _show(git.changes(spark, args.path, args.base))
        return 0
    if args.verb == "jobs":
        for job in engine.jobs.all().values():
            print(job.job_id, job.state, job.done, job.manifest_hash, sep="\t")
        return 0
    files = tree.read_tree(spark, _uri(args.path)).select("path", "content")
    if args.verb == "scan":
        found, notes = rule_scan.scan(files)
        found = found.cache()
        render = {"terminal": report.to_terminal, "json": report.to_json, "sarif": report.to_sarif, "markdown": report.to_markdown}[args.format]
        print(render(found))
        return threshold_exit(found, args.threshold, notes.isEmpty()).first().exit_code
    if args.verb == "diff":
        before = git.tree_at(spark, args.path, args.base).select("path", "content")
        _show(engine.diff(before, files).filter("new + resolved + unclassified > 0"))
    elif args.verb == "baseline":
        print(engine.create_baseline(files).count(), "findings")
    elif args.verb == "verify":
        verdict, found = engine.verify(files)
        print(verdict)
        _show(found.filter("finding_status <> 'unchanged'").select("finding_status", "severity", F.concat_ws(":", "file", "line"), "title"))
        return {"PASS": 0, "FAIL": 1, "WARN": 2}[verdict]
    else:
        engine.index(files)
        if args.verb in ("index", "status"):
            _show(engine.status())
        elif args.verb == "symbols":
            _show(engine.find_symbols(args.target).select("path", "start_line", "kind", "qualified"))
        elif args.verb in ("callers", "callees"):
            _show(engine.relationships(args.target, args.verb == "callers"))
        elif args.verb == "context":
            _show(engine.context(args.target).orderBy("position").select("score", "qualified", "path", "start_line"))
        else:
            flows, complete = engine.trace(args.target, args.category)
            _show(flows.select("category", "confidence", "source", F.concat_ws(":", "source_path", "source_line"), "sink", F.concat_ws(":", "sink_path", "sink_line")))
            return 0 if complete else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
