"""The jobs: reruns, growing input, failures half way, and what they log."""

from __future__ import annotations

import json
import logging
import random
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from codeloom.operators.state import lifecycle
from codeloom.streaming.sightings import lifecycle_of_blocks, sighting_blocks
from jobs import scan_report, track_events
from jobs.common import default_config, settings
from pyspark.sql import functions as F

REPORT, TRACK = default_config("scan_report"), default_config("track_events")
CARD, TOKEN = "4111111111111111", "deadbeef" * 5


def text_tables(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, severity string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "u", "<script>a</script>\n<script>b</script> <script>c</script>"), (2, "v", None)], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "mail me@here.org"), (1, 1, "user", "nothing")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")


DOCS = [(1, f"a {CARD}\nb x@y.org {CARD} {CARD}", "en", "s", "x"), (2, f'"{TOKEN}"', "en", "s", "x"), (2, f'"{TOKEN}"', "en", "s", "x"), (3, None, None, None, None), (4, "", "", "", ""), (None, f"{CARD} {CARD}5", "en", "s", "x"), (5, "a\\b" * 40000 + f" {CARD}", "en", "s", "x")]


def report(spark, out):
    return sorted((r.source, r.severity, r.rule_id, r.row_id, r.line, r.preview, r.occurrences, r.status) for r in scan_report.read_findings(spark, out).collect())


def test_report(spark, tmp_path, caplog):
    text_tables(spark, f"{tmp_path}/t", DOCS)
    caplog.set_level(logging.INFO)
    assert scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/out", REPORT) == 1
    card = ("high", "card-number")
    assert report(spark, f"{tmp_path}/out") == sorted(
        [
            ("documents", *card, "1", 1, "4111************", 1, "new"),
            ("documents", *card, "1", 2, "4111************", 2, "new"),
            ("documents", "medium", "email-address", "1", 2, "x@y.***", 1, "new"),
            ("documents", "critical", "hex-token", "2", 1, "dead" + "*" * 36, 2, "new"),
            ("documents", *card, "", 1, "4111************", 1, "new"),
            ("documents", *card, "5", 1, "4111************", 1, "new"),
            ("pages", "low", "inline-script", "1", 1, "<scr***", 1, "new"),
            ("pages", "low", "inline-script", "1", 2, "<scr***", 2, "new"),
            ("conversations", "medium", "email-address", "1/0", 1, "me@h*******", 1, "new"),
        ]
    )
    rows = {(r.source, r.rule_id): r for r in scan_report.read_summary(spark, f"{tmp_path}/out").collect()}
    r = rows["documents", "card-number"]
    assert (r.new, r.unchanged, r.resolved, r.rows, r.occurrences, r.exit_code) == (4, 0, 0, 3, 5, 0)
    assert rows["documents", "hex-token"].exit_code == 1
    assert {r.source: (r.rows, r.findings, r.resolved, r.verdict) for r in scan_report.read_sources(spark, f"{tmp_path}/out").collect()} == {"documents": (7, 6, 0, "FAIL"), "pages": (2, 2, 0, "WARN"), "conversations": (2, 1, 0, "WARN")}
    assert "read 7 rows" in caplog.text and "wrote 6 findings" in caplog.text and TOKEN not in caplog.text


def test_report_again_and_against_baseline(spark, tmp_path):
    text_tables(spark, f"{tmp_path}/t", DOCS)
    run = [scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/one", REPORT) for _ in range(2)]
    first = report(spark, f"{tmp_path}/one")
    assert run == [1, 1] and len(first) == 9
    # a run that was stopped while it wrote one source, and one whose severity is gone since
    (spark.range(1).selectExpr("'stray' AS rule_id").write.mode("append").parquet(f"{tmp_path}/one/findings/source=documents/severity=low"))
    scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/one", REPORT)
    assert report(spark, f"{tmp_path}/one") == first
    text_tables(spark, f"{tmp_path}/t2", [*DOCS[:1], (9, f"{CARD}", "en", "s", "x")])
    assert scan_report.run(spark, f"{tmp_path}/t2", f"{tmp_path}/two", REPORT, baseline=f"{tmp_path}/one") == 0
    status = {(r[2], r[3], r[4]): r[7] for r in report(spark, f"{tmp_path}/two") if r[0] == "documents"}
    assert status == {("card-number", "1", 1): "unchanged", ("card-number", "1", 2): "unchanged", ("email-address", "1", 2): "unchanged", ("card-number", "9", 1): "new", ("card-number", "", 1): "resolved", ("card-number", "5", 1): "resolved", ("hex-token", "2", 1): "resolved"}
    assert {r.source: (r.rows, r.findings, r.resolved, r.verdict) for r in scan_report.read_sources(spark, f"{tmp_path}/two").collect()} == {"documents": (2, 4, 3, "WARN"), "pages": (2, 2, 0, "PASS"), "conversations": (2, 1, 0, "PASS")}
    # what was resolved is not resolved again, and is new if it comes back
    scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/three", REPORT, baseline=f"{tmp_path}/two")
    assert {r[7] for r in report(spark, f"{tmp_path}/three") if r[2] == "hex-token"} == {"new"}
    with pytest.raises(ValueError, match="another report"):
        scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/one", REPORT, baseline=f"{tmp_path}/one/")


def test_report_as_sarif(spark, tmp_path):
    text_tables(spark, f"{tmp_path}/t", DOCS)
    scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/out", REPORT | {"sarif": True})
    found = [r for p in tmp_path.glob("out/sarif/source=*/shard=*/*.txt") for d in [json.loads(p.read_text())] for r in d["runs"][0]["results"]]
    assert len(found) == 9 and {r["partialFingerprints"]["primary"] for r in found} == {r.fingerprint for r in scan_report.read_findings(spark, f"{tmp_path}/out").collect()}
    assert "file:///conversations/1/0" in {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in found}
    assert TOKEN not in json.dumps(found)


def test_report_of_empty_tables(spark, tmp_path):
    text_tables(spark, f"{tmp_path}/t", DOCS)
    scan_report.run(spark, f"{tmp_path}/t", f"{tmp_path}/out", REPORT)
    for name in ("documents", "pages", "conversations"):
        table = spark.read.parquet(f"{tmp_path}/t/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert scan_report.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", REPORT) == 0
    assert report(spark, f"{tmp_path}/out") == []


def events(rng, n, users, low=0, high=60 * 400):
    start = datetime(2024, 3, 30, 20, 0)
    rows = [(i, start + timedelta(minutes=rng.randint(low, high)), rng.choice(users), rng.choice(["error", "view"]), rng.random() * 90) for i in range(n)]
    return [*rows, (n, None, 1, "error", 1.0), (n + 1, start, None, "error", None), (n + 2, start, 1, None, 2.0)]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def expected(rows):
    """Lifecycles by user, row by row."""
    seen: dict = {}
    for _, ts, user, kind, value in rows:
        if kind == "error" and ts is not None:
            scans, values = seen.setdefault(user, (set(), []))
            scans.add((ts - datetime(1970, 1, 1)) // timedelta(hours=1))
            values.append(value)
    out = {}
    for user, (scans, values) in seen.items():
        known = [v for v in values if v is not None]
        out[user] = (min(scans), max(scans), len(scans), sum(s - 1 not in scans for s in scans) - 1, len(values), max(known, default=None))
    return out


def tracked(spark, out):
    return {r.user_id: (r.first_seen, r.last_seen, r.scans, r.reopened, r.sightings, r.worst) for r in track_events.read_lifecycle(spark, out).collect()}


def add(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_growing_events(spark, tmp_path, caplog):
    """Two runs over growing input, late and repeated sightings among the new ones, then one without anything new."""
    rng, folder, out = random.Random(4), f"{tmp_path}/t", f"{tmp_path}/out"
    caplog.set_level(logging.INFO)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    one = events(rng, 900, range(40))
    add(spark, one, folder)
    track_events.run(spark, folder, out, TRACK)
    assert tracked(spark, out) == expected(one)
    two = events(rng, 300, range(5), low=-3000, high=60 * 900) + one[:50]
    add(spark, two, folder)
    stamps = {r.bucket: r.batch for r in track_events.read_lifecycle(spark, out).collect()}
    track_events.run(spark, folder, out, TRACK)
    assert tracked(spark, out) == expected(one + two)
    later = {r.bucket: r.batch for r in track_events.read_lifecycle(spark, out).collect()}
    assert any(later[b] == stamps[b] for b in stamps), "buckets without news are left alone"
    caplog.clear()
    track_events.run(spark, folder, out, TRACK)
    assert "read 0 new rows" in caplog.text and "wrote 0 of 16 buckets" in caplog.text
    assert tracked(spark, out) == expected(one + two)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stopped_between_stream_and_lifecycles(spark, tmp_path):
    rng, folder, out = random.Random(8), f"{tmp_path}/t", f"{tmp_path}/out"
    one, two = events(rng, 200, range(20)), events(rng, 200, range(20))
    add(spark, one, folder)
    known, _, _ = track_events._schemas(spark, f"{folder}/events.parquet", TRACK)
    track_events.take_new(spark, folder, known, out, TRACK)  # and then nothing
    add(spark, two, folder)
    track_events.run(spark, folder, out, TRACK)
    assert tracked(spark, out) == expected(one + two)


def test_batch_is_repeated(spark, tmp_path):
    """A batch that wrote its changes but did not reach the commit log is taken again, with the same result."""
    rng, folder, out = random.Random(9), f"{tmp_path}/t", tmp_path / "out"
    one = events(rng, 200, range(20))
    add(spark, one, folder)
    track_events.run(spark, folder, str(out), TRACK)
    for log in (out / "checkpoint" / "commits").iterdir():
        log.unlink()
    track_events.run(spark, folder, str(out), TRACK)
    assert tracked(spark, str(out)) == expected(one)


def test_blocks_agree_with_the_lifecycle(spark):
    """Over any split into batches the merged blocks give what the whole table gives; a key with most rows among them."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 30), rng.randint(-100, 500)) for _ in range(4000)]
    whole = spark.createDataFrame(rows, "k long, scan long")
    parts = [sighting_blocks(spark.createDataFrame(rows[i::3], "k long, scan long"), ["k"], F.col("scan")) for i in range(3)]
    merged = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("k", "block").agg(F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sightings").alias("sightings"))
    got = sorted(tuple(r) for r in lifecycle_of_blocks(merged, ["k"]).select("k", "first_seen", "last_seen", "scans", "reopened").collect())
    assert got == sorted(tuple(r)[:5] for r in lifecycle(whole, "k", "scan").collect())


def test_settings_are_put_back(spark):
    with pytest.raises(RuntimeError), settings(spark, {"spark.sql.shuffle.partitions": "3", "jobs.unknown": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") != "3"
    assert spark.conf.get("jobs.unknown", None) is None


def test_command_line(spark, tmp_path):
    text_tables(spark, f"{tmp_path}/t", DOCS)
    (tmp_path / "own.json").write_text(json.dumps(REPORT | {"sources": REPORT["sources"][:1], "threshold": "high"}))
    done = subprocess.run([sys.executable, "-m", "jobs.scan_report", "--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/cli", "--config", f"{tmp_path}/own.json"], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 1, done.stderr[-2000:]
    assert "wrote 6 findings" in done.stderr
    assert {r[0] for r in report(spark, f"{tmp_path}/cli")} == {"documents"}
