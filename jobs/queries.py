"""The jobs as queries over the supplied tables: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from codeloom.storage import shared_dir
from jobs import scan_report, track_events
from jobs.common import default_config
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _twice(spark: SparkSession, folder: str, job, name: str) -> str:
    """A new folder of the shared one, which stays, after two runs of a job."""
    out = f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, folder, out, default_config(name))
    return out


def job1_scan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Findings, summary and sources as one table; what one of them lacks is 0 or empty, and a source's verdict is its status."""
    out = _twice(spark, folder, scan_report, "scan_report")
    found = scan_report.read_findings(spark, out).withColumn("part", F.lit("finding"))
    counts = scan_report.read_summary(spark, out).withColumn("part", F.lit("summary"))
    sources = scan_report.read_sources(spark, out).select("source", F.col("verdict").alias("status"), "rows", F.col("findings").alias("occurrences"), "resolved").withColumn("part", F.lit("source"))
    return found.unionByName(counts, allowMissingColumns=True).unionByName(sources, allowMissingColumns=True).na.fill(0).na.fill("")


def job2_track_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lifecycles without the numbers of batches and buckets, which say where rows are stored."""
    return track_events.read_lifecycle(spark, _twice(spark, folder, track_events, "track_events")).drop("batch", "bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_scan_report": job1_scan_report, "job2_track_events": job2_track_events}

_REPORT, _TRACK = default_config("scan_report"), default_config("track_events")
_RULES = ", ".join(f"('{r['rule_id']}', '{r['pattern']}', '{r['severity']}')" for r in _REPORT["rules"])
_LINES = " UNION ALL ".join(
    f"SELECT '{s['table']}' AS source, concat_ws('/', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in s["id"]) + f") AS row_id, unnest(string_split(coalesce({s['text']}, ''), chr(10))) AS t, unnest(range(1, len(string_split(coalesce({s['text']}, ''), chr(10))) + 1)) AS line FROM {s['table']}"
    for s in _REPORT["sources"]
)
_SIZES = " UNION ALL ".join(f"SELECT '{s['table']}' AS source, count(*) AS n FROM {s['table']}" for s in _REPORT["sources"])
_SHOWN = _REPORT["shown_characters"]

ORACLE_SQL: dict[str, str] = {
    "job1_scan_report": f"""
WITH lines AS ({_LINES}),
rules(rule_id, pattern, severity) AS (VALUES {_RULES}),
hits AS (SELECT source, row_id, line, rule_id, severity, unnest(regexp_extract_all(t, pattern)) AS match FROM lines, rules WHERE regexp_matches(t, pattern)),
found AS (SELECT source, severity, rule_id, row_id, line, match, count(*) AS occurrences FROM hits GROUP BY ALL),
findings AS (
  SELECT source, severity, rule_id, row_id, line, substr(match, 1, {_SHOWN}) || repeat('*', greatest(length(match) - {_SHOWN}, 0)) AS preview, occurrences,
         sha256('["' || source || '/' || row_id || '",' || line || ',"scan","' || rule_id || '",["' || match || '"]]') AS fingerprint
  FROM found
)
SELECT 'finding' AS part, source, severity, rule_id, row_id, line, preview, occurrences, fingerprint, 'new' AS status,
       0 AS "new", 0 AS unchanged, 0 AS resolved, 0 AS "rows", 0 AS exit_code
FROM findings
UNION ALL
SELECT 'summary', source, severity, rule_id, '', 0, '', CAST(sum(occurrences) AS BIGINT), '', '', count(*), 0, 0, count(DISTINCT row_id), CAST(severity = '{_REPORT["threshold"]}' AS BIGINT)
FROM findings GROUP BY ALL
UNION ALL
SELECT 'source', s.source, '', '', '', 0, '', coalesce(f.n, 0), '', coalesce(f.verdict, 'PASS'), 0, 0, 0, s.n, 0
FROM ({_SIZES}) s LEFT JOIN (SELECT source, count(*) AS n, CASE WHEN bool_or(severity = '{_REPORT["threshold"]}') THEN 'FAIL' ELSE 'WARN' END AS verdict FROM findings GROUP BY source) f ON f.source = s.source
""",
    "job2_track_events": f"""
WITH seen AS (
  SELECT user_id, value, CAST(floor(epoch(ts) / {60 * _TRACK["scan_minutes"]}) AS BIGINT) AS scan FROM events
  WHERE event_type IN ({", ".join(f"'{k}'" for k in _TRACK["kinds"])}) AND ts IS NOT NULL
),
runs AS (SELECT DISTINCT user_id, scan FROM seen),
gaps AS (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY user_id ORDER BY scan) > 1 THEN 1 ELSE 0 END AS gap FROM runs),
folded AS (SELECT user_id, min(scan) AS first_seen, max(scan) AS last_seen, count(*) AS scans, CAST(sum(gap) AS BIGINT) AS reopened FROM gaps GROUP BY user_id),
counts AS (SELECT user_id, count(*) AS sightings, max(value) AS worst FROM seen GROUP BY user_id)
SELECT f.user_id, first_seen, last_seen, scans, reopened, sightings, worst FROM folded f JOIN counts c ON f.user_id IS NOT DISTINCT FROM c.user_id
""",
}
