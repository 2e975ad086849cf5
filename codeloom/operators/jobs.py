"""Resumable scans: a manifest of units, results of the done ones, and a small state machine.

Units and results are tables; the state is one record that changes only by
compare-and-swap on the version it was read at.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from codeloom.operators import merkle
from codeloom.operators.compare import only_in
from codeloom.operators.state import VersionedTable
from pyspark.sql import DataFrame, SparkSession

#: States and where each may lead.
MOVES = {
    "pending": {"running", "cancelled"},
    "running": {"running", "paused", "completed", "incomplete", "failed", "cancelled", "stale"},
    "paused": {"running", "cancelled", "stale"},
    "completed": set(), "incomplete": {"running"}, "failed": {"running"}, "cancelled": set(), "stale": set(),
}


@dataclass(frozen=True)
class Job:
    job_id: str
    detector: str
    manifest_hash: str
    state: str = "pending"
    done: int = 0
    version: int = 0


class Jobs:
    """Jobs in a versioned table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path)

    def all(self) -> dict[str, Job]:
        df = self.table.read()
        return {r.job_id: Job(**r.asDict()) for r in df.toLocalIterator()} if df is not None else {}

    def _put(self, job: Job) -> Job:
        seen = self.table.version()
        jobs = self.all()
        now = jobs.get(job.job_id)
        if now is not None and now.version != job.version:
            raise RuntimeError(f"job {job.job_id} was changed by somebody else")
        fresh = replace(job, version=job.version + 1)
        jobs[job.job_id] = fresh
        rows = [tuple(vars(j).values()) for j in jobs.values()]
        self.table.replace(self.spark.createDataFrame(rows, "job_id string, detector string, manifest_hash string, state string, done int, version int"), seen)
        return fresh

    def create(self, job_id: str, detector: str, manifest: DataFrame) -> Job:
        if job_id in self.all():
            raise ValueError(f"job {job_id} exists")
        return self._put(Job(job_id, detector, manifest_identity(manifest)))

    def move(self, job: Job, state: str, done: int | None = None) -> Job:
        if state not in MOVES[job.state]:
            raise ValueError(f"a job that is {job.state} can't become {state}")
        return self._put(replace(job, state=state, done=job.done if done is None else done))

    def resume(self, job: Job, detector: str, manifest: DataFrame) -> Job:
        """Running again, or stale if the detector or the files are no longer the same."""
        same = job.detector == detector and job.manifest_hash == manifest_identity(manifest)
        if not same and job.state in ("pending", "incomplete", "failed"):
            job = self._put(replace(job, state="running"))
        return self.move(job, "running" if same else "stale")


def manifest_identity(manifest: DataFrame) -> str:
    """One hash of a manifest ``path, hash`` that does not depend on the order of rows: the root of its hash tree."""
    return merkle.identity(manifest, "path", "hash")


def pending(manifest: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """The next units without a result, in path order."""
    return only_in(manifest, results, "path").orderBy("path").limit(limit)
