"""Tables that live over runs: manifests, findings, baselines, key-value memory.

State goes in and comes out as a DataFrame; ``VersionedTable`` stores it as numbered
Parquet folders with a pointer, swapped only if nobody else swapped it first.
"""

from __future__ import annotations

import uuid

from codeloom.storage import materialize
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, status``: added, removed, changed or unchanged by content hash."""
    b, a = before.select("path", F.col("hash").alias("old_hash")), after.select("path", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return b.join(a, "path", "full_outer").select("path", "old_hash", "new_hash", status.alias("status"))


def manifest_mismatches(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, old_hash, new_hash`` of what both manifests name with different hashes."""
    b, a = before.select("path", F.col("hash").alias("old_hash")), after.select("path", F.col("hash").alias("new_hash"))
    return b.join(a, "path").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps have equal entries, in whatever order; a null map equals a null map only."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def replace_rows(state: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``state`` without the rows of changed and removed keys, and with the fresh ones."""
    stale = fresh.select(key).union(gone.select(key)).distinct()
    return state.join(stale, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def manifest_hash(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """One hash per group of (key, value) lines, whatever their order: no task gets a whole group.

    Each line's SHA-256 is eight 32-bit numbers; their sums over the group merge partially, and the hash is of those sums.
    """
    line = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(value)), 256)
    sums = [F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    entries = F.count(F.lit(1))
    return rows.groupBy(group).agg(F.sha2(F.concat_ws(":", entries.cast("string"), *sums), 256).alias("manifest"), entries.alias("entries"))


def text_filter(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of which the given columns, joined by spaces, contain ``needle`` in any case; an empty needle finds all."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower())))


def upsert(state: DataFrame, batch: DataFrame, key: str, changing: list[str]) -> DataFrame:
    """``state`` with the rows of ``batch``: known keys take its non-null ``changing`` columns and keep the others, new keys are added."""
    fresh = batch.select(key, *[F.col(c).alias(f"__{c}") for c in changing])
    joined = state.join(fresh, key, "full_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changing else F.col(c) for c in state.columns])


def apply_scan(state: DataFrame, batch: DataFrame, scanned: DataFrame, scan_id: str, now: Column, complete: bool = True, existing: DataFrame | None = None, target: str = "") -> DataFrame:
    """Findings after a scan.

    A finding of the batch is new, or keeps its id and ``created_at`` and is active again.
    Others are resolved only by a complete scan that read their file, or by a complete full scan of ``target``
    (a file or folder; empty: everything) below which their file is no longer among the ``existing(file)``.
    Without ``existing`` the scan is not a full one.
    """
    duplicates = batch.groupBy("fingerprint").count().filter("count > 1")
    if not duplicates.isEmpty():
        raise ValueError("a report names a fingerprint twice")
    old = state.select(*[F.col(c).alias(f"old_{c}") if c != "fingerprint" else F.col(c) for c in state.columns])
    new = batch.select("fingerprint", F.col("file").alias("new_file"), F.col("severity").alias("new_severity"), F.lit(True).alias("seen"))
    joined = old.join(new, "fingerprint", "full_outer").join(scanned.select(F.col("file").alias("old_file"), F.lit(True).alias("was_scanned")).distinct(), "old_file", "left")
    read = F.coalesce("was_scanned", F.lit(False))
    if existing is not None:
        joined = joined.join(existing.select(F.col("file").alias("old_file"), F.lit(True).alias("exists")).distinct(), "old_file", "left")
        below = target.strip("/")
        under = F.lit(True) if below in ("", ".") else (F.col("old_file") == below) | F.col("old_file").startswith(below + "/")
        read = read | under & F.col("exists").isNull()
    gone = F.lit(complete) & F.col("seen").isNull() & read & F.col("old_resolved_at").isNull()
    return joined.select(
        "fingerprint",
        F.coalesce("new_file", "old_file").alias("file"),
        F.coalesce("new_severity", "old_severity").alias("severity"),
        F.when(F.col("seen"), F.lit(scan_id)).otherwise(F.col("old_scan_id")).alias("scan_id"),
        F.coalesce("old_created_at", now).alias("created_at"),
        F.when(F.col("seen"), F.lit(None)).when(gone, now).otherwise(F.col("old_resolved_at")).alias("resolved_at"),
    )


def baseline_update(baseline: DataFrame, present: DataFrame) -> DataFrame:
    """``fingerprint, status``: what the baseline knew is active if present, else resolved; new ones are active."""
    known = baseline.select("fingerprint")
    now = present.select("fingerprint").distinct().withColumn("__here", F.lit(True))
    return known.join(now, "fingerprint", "full_outer").select("fingerprint", F.when(F.col("__here"), "active").otherwise("resolved").alias("status"))


def latest_values(log: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """The newest value of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(value, version).alias(value))


def lifecycle(sightings: DataFrame, key: str, scan: str) -> DataFrame:
    """First and last scan of each finding over numbered scans, how often it came back, and whether it is active."""
    runs = sightings.select(key, scan).distinct()
    last = runs.agg(F.max(scan).alias("__last"))
    gaps = runs.withColumn("__gap", (F.col(scan) - F.lag(scan).over(Window.partitionBy(key).orderBy(scan)) > 1).cast("int"))
    folded = gaps.groupBy(key).agg(F.min(scan).alias("first_seen"), F.max(scan).alias("last_seen"), F.count(F.lit(1)).alias("scans"), F.coalesce(F.sum("__gap"), F.lit(0)).alias("reopened"))
    return folded.join(F.broadcast(last)).select(key, "first_seen", "last_seen", "scans", "reopened", (F.col("last_seen") == F.col("__last")).alias("active"))


def page_newest(rows: DataFrame, order: list[Column], size: int) -> tuple[DataFrame, bool]:
    """The newest ``size`` rows, and whether there are more."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    found = rows.orderBy(*order).limit(size + 1)
    return found.limit(size), found.count() > size


class VersionedTable:
    """A table in numbered versions; ``replace`` fails if the version it read is no longer the newest.

    Rows lie in a folder that only their writer knows.  A version is a small file that names it, and it is made under its final name in one
    step that fails where the file is there: a hard link on a local file system, elsewhere a rename, which HDFS refuses onto a file.  So of
    writers that read the same version one succeeds.  Object stores have no such step; keep state on a file system.
    """

    SCHEMA_VERSION = 7

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _folder(self, version: int) -> str:
        stream = self.fs.open(self._path(f"v{version}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        return max(self._versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        v = version or self.version()
        return self.spark.read.parquet(f"{self.path}/{self._folder(v)}") if v else None

    def _claim(self, version: int, folder: str) -> bool:
        """Whether ``version`` is now the one in ``folder``: false if another writer has it."""
        draft, target = self._path(f"_{folder}"), self._path(f"v{version}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(folder, "utf-8"))
        stream.close()
        try:
            if self.fs.getUri().getScheme() != "file":
                return self.fs.rename(draft, target)
            nio = self.spark._jvm.java.nio.file
            names = [nio.Path.of(self.fs.makeQualified(p).toUri()) for p in (target, draft)]
            try:
                nio.Files.createLink(*names)
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                    raise
                return False
            return True
        finally:
            self.fs.delete(draft, False)

    def replace(self, df: DataFrame, read_version: int) -> int:
        """Write ``df`` as the version after ``read_version``; an error, and nothing written, if another writer has made it."""
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        if self.version() != read_version or not self._claim(read_version + 1, folder):
            self.fs.delete(self._path(folder), True)
            raise RuntimeError(f"version {read_version + 1} was written by somebody else")
        return read_version + 1

    def forget_before(self, version: int) -> int:
        """Delete the versions before ``version``, but never the newest; how many.  Plans that read them fail."""
        old = [v for v in self._versions()[:-1] if v < version]
        for v in old:
            folder = self._folder(v)
            self.fs.delete(self._path(f"v{v}"), False)
            self.fs.delete(self._path(folder), True)
        return len(old)


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """A copy in the shared folder, for state that is read more than once."""
    return materialize(df, label)[0]
