"""Where intermediate results live: the folder that driver and executors share.

``shared_dir`` reads ``spark.checkpoint.dir`` from the session.  Only where that
is unset, and only on a local master (one machine, as in tests), a temporary
folder is made; on a cluster an unset folder is an error, because a folder on
one machine's disk is invisible to the others.

Results are lazy, so an operator cannot delete the tables its result reads.  ``scratch`` deletes what
was written inside it once the result is, and ``clean_up`` what is left of the application's.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that every process of the application can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="codeloom-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return f"file://{_LOCAL_DIR[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/codeloom/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; return it reread, and its path.

    This cuts the lineage: a lost executor costs the tasks of the current
    stage only, never the stages that made the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, label: str, *keys: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write the distinct rows of ``df`` in sorted buckets of ``keys``, as a table at a path in the shared folder; the table, and what deletes it.

    A join on the keys reads the buckets as they lie and shuffles only its other side, however often it is made.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path, n = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).distinct()  # copies share their keys, so they go without another shuffle
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name, format="parquet")

    def forget() -> None:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)

    return spark.table(name), forget


class Buckets:
    """Rows in buckets of one key, as a table at a path in the shared folder that grows by rounds.

    What is appended should be dealt by the key into ``count`` partitions already, so that every task writes one bucket.  ``settle`` gives the rows
    and takes the table out of the catalog: the files stay, and joins on the key still read the buckets as they lie.
    """

    def __init__(self, spark: SparkSession, label: str, key: str) -> None:
        self.spark, self.key, self.rounds = spark, key, 0
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"bucketed_{uuid.uuid4().hex}", new_path(spark, label)

    def append(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as the next round; they are returned as they lie."""
        numbered = rows.withColumn("__round", F.lit(self.rounds))
        numbered.write.mode("append").bucketBy(self.count, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name, format="parquet")
        self.rounds += 1
        return self.spark.table(self.name).filter(F.col("__round") == self.rounds - 1).drop("__round")

    def all(self) -> DataFrame:
        return self.spark.table(self.name).drop("__round")

    def settle(self) -> DataFrame:
        rows = self.all()
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


@contextmanager
def joins_by_one_key(spark: SparkSession) -> Iterator[None]:
    """Inside the block a join on several keys takes sides that are dealt by one of them as they lie; rows are to be written there, not returned lazily."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _MADE:
            _MADE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Delete what is written in the shared folder inside the block, but for the paths that the given function gets."""
    before, kept = set(_MADE), set()
    try:
        yield kept.add
    finally:
        remove(spark, *[p for p in _MADE if p not in before and p not in kept])


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet written are lost."""
    remove(spark, *list(_MADE))
