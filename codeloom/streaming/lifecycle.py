"""Findings that arrive as files: the lifecycle as a stream.

Each trigger reads the reports that came since the last one.  What is known of a finding is the state of the stream
(``codeloom.streaming.sightings``), in Spark's state store at the checkpoint; a batch appends the findings that it changed to the
folder of changes, under its number, and a batch that is repeated after a failure writes its folder anew.  The state as a
whole is never rewritten, and reading it is a merge of what was appended.
"""

from __future__ import annotations

from codeloom.streaming.sightings import lifecycle_of_blocks, sighting_blocks
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REPORT = "scan long, file string, severity string, fingerprint string"
CHANGES = "fingerprint string, block long, bits long, first long, last long, sightings long, newest struct<scan: long, file: string, severity: string>, batch long"


def run_available(spark: SparkSession, reports: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Apply all reports (JSON lines) that are there and not applied yet, then stop."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    stream = spark.readStream.schema(REPORT).json(reports)
    newest = F.max(F.struct("scan", "file", "severity")).alias("newest")
    blocks = sighting_blocks(stream, ["fingerprint"], F.col("scan"), newest)
    return blocks.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, changes: str) -> DataFrame:
    """``fingerprint, file, severity, first_seen, last_seen, scans, reopened, sightings`` of all findings; file and severity are those of the last scan."""
    logged = spark.read.schema(CHANGES).parquet(changes)
    # a block only grows, so whatever batches it is in, its bits are united and its counts are the largest
    merged = [F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("sightings").alias("sightings"), F.max("newest").alias("newest")]
    found = lifecycle_of_blocks(logged.groupBy("fingerprint", "block").agg(*merged), ["fingerprint"], F.max("newest").alias("newest"))
    return found.select("fingerprint", "newest.file", "newest.severity", "first_seen", "last_seen", "scans", "reopened", "sightings")


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and window of event time; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
