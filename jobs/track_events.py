"""Follows findings through a growing table of events: when each was seen first and last, in how many scans, how often it came back.

A file stream takes the files that came since the last run; its checkpoint says which.  Blocks of sightings (``codeloom.streaming.sightings``) are its
state, and each batch appends the blocks it changed:

``changes/batch=.../bucket=...``: a block as it was after the batch.  A batch that is repeated after a failure replaces its folder.
``lifecycle/bucket=...``: one row per finding.  Only buckets with a change that their rows do not have yet, as their ``batch`` says, are
made anew, from the changes of these buckets, by dynamic partition overwrite.  So a run that was stopped anywhere is completed by the next,
and a run without new files writes nothing.
"""

from __future__ import annotations

import logging
import sys

from codeloom.streaming.sightings import lifecycle_of_blocks, sighting_blocks
from jobs.common import Config, main, settings
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = logging.getLogger("track_events")
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def scan_number(time: Column, minutes: int) -> Column:
    """Scans have a fixed length and are numbered from 1970-01-01; for a time without zone, the session's zone does not matter."""
    passed = F.unix_date(time.cast("date")).cast("long") * 1440 + F.hour(time) * 60 + F.minute(time)
    return F.floor(passed / minutes)


def _schemas(spark: SparkSession, source: str, config: Config) -> tuple[StructType, str, str]:
    """Schemas of the source, of changes and of lifecycles; keys and value keep their types."""
    known = spark.read.parquet(source).schema
    kinds = {f.name: f.dataType.simpleString() for f in known}
    keys = ", ".join(f"{k} {kinds[k]}" for k in config["keys"])
    changes = f"{keys}, block long, bits long, first long, last long, sightings long, worst {kinds[config['value']]}, batch long, bucket int"
    lifecycle = f"{keys}, first_seen long, last_seen long, scans long, reopened long, sightings long, worst {kinds[config['value']]}, batch long, bucket int"
    return known, changes, lifecycle


def take_new(spark: SparkSession, tables: str, schema: StructType, out: str, config: Config) -> int:
    """Append the changed blocks of all files that are new; how many rows these had.

    An event without a time or of another kind is read and left out; a null key is a key.
    """

    def append(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.hash(*config["keys"]), F.lit(config["buckets"])).alias("bucket")
        batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/changes/batch={number}")

    # a pattern, as a stream's plain path must be a folder, and a table may be one file
    files = f"{tables}/{{{config['table']}.parquet}}"
    rows = spark.readStream.schema(schema).parquet(files).filter(F.col(config["kind"]).isin(config["kinds"]))
    blocks = sighting_blocks(rows, config["keys"], scan_number(F.col(config["time"]), config["scan_minutes"]), F.max(config["value"]).alias("worst"))
    with settings(spark, ROCKSDB):
        stream = blocks.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    return sum(p.numInputRows for p in stream.recentProgress)


def refresh(spark: SparkSession, out: str, config: Config, changes: str, lifecycle: str) -> list[int]:
    """Make the lifecycles anew of the buckets that changed since they were made; which these are (at most ``buckets`` numbers)."""
    spark.createDataFrame([], lifecycle).write.mode("ignore").partitionBy("bucket").parquet(f"{out}/lifecycle")
    spark.createDataFrame([], changes).write.mode("ignore").partitionBy("batch", "bucket").parquet(f"{out}/changes")
    logged = spark.read.schema(changes).parquet(f"{out}/changes")
    made = spark.read.schema(lifecycle).parquet(f"{out}/lifecycle")
    newest = logged.groupBy("bucket").agg(F.max("batch").alias("newest"))
    known = made.groupBy("bucket").agg(F.max("batch").alias("known"))
    stale = [r.bucket for r in newest.join(known, "bucket", "left").filter("known is null or newest > known").select("bucket").collect()]
    if stale:
        keys = config["keys"]
        # a block only grows, so whatever batches it is in, its bits are united and its counts are the largest
        merged = [F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("sightings").alias("sightings"), F.max("worst").alias("worst"), F.max("batch").alias("batch")]
        blocks = logged.filter(F.col("bucket").isin(stale)).groupBy("bucket", *keys, "block").agg(*merged)
        # every row of a bucket says up to which batch the bucket is made
        upto = F.broadcast(newest.select("bucket", F.col("newest").alias("batch")))
        rows = lifecycle_of_blocks(blocks, ["bucket", *keys], F.max("worst").alias("worst")).join(upto, "bucket")
        columns = [f.name for f in made.schema if f.name != "bucket"]
        rows.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/lifecycle")
    return sorted(stale)


def read_lifecycle(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/lifecycle")


def run(spark: SparkSession, tables: str, out: str, config: Config) -> int:
    """Take the events that are new and bring the lifecycles of their findings up to date; 0."""
    source = f"{tables}/{config['table']}.parquet"
    known, changes, lifecycle = _schemas(spark, source, config)
    rows = take_new(spark, tables, known, out, config)
    stale = refresh(spark, out, config, changes, lifecycle)
    LOG.info("read %d new rows of %s, wrote %d of %d buckets of lifecycles to %s", rows, source, len(stale), config["buckets"], out)
    return 0


if __name__ == "__main__":
    sys.exit(main("track_events", run))
