"""Named Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, which may lie in any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ordered_table(spark: SparkSession, folder: str, name: str, place: str) -> DataFrame:
    """``table`` with the column ``place``, which sorts rows as they were inserted: by the name of their file, then by their number in it."""
    rows = table(spark, folder, name)
    return rows.select(*rows.columns, F.struct("_metadata.file_path", "_metadata.row_index").alias(place))
