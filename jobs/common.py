"""What the jobs share: command lines, config files, logs, settings."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from importlib import resources
from typing import Any

from pyspark.sql import SparkSession

Config = dict[str, Any]


def default_config(name: str) -> Config:
    """The config file that lies beside the job."""
    return json.loads(resources.files("jobs").joinpath(f"{name}.json").read_text())


def read_config(spark: SparkSession, path: str) -> Config:
    """A config file in any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block and are put back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def main(name: str, run: Callable[..., int], argv: list[str] | None = None, **paths: str) -> int:
    """The command line of a job: makes a session, runs the job, stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--tables", required=True, help="folder of the Parquet tables")
    parser.add_argument("--out", required=True, help="folder that is written to")
    parser.add_argument("--config", help="config file; the one beside the job if not given")
    for option, text in paths.items():
        parser.add_argument(f"--{option}", help=text)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = read_config(spark, args.config) if args.config else default_config(name)
        return run(spark, args.tables, args.out, config, **{p: getattr(args, p) for p in paths})
    finally:
        spark.stop()
