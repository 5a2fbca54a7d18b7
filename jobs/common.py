"""What the jobs share: their command line, their settings, and their log."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def settings(kind: type, path: str | None):
    """A dataclass of settings: its defaults, and over them the values of a TOML file. Unknown names are an error."""
    values = tomllib.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(set(values) - {f.name for f in fields(kind)}):
        raise ValueError(f"no setting is called {', '.join(unknown)}")
    return kind(**values)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` as Parquet; of partitions that are there already, those that ``df`` has rows of are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class Arguments:
    tables: str
    output: str
    checkpoint: str
    config: str | None


def main(name: str, run: Callable[[SparkSession, Arguments], object], argv: Sequence[str] | None = None, checkpoint: bool = False) -> None:
    """Parses the command line, makes a session, runs, and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("--tables", required=True, help="folder with a Parquet table NAME.parquet for each name")
    parser.add_argument("--output", required=True, help="folder that is written to")
    if checkpoint:
        parser.add_argument("--checkpoint", required=True, help="folder that keeps what has been read")
    parser.add_argument("--config", help="TOML file of settings")
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, Arguments(a.tables, a.output, getattr(a, "checkpoint", ""), a.config))
    finally:
        spark.stop()
