"""Streaming diagnostics: proposal logs arrive as files; windows of steps are kept up to date, each step once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "chain_id long, step long, proposal string, value double"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_acceptance(log: DataFrame, every: int) -> DataFrame:
    """chain_id, window, proposal, proposals, acceptance. Steps of a chain come in order and once; a replayed (chain_id, step) counts once."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0))))
    once = log.dropDuplicates(["chain_id", "step"])
    return once.groupBy("chain_id", F.floor(F.col("step") / every).alias("window"), "proposal").agg(F.count("*").alias("proposals"), F.avg(ratio).alias("acceptance"))
