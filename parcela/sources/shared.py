"""The folder that driver and executors share."""

from __future__ import annotations

from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder, but in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = "file://" + mkdtemp(prefix="parcela-")
    return _local_dir[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
