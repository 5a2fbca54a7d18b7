"""Ensemble files: a header of one JSON row, and an append-only table of maps as JSON lines, gzipped if asked for."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


@dataclass
class Header:
    """What holds for a whole run."""

    districts: int
    population_low: float
    population_high: float
    energies: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    date: str = ""
    version: str = VERSION
    extra: dict = field(default_factory=dict)


def node_map(plans: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """plan_id, districting: a map from node name to district. names: (node, name)."""
    named = plans.withColumn("name", F.col("node").cast("string")) if names is None else plans.join(names, "node")
    pairs = F.array_sort(F.collect_list(F.struct("name", "district")))
    return named.groupBy("plan_id").agg(F.map_from_entries(pairs).alias("districting"))


def map_name(step: Column | str, first: int = 0) -> Column:
    return F.concat(F.lit("step"), (F.col(step) - first if isinstance(step, str) else step - first).cast("string"))


class Writer:
    """Appends maps with their reports to ``path``; reports are named columns of the plans' observables."""

    def __init__(self, spark: SparkSession, path: str, header: Header, compress: bool = True, with_districting: bool = True):
        self.spark, self.path, self.compress, self.with_districting = spark, path.rstrip("/"), compress, with_districting
        self.reports: dict[str, tuple[DataFrame, str]] = {}
        row = spark.createDataFrame([(json.dumps(asdict(header), sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/header")

    def push_report(self, name: str, table: DataFrame, column: str) -> Writer:
        """A report: one value of ``column`` for each plan_id."""
        self.reports[name] = (table, column)
        return self

    def rows(self, maps: DataFrame) -> DataFrame:
        """name, weight, districting, data: from maps (plan_id, step, districting)."""
        out = maps
        for table in {id(t): t for t, _ in self.reports.values()}.values():  # one join for all reports of a table
            mine = [F.col(c).alias(f"__{name}") for name, (t, c) in self.reports.items() if t is table]
            out = out.join(table.select("plan_id", *mine), "plan_id", "left")
        data = F.create_map(*[x for n in self.reports for x in (F.lit(n), F.to_json(F.struct(F.col(f"__{n}").alias("value"))))]) if self.reports else F.lit(None).cast("map<string,string>")
        districting = F.col("districting") if self.with_districting else F.create_map().cast(maps.schema["districting"].dataType)
        return out.select(map_name("step").alias("name"), F.lit(1.0).alias("weight"), districting.alias("districting"), data.alias("data"))

    def output(self, maps: DataFrame, part: str | None = None) -> None:
        """Appends maps; or, as a part with a name, puts them in the place of an earlier attempt at that part."""
        out = self.rows(maps).write.option("compression", "gzip" if self.compress else "none")
        if part is None:
            out.mode("append").json(f"{self.path}/maps")
        else:
            out.mode("overwrite").json(f"{self.path}/maps/part-{part}")

    def stream(self, maps: DataFrame, checkpoint: str):
        """Appends the micro-batches of a stream of (plan_id, step, districting)."""
        return maps.writeStream.foreachBatch(lambda batch, _: self.output(batch)).option("checkpointLocation", checkpoint)

    def close(self) -> None:
        """Nothing is held open between outputs."""


def read_header(spark: SparkSession, path: str) -> Header:
    return Header(**json.loads(spark.read.text(f"{path.rstrip('/')}/header").first()[0]))


def _path(spark: SparkSession, path: str):
    """A path of Hadoop's, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def find_header(spark: SparkSession, path: str) -> Header | None:
    """The header of an ensemble that was begun at ``path``, or None."""
    at, store = _path(spark, f"{path.rstrip('/')}/header/_SUCCESS")
    return read_header(spark, path) if store.exists(at) else None


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, weight double, districting map<string,int>, data map<string,string>"
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{path.rstrip('/')}/maps")


def part_name(first: int, last: int) -> str:
    """Parts are named by the steps that they hold."""
    return f"{first}-{last}"


def find_part(spark: SparkSession, path: str, first: int) -> tuple[DataFrame, int] | None:
    """The part that begins with a step and is written whole, and its last step; None where there is none, or only an attempt at it."""
    at, store = _path(spark, f"{path}/part-{first}-*/_SUCCESS")
    found = store.globStatus(at) or []
    if not len(found):
        return None
    folder = found[0].getPath().getParent()
    return spark.read.parquet(folder.toString()), int(folder.getName().rpartition("-")[2])


def map_plans(maps: DataFrame) -> DataFrame:
    """plan_id (name), node (name), district."""
    return maps.select(F.col("name").alias("plan_id"), F.explode("districting").alias("node", "district"))
