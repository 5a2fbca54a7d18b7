"""Run parameters: defaults, then a TOML file, then the command line; and the values derived from them."""

from __future__ import annotations

import argparse
import math
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A chain's seed is SEED_BASE + SEED_STEP * chain_id.
SEED_BASE, SEED_STEP = 454190, 15123


@dataclass
class RunConfig:
    graph: str = ""
    districts: int = 4
    tolerance: float = 0.02
    gamma: float = 0.0
    iso_weight: float = 0.0
    two_tree_steps: float = 100
    output_freq: float = 10
    two_tree_frac: float = 0.1
    thread_id: int = 0
    chains: int = 1
    output: str = "ensemble"
    levels: list[str] = field(default_factory=lambda: ["id"])
    population: str = "pop"
    area: str = "area"
    node_border: str = "border_length"
    edge_weight: str = "connections"
    edge_perimeter: str = "length"

    @property
    def steps(self) -> int:
        return math.ceil(self.two_tree_steps / self.two_tree_frac)

    @property
    def every(self) -> int:
        return math.floor(self.output_freq / self.two_tree_frac)

    def seed(self, thread_id: int | None = None) -> int:
        return SEED_BASE + SEED_STEP * (self.thread_id if thread_id is None else thread_id)

    @property
    def file_name(self) -> str:
        return f"chain_d{self.districts}_tol{self.tolerance}_gamma{self.gamma}_iso{self.iso_weight}_thread{self.thread_id}.jsonl.gz"


def load(argv: list[str] | None = None) -> RunConfig:
    """``--config FILE`` names the TOML file; any other option overrides it."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--config")
    for f in fields(RunConfig):
        kind = {"int": int, "float": float, "str": str}.get(str(f.type))
        parser.add_argument(f"--{f.name}", **({"type": kind} if kind else {"nargs": "*"}))
    args = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    values: dict = {}
    if path := args.pop("config", None):
        known = {f.name for f in fields(RunConfig)}
        for key, value in tomllib.loads(Path(path).read_text()).items():
            values |= {k: v for k, v in (value.items() if isinstance(value, dict) else [(key, value)]) if k in known}
    return RunConfig(**(values | args))


def chain_seed(chain_id: str | Column) -> Column:
    return (F.lit(SEED_BASE) + F.lit(SEED_STEP) * (F.col(chain_id) if isinstance(chain_id, str) else chain_id)).cast("long")


def chains(spark: SparkSession, config: RunConfig) -> DataFrame:
    """chain_id, seed, steps, every."""
    ids = spark.range(config.chains).select(F.col("id").alias("chain_id"))
    return ids.select("chain_id", chain_seed("chain_id").alias("seed"), F.lit(config.steps).cast("long").alias("steps"), F.lit(config.every).cast("long").alias("every"))
