"""Diagnostics of a proposal log(step, proposal, value): tumbling windows of ``every`` steps, reset at each output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_of(every: int):
    return F.floor(F.col("step") / every).alias("window")


def acceptance_ratios(log: DataFrame, every: int) -> DataFrame:
    """window, proposal, proposals, acceptance: the mean of min(1, ratio); a rejected proposal has ratio 0."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0))))
    return log.groupBy(window_of(every), "proposal").agg(F.count("*").alias("proposals"), F.avg(ratio).alias("acceptance"))


def gathered(log: DataFrame, every: int) -> DataFrame:
    """window, proposal, values in order of step: what an output attaches to its map."""
    pairs = F.array_sort(F.collect_list(F.struct("step", "value")))
    return log.groupBy(window_of(every), "proposal").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def histogram(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


#: What a chain measures of a proposal of two trees, beside its ratio.
MEASURED = ("cycle_length", "pairs", "unique_edges", "max_swappable", "avg_swappable", "delta_pop", "delta_nodes")


def chain_diagnostics(log: DataFrame, every: int) -> DataFrame:
    """chain_id, window, proposal, proposals, accepted, acceptance and the mean of each of MEASURED; changes of population and nodes over the proposals that found a cut."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "ratio"))
    cut = F.when(F.col("delta_nodes") > 0, True)
    means = [F.avg(F.when(cut, F.col(c)) if c.startswith("delta") else F.col(c)).alias(c) for c in MEASURED]
    return log.groupBy("chain_id", F.floor((F.col("step") - 1) / every).alias("window"), "proposal").agg(
        F.count("*").alias("proposals"), F.sum(F.col("accepted").cast("int")).alias("accepted"), F.avg(ratio).alias("acceptance"), *means
    )
