"""Plans as tables(plan_id, node, district)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_from_column(nodes: DataFrame, column: str) -> DataFrame:
    """node, district: an assignment column, moved up by one where it starts at 0."""
    first = nodes.agg(F.min(column)).first()[0]
    return nodes.select(F.col("id").alias("node"), (F.col(column) + (1 if first == 0 else 0)).cast("int").alias("district"))


def plan_from_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """plan_id, node, district: from districts as node sets (set_id: struct of plan_id and district)."""
    from parcela.operators.nodesets import expand

    return expand(sets, nodes).select("set_id.plan_id", F.col("id").alias("node"), "set_id.district")
