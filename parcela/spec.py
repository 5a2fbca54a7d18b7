"""Column names of a graph, and plain values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GraphSpec:
    """Names of the columns that a graph file or table uses."""

    population: str = "pop"
    levels: tuple[str, ...] = ("county", "id")
    area: str | None = "area"
    node_border: str | None = "border_length"
    edge_weight: str = "connections"
    edge_perimeter: str = "length"
    keep: frozenset[str] = frozenset()


@dataclass
class Graph:
    """nodes(id, ...), edges(src, dst, ...) with src < dst, and their spec."""

    nodes: DataFrame
    edges: DataFrame
    spec: GraphSpec = field(default_factory=GraphSpec)


def unordered(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The ends of an undirected edge, smaller one first."""
    return F.least(a, b), F.greatest(a, b)
