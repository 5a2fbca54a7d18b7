"""Graphs from adjacency-form JSON: ``nodes`` is an array of structs, ``adjacency`` the neighbours of each by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.spec import Graph, GraphSpec, unordered

def parse_graph(document: DataFrame, spec: GraphSpec | None = None) -> Graph:
    """From one row (nodes, adjacency), with every field that nodes and edges have. A missing edge weight is 1; both directions of an edge become one row.

    A column that the spec names for populations, levels or ``keep`` must be there.
    """
    spec = spec or GraphSpec()
    fields = [f.name for f in document.schema["nodes"].dataType.elementType.fields if f.name != "id"]
    missing = sorted({spec.population, *spec.levels, *spec.keep} - {"id", *fields})
    if missing:
        raise ValueError(f"the graph's nodes have no {', '.join(missing)}; they have {', '.join(sorted(fields))}")
    nodes = project(document.select(F.posexplode("nodes").alias("pos", "n")).select(F.coalesce("n.id", F.col("pos").cast("long")).alias("id"), *[F.col(f"n.{c}").alias(c) for c in fields]), spec)
    arcs = document.select(F.posexplode("adjacency").alias("src", "out")).select(F.col("src").cast("long"), F.explode("out").alias("e"))
    edge_fields = [f.name for f in arcs.schema["e"].dataType.fields if f.name != "id"]
    arcs = arcs.select("src", F.col("e.id").alias("dst"), *[F.col(f"e.{c}").alias(c) for c in edge_fields])
    return Graph(nodes, dedup_edges(arcs, spec), spec)


def dedup_edges(arcs: DataFrame, spec: GraphSpec) -> DataFrame:
    """One row for each undirected edge, as its lower end lists it, or the higher one where only that does; the edge weight defaults to 1."""
    a, b = unordered("src", "dst")
    data = [c for c in arcs.columns if c not in ("src", "dst")]
    listed = arcs.filter("src <> dst").select(a.alias("a"), b.alias("b"), (F.col("src") > F.col("dst")).alias("above"), F.struct(F.lit(0).alias("_"), *data).alias("e"))
    out = listed.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min_by("e", "above").alias("e"))
    weight = F.coalesce(F.col(f"e.{spec.edge_weight}").cast("double"), F.lit(1.0)) if spec.edge_weight in data else F.lit(1.0)
    return out.select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in data if c != spec.edge_weight], weight.alias(spec.edge_weight))


def project(nodes: DataFrame, spec: GraphSpec) -> DataFrame:
    """The id and the columns in ``spec.keep``; all if that is empty."""
    return nodes.select("id", *[c for c in nodes.columns if c != "id" and (not spec.keep or c in spec.keep)])


def attribute(nodes: DataFrame, column: str, f=lambda c: c) -> DataFrame:
    """id, value: a function of one attribute of each node."""
    return nodes.select("id", f(F.col(column)).alias("value"))


def modify_edge_weights(graph: Graph, weight) -> Graph:
    """Every edge's weight recomputed by ``weight(u, v, e)``, each argument giving columns by name."""
    u, v = (graph.nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in graph.nodes.columns]) for p in "uv")
    joined = graph.edges.join(u, F.col("src") == F.col("u_id")).join(v, F.col("dst") == F.col("v_id"))
    value: Column = weight(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"), F.col)
    edges = joined.withColumn(graph.spec.edge_weight, value).select(*graph.edges.columns)
    return Graph(graph.nodes, edges, graph.spec)


def load_graph(spark: SparkSession, path: str, spec: GraphSpec | None = None) -> Graph:
    """From a ``.json`` file in a store that Spark reads, with the fields that the file has; other kinds are refused."""
    if not path.lower().endswith(".json"):
        raise ValueError(f"only .json graphs can be loaded: {path}")
    return parse_graph(spark.read.option("multiLine", True).json(path), spec)
