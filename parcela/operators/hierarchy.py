"""Levels of a graph: quotients by name prefixes, and weights between units of any two levels.

A node's ``path`` holds its unit names from the coarsest level down; a unit is a
prefix of paths. Coarse graphs are aggregates of the base graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import numbered


def with_path(nodes: DataFrame, levels: list[str]) -> DataFrame:
    return nodes.withColumn("path", F.array(*[F.col(c).cast("string") for c in levels]))


def prefix(path: str | Column, level: int) -> Column:
    return F.slice(path, 1, level)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading names that two paths share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.least(F.size(a), F.size(b))).otherwise(first_other - 1).cast("int")


def edge_key(node: Column, nbr: Column) -> Column:
    """The longest common prefix of two paths."""
    return F.slice(node, F.lit(1), common_prefix(node, nbr))


def quotient_ids(nodes: DataFrame, level: int) -> DataFrame:
    """path, first (least node id), qid: units of a level numbered from 1 by first appearance."""
    units = nodes.groupBy(prefix("path", level).alias("path")).agg(F.min("id").alias("first"))
    return numbered(units, [F.col("first")], "qid").withColumn("qid", F.col("qid").cast("int"))


def quotient_nodes(nodes: DataFrame, level: int, skip: tuple[str, ...] = ("id", "path"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each unit: numbers are summed, strings become sorted sets, maps are summed by key, ``keep`` columns stay."""
    key = prefix("path", level).alias("path")
    plain, maps = [], []
    for f in nodes.schema.fields:
        if f.name in skip:
            continue
        if f.name in keep:
            plain.append(F.min(f.name).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            plain.append(F.sum(f.name).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            maps.append(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            plain.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f.name)))).alias(f.name))
        else:
            plain.append(F.array_sort(F.collect_set(f.name)).alias(f.name))
    out = nodes.groupBy(key).agg(F.min("id").alias("first"), *plain)
    for m in maps:
        summed = nodes.select(key, F.explode(m).alias("k", "v")).groupBy("path", "k").agg(F.sum("v").alias("v"))
        out = out.join(summed.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(m)), "path", "left")
    return out


def with_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the paths of both ends, p and q."""
    p = nodes.select(F.col("id").alias("src"), F.col("path").alias("p"))
    q = nodes.select(F.col("id").alias("dst"), F.col("path").alias("q"))
    return edges.join(p, "src").join(q, "dst")


def quotient_edges(edges: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """q1, q2 (paths in order) and summed numbers; edges inside a unit vanish; strings must agree."""
    e = with_paths(edges, nodes).select(prefix("p", level).alias("a"), prefix("q", level).alias("b"), *[c for c in edges.columns if c not in ("src", "dst")])
    data = []
    for f in edges.schema.fields:
        if f.name in ("src", "dst"):
            continue
        if isinstance(f.dataType, T.NumericType):
            data.append(F.sum(f.name).alias(f.name))
        else:
            differ = F.raise_error(F.lit(f"{f.name} differs between edges that are merged"))
            data.append(F.when(F.min(f.name) == F.max(f.name), F.min(f.name)).when(F.min(f.name).isNotNull(), differ).alias(f.name))
    return e.filter("a <> b").groupBy(F.least("a", "b").alias("q1"), F.greatest("a", "b").alias("q2")).agg(*data)


def quotient_graph(nodes: DataFrame, edges: DataFrame, level: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    return quotient_nodes(nodes, level, keep=keep), quotient_edges(edges, nodes, level)


def connections(edges: DataFrame, nodes: DataFrame, n_levels: int, value: Column | None = None) -> DataFrame:
    """coarse, fine, weight: total over the edges between a unit and a finer unit outside it, for all pairs of levels."""
    e = with_paths(edges, nodes)
    both = e.select("p", "q", (F.col("connections") if value is None else value).alias("w"))
    both = both.unionByName(both.select(F.col("q").alias("p"), F.col("p").alias("q"), "w"))
    shared = common_prefix(F.col("p"), F.col("q"))
    levels = F.filter(
        F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c in range(1, n_levels) for f in range(c + 1, n_levels + 1)]), lambda x: x["c"] > F.col("shared")
    )
    pairs = both.withColumn("shared", shared).withColumn("l", F.explode(levels))
    return pairs.groupBy(F.slice("p", F.lit(1), F.col("l.c")).alias("coarse"), F.slice("q", F.lit(1), F.col("l.f")).alias("fine")).agg(F.sum("w").alias("weight"))


def fine_neighbors(edges: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """node, nbr (units of a level), fine: the units one level down in ``nbr`` that touch ``node``."""
    e = with_paths(edges, nodes).select("p", "q")
    both = e.union(e.select("q", "p")).filter(prefix("p", level) != prefix("q", level))
    return both.select(prefix("p", level).alias("node"), prefix("q", level).alias("nbr"), prefix("q", level + 1).alias("fine")).distinct()


def all_fine_neighbors(edges: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    """level, node, nbr, fine: ``fine_neighbors`` of every level that has one below it."""
    out = None
    for level in range(1, n_levels):
        part = fine_neighbors(edges, nodes, level).select(F.lit(level).alias("level"), "node", "nbr", "fine")
        out = part if out is None else out.unionByName(part)
    return out


def subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges inside members(id); ids stay as they are, and coarse quotients of the result are those of the subset."""
    ids = members.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept.select(*edges.columns)


def edge_weight(edges: DataFrame, nodes: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """weight between two units of any levels (0 if they don't touch)."""
    e = with_paths(edges, nodes)
    pa, pb = (F.array(*[F.lit(x) for x in u]) for u in (a, b))
    one = (prefix("p", len(a)) == pa) & (prefix("q", len(b)) == pb)
    other = (prefix("q", len(a)) == pa) & (prefix("p", len(b)) == pb)
    return e.filter(one | other).agg(F.coalesce(F.sum("connections"), F.lit(0.0)).alias("weight"))


def cross_district_levels(edges: DataFrame, nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, d1, d2, level, weight: crossing edges by the first level at which their ends differ."""
    e = with_paths(edges, nodes).withColumn("level", common_prefix(F.col("p"), F.col("q")) + 1)
    a = plans.select("plan_id", F.col("node").alias("src"), F.col("district").alias("da"))
    b = plans.select(F.col("plan_id").alias("p2"), F.col("node").alias("dst"), F.col("district").alias("db"))
    j = e.join(a, "src").join(b, (F.col("plan_id") == F.col("p2")) & (e.dst == b.dst)).filter("da <> db")
    return j.groupBy("plan_id", F.least("da", "db").alias("d1"), F.greatest("da", "db").alias("d2"), "level").agg(F.sum("connections").alias("weight"))


def cluster_graph(nodes: DataFrame, edges: DataFrame, inside: Column, perimeter: str = "length") -> tuple[DataFrame, DataFrame]:
    """The nodes of a cluster, the edges between them, and the perimeter of dropped edges added to the nodes' border."""
    kept = nodes.filter(inside)
    ids = kept.select("id")
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    arcs = edges.select("src", "dst", perimeter).union(edges.select("dst", "src", perimeter))
    outer = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    outer = outer.groupBy(F.col("src").alias("id")).agg(F.sum(perimeter).alias("outer"))
    kept = kept.join(outer, "id", "left").withColumn("border_length", F.col("border_length") + F.coalesce("outer", F.lit(0.0))).drop("outer")
    return kept, both


def matches(filters: list[dict]) -> Column:
    """True where all equalities of any one filter hold."""
    out = F.lit(False)
    for f in filters:
        every = F.lit(True)
        for c, v in f.items():
            every = every & (F.col(c) == v)
        out = out | every
    return out


def cluster_of(nodes: DataFrame, clusters: list[list[dict]]) -> DataFrame:
    """id, cluster (from 0; null in none); a node in two clusters is an error."""
    hits = F.filter(F.array(*[F.when(matches(f), F.lit(i)) for i, f in enumerate(clusters)]), lambda x: x.isNotNull())
    return nodes.select("id", F.when(F.size(hits) > 1, F.raise_error(F.lit("a node is in two clusters"))).otherwise(F.get(hits, F.lit(0))).cast("int").alias("cluster"))
