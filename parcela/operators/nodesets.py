"""Algebra of node sets: tables (set_id, path) of whole units, where a path stands for everything below it.

Every operation expands sets to base nodes, works there, and compresses the
result again to the largest whole units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prefixes(nodes: DataFrame) -> DataFrame:
    n = F.size("path")
    return nodes.select("id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("path", F.lit(1), i))).alias("path"))


def expand(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id, id: an equi-join on all prefixes of each node's path."""
    return sets.join(_prefixes(nodes), "path").select("set_id", "id").distinct()


def compress(members: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    """From (set_id, id) the fewest units: those whole themselves while the unit above is not."""
    prefixes = _prefixes(nodes)
    size = prefixes.groupBy("path").agg(F.count("*").alias("size"))
    held = members.join(prefixes, "id").groupBy("set_id", "path").agg(F.count("*").alias("held")).join(size, "path")
    whole = held.filter("held = size").select("set_id", "path")
    above = whole.select("set_id", F.col("path").alias("up"))
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    child = whole.filter(F.size("path") > 0).withColumn("up", up).join(above, ["set_id", "up"], "left_anti").select("set_id", "path")
    return child.unionByName(whole.filter(F.size("path") == 0))


def intersect(a: DataFrame, b: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    return compress(expand(a, nodes).intersect(expand(b, nodes)), nodes, n_levels)


def merge(a: DataFrame, b: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    return compress(expand(a, nodes).union(expand(b, nodes)).distinct(), nodes, n_levels)


def complement(whole: DataFrame, part: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    """``whole`` without ``part``, which must lie in it."""
    return compress(expand(whole, nodes).exceptAll(expand(part, nodes)), nodes, n_levels)


def children(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each unit replaced by the units one level down."""
    below = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("child")).distinct()
    below = below.withColumn("path", F.slice("child", F.lit(1), F.size("child") - 1))
    return sets.join(below, "path").select("set_id", F.col("child").alias("path"))


def overlaps(p: Column, q: Column) -> Column:
    """One path is a prefix of the other."""
    return (F.slice(p, F.lit(1), F.size(q)) == q) | (F.slice(q, F.lit(1), F.size(p)) == p)


def intersects(sets: DataFrame, units: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id, path: units that share a node with the set."""
    inside = expand(units.select(F.col("path").alias("set_id"), "path"), nodes).withColumnRenamed("set_id", "path")
    return expand(sets, nodes).join(inside, "id").select("set_id", "path").distinct()


def strictly_contains(sets: DataFrame, units: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id, path: units all of whose nodes are in the set."""
    inside = expand(units.select(F.col("path").alias("set_id"), "path"), nodes).withColumnRenamed("set_id", "path")
    size = inside.groupBy("path").agg(F.count("*").alias("size"))
    held = expand(sets, nodes).join(inside, "id").groupBy("set_id", "path").agg(F.count("*").alias("held"))
    return held.join(size, "path").filter("held = size").select("set_id", "path")


def intact(children_column: str | Column) -> Column:
    c = F.col(children_column) if isinstance(children_column, str) else children_column
    return c.isNull() | (F.size(c) == 0)


def district_sets(plans: DataFrame, nodes: DataFrame, n_levels: int) -> DataFrame:
    """set_id (struct of plan and district), path: each district as its largest whole units."""
    return compress(plans.select(F.struct("plan_id", "district").alias("set_id"), F.col("node").alias("id")), nodes, n_levels)


def districts_of(units: DataFrame, plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """plan_id, path, districts (sorted), district (null if there are several)."""
    inside = expand(units.select(F.col("path").alias("set_id"), "path"), nodes).select(F.col("set_id").alias("path"), F.col("id").alias("node"))
    d = inside.join(plans, "node").groupBy("plan_id", "path").agg(F.array_sort(F.collect_set("district")).alias("districts"))
    return d.withColumn("district", F.when(F.size("districts") == 1, F.get("districts", F.lit(0))))


def first_assigned(units: DataFrame, assigned: DataFrame) -> DataFrame:
    """path, district: of the shortest assigned prefix of each unit. assigned: (path, district)."""
    p = units.select(F.col("path").alias("unit"), F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path"))
    return p.join(assigned, "path").groupBy(F.col("unit").alias("path")).agg(F.min_by("district", F.size("path")).alias("district"))


def add_unit(members: DataFrame, unit: DataFrame, nodes: DataFrame) -> DataFrame:
    return members.union(expand(unit, nodes)).distinct()


def remove_unit(members: DataFrame, unit: DataFrame, nodes: DataFrame) -> DataFrame:
    return members.join(expand(unit, nodes), ["set_id", "id"], "left_anti")


def node_vector(plans: DataFrame) -> DataFrame:
    """plan_id, districts: of all nodes in order of id."""
    pairs = F.array_sort(F.collect_list(F.struct("node", "district")))
    return plans.groupBy("plan_id").agg(F.transform(pairs, lambda p: p["district"]).alias("districts"))


def shared_units(plans: DataFrame, nodes: DataFrame, unit: str) -> DataFrame:
    """plan_id, d1 < d2, shared: units that both districts reach into."""
    u = plans.join(nodes.select(F.col("id").alias("node"), unit), "node").groupBy("plan_id", unit).agg(F.array_sort(F.collect_set("district")).alias("ds"))
    # pairs within a unit's few districts
    pairs = u.select("plan_id", unit, F.explode("ds").alias("d1"), "ds").select("plan_id", unit, "d1", F.explode("ds").alias("d2")).filter("d1 < d2")
    return pairs.groupBy("plan_id", "d1", "d2").agg(F.count("*").alias("shared"))
