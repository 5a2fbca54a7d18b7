"""Cuts of many trees(tree_id, u, v) at once: what hangs off each node, edges and nodes that may be cut, and the probability of a cut.

A tree is one group's own work, once, for what hangs off its nodes (``hanging``
takes large ones with dense ids in pieces); all the rest are filters and
aggregates over these rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.operators.trees import label_groups
from parcela.plans.multiscale import Balance, splitting_sums
from parcela.sources.shared import written

#: Ids side by side whose pieces of a tree are walked by themselves.
CHUNK = 1 << 16


def hanging(trees: DataFrame, nodes: DataFrame, population: str = "pop") -> DataFrame:
    """tree_id, node, nbr, own, pop, total: for both ends of every edge, the people of ``node``, those beyond ``nbr``, and those of the tree."""
    columns = ("tree_id", "node", "nbr", "own", "pop", "total")
    ends = _ends(trees, nodes, population)
    span = nodes.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if span[0] <= CHUNK or span[2] - span[1] > 16 * span[0]:
        return _walks(ends).select(*columns)
    ends = written(ends, "ends")
    chunk = lambda c: F.floor(F.col(c) / CHUNK)
    # what a stretch of ids connects is one node of a smaller tree
    members = ends.select("tree_id", F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.col(f"p{c}").alias("p")) for c in ("u", "v")])).alias("n")).select("tree_id", "n.*").distinct()
    inside = ends.filter(chunk("u") == chunk("v")).select("tree_id", chunk("u").alias("c"), "u", "v")
    alone = members.select("tree_id", chunk("node").alias("c"), F.col("node").alias("u"), F.col("node").alias("v"))
    parts = written(label_groups(inside.unionByName(alone), ["tree_id", "c"]).select("tree_id", "node", F.col("component").alias("part")), "tree_parts")
    people = members.join(parts.hint("merge"), ["tree_id", "node"]).groupBy("tree_id", "part").agg(F.sum("p").alias("p"))
    placed = ends
    for c in ("u", "v"):
        placed = placed.join(parts.select("tree_id", F.col("node").alias(c), F.col("part").alias(f"{c}_part")).hint("merge"), ["tree_id", c])
    placed = written(placed, "tree_ends")
    across = placed.filter("u_part <> v_part")
    small = across.select("tree_id", F.col("u_part").alias("u"), F.col("v_part").alias("v"))
    for c in ("u", "v"):
        small = small.join(people.withColumnsRenamed({"part": c, "p": f"p{c}"}).hint("merge"), ["tree_id", c])
    beyond = _walks(small.select("tree_id", "u", "v", "pu", "pv")).select("tree_id", F.col("node").alias("part"), F.col("nbr").alias("other"), F.col("pop").alias("pv"))
    # each part by itself, with what is beyond its ends as leaves
    turned = across.select("tree_id", F.col("v_part").alias("part"), F.col("u_part").alias("other"), F.col("v").alias("u"), F.col("u").alias("v"), F.col("pv").alias("pu"))
    leaves = across.select("tree_id", F.col("u_part").alias("part"), F.col("v_part").alias("other"), "u", "v", "pu").unionByName(turned).join(beyond.hint("merge"), ["tree_id", "part", "other"])
    own = placed.filter("u_part = v_part").withColumnRenamed("u_part", "part").select("tree_id", "part", "u", "v", "pu", "pv")
    rows = own.unionByName(leaves.select("tree_id", "part", "u", "v", "pu", "pv")).select(F.struct("tree_id", "part").alias("tree_id"), "u", "v", "pu", "pv")
    out = _walks(rows).filter(chunk("node") == chunk("tree_id.part"))
    return out.select("tree_id.tree_id", *columns[1:])


def sides(trees: DataFrame, nodes: DataFrame, population: str = "pop") -> DataFrame:
    """As ``hanging``, with enter, leave, inner: the stretch of a walk over the tree that holds what is beyond ``nbr``, or (inner false) what is not."""
    return _walks(_ends(trees, nodes, population))


def _ends(trees: DataFrame, nodes: DataFrame, population: str) -> DataFrame:
    """tree_id, u, v, and their people pu, pv."""
    pops = nodes.select(F.col("id").alias("x"), F.col(population).cast("double").alias("p"))
    ends = trees.select("tree_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    for c in ("u", "v"):
        ends = ends.join(pops.withColumnsRenamed({"x": c, "p": f"p{c}"}), c)
    return ends


def _walks(ends: DataFrame) -> DataFrame:
    """``sides`` of trees, each in one task."""
    kind = ends.schema["tree_id"].dataType
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField("tree_id", kind), *[T.StructField(c, t) for c, t in (("node", long), ("nbr", long), ("own", double), ("pop", double), ("total", double), ("enter", long), ("leave", long), ("inner", T.BooleanType()))]])

    def one(t: pa.Table) -> pa.Table:
        u, v, pu, pv = (t.column(c).to_numpy() for c in ("u", "v", "pu", "pv"))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, own = at[: len(u)], at[len(u) :], np.zeros(len(ids))
        own[a], own[b] = pu, pv
        near: list[list[int]] = [[] for _ in ids]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near[x].append(y)
            near[y].append(x)
        order, parent, todo = [], {0: -1}, [0]  # a node comes before its subtree, which is a stretch of the order
        while todo:
            order.append(x := todo.pop())
            for y in near[x]:
                if y not in parent:
                    parent[y] = x
                    todo.append(y)
        if len(order) != len(ids) or len(u) != len(ids) - 1:
            raise ValueError("not a tree")
        below, size, enter = own.copy(), np.ones(len(ids), np.int64), np.empty(len(ids), np.int64)
        enter[order] = np.arange(len(ids))
        for x in reversed(order[1:]):
            below[parent[x]] += below[x]
            size[parent[x]] += size[x]
        child = np.array(order[1:], int)
        up = np.array([parent[x] for x in order[1:]], int)
        k, total = 2 * len(child), below[0]
        node, nbr = np.concatenate([up, child]), np.concatenate([child, up])
        pop = np.concatenate([below[child], total - below[child]])
        stretch = [np.tile(enter[child], 2), np.tile(enter[child] + size[child] - 1, 2), np.repeat([True, False], len(child))]
        return pa.table([t.column("tree_id").take(pa.array(np.zeros(k, int))), ids[node], ids[nbr], own[node], pop, np.full(k, total), *stretch], names=schema.names)

    return ends.groupBy("tree_id").applyInArrow(one, schema)


def _fits(a: Column, b: Column, balance: Balance) -> Column:
    out = F.lit(False)
    for i, j in (balance.sides, balance.sides[::-1]):
        out = out | (a.between(i * balance.low, i * balance.high) & b.between(j * balance.low, j * balance.high))
    return out


def cuttable_edges(hung: DataFrame, balance: Balance) -> DataFrame:
    """tree_id, u < v, pop: edges that leave both sides a whole number of districts; pop is that of v's side."""
    return hung.filter((F.col("node") < F.col("nbr")) & _fits(F.col("pop"), F.col("total") - F.col("pop"), balance)).select("tree_id", F.col("node").alias("u"), F.col("nbr").alias("v"), "pop")


def cut_probabilities(cuttable: DataFrame) -> DataFrame:
    """``cuttable`` with log_probability: of this edge being drawn among those of its tree."""
    return cuttable.withColumn("log_probability", -F.log(F.count("*").over(Window.partitionBy("tree_id")).cast("double")))


def cuttable_nodes(hung: DataFrame, balance: Balance) -> DataFrame:
    """tree_id, node, own, side, rest: nodes that may be opened, and each sum of subsets of what hangs on them that allows it."""
    kinds = T.ArrayType(T.DoubleType())

    @F.pandas_udf(kinds)
    def sums(own: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([splitting_sums(o, list(p), balance) for o, p in zip(own, parts, strict=True)])

    per = hung.groupBy("tree_id", "node").agg(F.first("own").alias("own"), F.collect_list("pop").alias("parts"), F.first("total").alias("total"))
    out = per.select("tree_id", "node", "own", "total", F.explode(sums("own", "parts")).alias("side"))
    return out.select("tree_id", "node", "own", "side", (F.col("total") - F.col("own") - F.col("side")).alias("rest"))


def edge_pairs(parts: DataFrame, low: float, high: float) -> DataFrame:
    """tree_id, u1, v1, u2, v2 (u < v, first edge before second), first, second, third: pairs of edges whose removal leaves three parts within bounds.

    parts: ``sides``. Two of the parts are what is beyond an edge, away from the
    other one; their people are within bounds, and so is their sum within those
    that it leaves to the third. Sides are put into bins of population as wide as
    these bounds, so that a side meets those of two or three bins of its tree
    alone; of what it meets, stretches of the walk tell whether they overlap.
    """
    width = max(high - low, 1e-9 * max(1.0, abs(high)))
    ends = parts.filter(F.col("pop").between(low, high)).select("tree_id", F.least("node", "nbr").alias("u"), F.greatest("node", "nbr").alias("v"), "pop", "total", "enter", "leave", "inner")
    a = ends.select("tree_id", "total", *[F.col(c).alias(f"{c}1") for c in ("u", "v", "pop", "enter", "leave", "inner")])
    b = ends.select("tree_id", F.floor(F.col("pop") / width).alias("bin"), *[F.col(c).alias(f"{c}2") for c in ("u", "v", "pop", "enter", "leave", "inner")])
    rest = F.col("total") - F.col("pop1")
    bins = F.sequence(F.floor((rest - high) / width) - 1, F.floor((rest - low) / width) + 1)
    met = a.withColumn("bin", F.explode(bins)).join(b, ["tree_id", "bin"]).filter("u1 < u2 OR (u1 = u2 AND v1 < v2)")
    third = F.col("total") - F.col("pop1") - F.col("pop2")
    inside = lambda x, y: (F.col(f"enter{y}") <= F.col(f"enter{x}")) & (F.col(f"leave{x}") <= F.col(f"leave{y}"))
    apart = (F.col("leave1") < F.col("enter2")) | (F.col("leave2") < F.col("enter1"))
    disjoint = F.when(F.col("inner1") & F.col("inner2"), apart).when(F.col("inner1"), inside(1, 2)).when(F.col("inner2"), inside(2, 1)).otherwise(F.lit(False))
    out = met.filter(third.between(low, high) & disjoint)
    return out.select("tree_id", "u1", "v1", "u2", "v2", F.col("pop1").alias("first"), F.col("pop2").alias("second"), third.alias("third"))
