"""Graph and tree operators over many plans or trees: each plan, district or tree is a group of its own.

Groups are as large as one graph, whatever the number of plans; they run in
parallel through Arrow-batched grouped maps. Degrees and neighbour lists are
plain aggregates.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.sources.shared import written


def inner_edges(edges: DataFrame, plans: DataFrame, weight: str = "connections") -> DataFrame:
    """plan_id, district, u, v, w: edges inside a district, without those of weight 0.

    Plans compress to a few bytes a hundred rows, so that Spark would take the
    rows of many for small enough to be held by the driver and every task.
    """
    a = plans.select("plan_id", F.col("node").alias("u"), "district").hint("merge")
    b = plans.select(F.col("plan_id").alias("p2"), F.col("node").alias("v"), F.col("district").alias("d2")).hint("merge")
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col(weight).cast("double").alias("w")).filter("w <> 0")
    j = e.join(a, "u").join(b, (F.col("plan_id") == F.col("p2")) & (e.v == b.v)).filter(F.col("district") == F.col("d2"))
    return j.select("plan_id", "district", "u", e.v, "w")


class UnionFind:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        path = []
        while self.up.setdefault(x, x) != x:
            path.append(x)
            x = self.up[x]
        for p in path:
            self.up[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def component_labels(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, district, node, component: the least node connected to each inside its district."""
    links = inner_edges(edges, plans).select("plan_id", "district", "u", "v")
    rows = links.unionByName(plans.select("plan_id", "district", F.col("node").alias("u"), F.col("node").alias("v")))
    return label_groups(rows, ["plan_id", "district"])


def label_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component: the least node connected to each by the links(u, v) of its group, which hold (x, x) for every node."""
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keys] + [T.StructField(c, T.LongType()) for c in ("node", "component")])

    def label(t: pa.Table) -> pa.Table:  # in Arrow, where a plan's id of any type passes as it is
        uf = UnionFind()
        for u, v in zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True):
            uf.join(u, v)
        nodes = sorted(uf.up)
        first = t.select(keys).take(pa.array(np.zeros(len(nodes), np.int64)))
        return first.append_column("node", pa.array(nodes, pa.int64())).append_column("component", pa.array([uf.find(x) for x in nodes], pa.int64()))

    return rows.groupBy(*keys).applyInArrow(label, schema)


STARS = ["plan_id", "district", "u"]


def _flip(e: DataFrame) -> DataFrame:
    return e.select("plan_id", "district", F.col("v").alias("u"), F.col("u").alias("v"))


def _star_round(e: DataFrame) -> DataFrame:
    """Large-star and small-star over edges u > v of every plan and district: each node's larger neighbours move to the least it knows, then its smaller ones."""
    both = e.unionByName(_flip(e))
    least = both.groupBy(*STARS).agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")).hint("merge")
    large = written(both.filter("v > u").join(least, STARS).select("plan_id", "district", F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large_star")
    low = large.groupBy(*STARS).agg(F.min("v").alias("least"))
    moved = large.join(low.hint("merge"), STARS).filter("v <> least").select("plan_id", "district", F.col("v").alias("u"), F.col("least").alias("v"))
    return written(moved.unionByName(low.withColumnRenamed("least", "v")).distinct(), "small_star")


#: Ids side by side that a task labels before the rounds.
CHUNK = 1 << 16


def component_labels_by_rounds(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """As ``component_labels``, for districts that are too large for a task: alternating stars, all plans and districts at once.

    Where ids are dense, stretches of ``CHUNK`` of them are labelled first, and
    what is connected in one goes on as a single node. A round is joins and
    aggregates on (plan, district, node), written to the shared folder; their
    number grows with the logarithm of the nodes.
    """
    ids = plans.agg(F.count_distinct("node"), F.min("node"), F.max("node")).first()
    links = inner_edges(edges, plans).filter("u <> v").select("plan_id", "district", "u", "v")
    if not ids[0] or ids[2] - ids[1] > 16 * ids[0]:
        return _by_stars(links, plans)
    chunk = lambda c: F.floor(F.col(c) / CHUNK)
    place = F.struct(F.col("district").alias("d"), chunk("node").alias("c"))
    first = component_labels(edges, plans.withColumn("district", place)).select("plan_id", F.col("district.d").alias("district"), "node", F.col("component").alias("part"))
    first = written(first, "chunks")
    across = links.filter(chunk("u") != chunk("v"))
    for end in ("u", "v"):
        name = first.select("plan_id", "district", F.col("node").alias(end), F.col("part").alias(f"{end}_part")).hint("merge")
        across = across.join(name, ["plan_id", "district", end])
    across = across.select("plan_id", "district", F.col("u_part").alias("u"), F.col("v_part").alias("v")).distinct()
    roots = _by_stars(across, first.filter("node = part").select("plan_id", "district", "node")).withColumnRenamed("node", "part")
    return first.join(roots.hint("merge"), ["plan_id", "district", "part"]).select("plan_id", "district", "node", "component")


def _by_stars(links: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, district, node, component: of the rows of plans, linked by links(plan_id, district, u, v)."""
    e = written(links.select("plan_id", "district", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64(*STARS, "v").cast("decimal(38,0)"))).first()
    before = state(e)
    while before[0]:
        e = _star_round(e)
        if (now := state(e)) == before:
            break
        before = now
    roots = e.select("plan_id", "district", F.col("u").alias("node"), F.col("v").alias("component"))  # every node hangs on its least
    rows = plans.select("plan_id", "district", "node").join(roots.hint("merge"), ["plan_id", "district", "node"], "left")
    return rows.select("plan_id", "district", F.col("node").cast("long").alias("node"), F.coalesce("component", "node").cast("long").alias("component"))


def connected(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, district, components, connected."""
    k = F.count_distinct("component")
    return component_labels(edges, plans).groupBy("plan_id", "district").agg(k.alias("components"), (k == 1).alias("connected"))


def log_tree_count(u: np.ndarray, v: np.ndarray, w: np.ndarray, nodes: np.ndarray) -> float:
    """Logarithm of the weighted number of spanning trees; -inf if not connected, 0 for one node."""
    n = len(nodes)
    if n <= 1:
        return 0.0
    a, b = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
    # decided exactly: a small determinant is no sign of a district in parts
    uf, parts = UnionFind(), n
    for x, y in zip(a[w > 0].tolist(), b[w > 0].tolist(), strict=True):
        parts -= uf.join(x, y)
    if parts > 1:
        return -np.inf
    lap = np.zeros((n, n))
    np.add.at(lap, (a, b), -w)
    np.add.at(lap, (b, a), -w)
    lap[np.arange(n), np.arange(n)] = -lap.sum(1)
    return float(np.linalg.slogdet(lap[1:, 1:])[1])


def log_spanning_trees(edges: DataFrame, plans: DataFrame, weight: str = "connections") -> DataFrame:
    """plan_id, district, log_trees. Districts with the same nodes are computed once, whatever the number of plans that share them."""
    sets = plans.groupBy("plan_id", "district").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    sets = sets.withColumn("key", F.sha2(F.array_join("nodes", ","), 256))
    distinct = sets.groupBy("key").agg(F.first("nodes").alias("nodes"))
    members = distinct.select("key", F.explode("nodes").alias("node"))
    m = members.select(F.col("key").alias("plan_id"), "node", F.lit(0).alias("district"))
    rows = inner_edges(edges, m, weight).select(F.col("plan_id").alias("key"), "u", "v", "w")
    rows = rows.unionByName(members.select("key", F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("w")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.u != pdf.v]
        nodes = np.unique(pdf.u[pdf.u == pdf.v].to_numpy())
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "log_trees": [log_tree_count(e.u.to_numpy(), e.v.to_numpy(), e.w.to_numpy(), nodes)]})

    counts = rows.groupBy("key").applyInPandas(one, "key string, log_trees double")
    return sets.select("plan_id", "district", "key").join(counts, "key").drop("key")


def log_spanning_forests(trees: DataFrame) -> DataFrame:
    return trees.groupBy("plan_id").agg(F.sum("log_trees").alias("log_forests"))


def tree_count_ratio(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """old_plan, new_plan, log_ratio: logarithm of new over old number of spanning forests."""
    f = log_spanning_forests(trees)
    a, b = (f.select(F.col("plan_id").alias(f"{x}_plan"), F.col("log_forests").alias(x)) for x in ("old", "new"))
    return pairs.join(a, "old_plan").join(b, "new_plan").select("old_plan", "new_plan", (F.col("new") - F.col("old")).alias("log_ratio"))


def arcs(trees: DataFrame) -> DataFrame:
    return trees.unionByName(trees.select("tree_id", F.col("v").alias("u"), F.col("u").alias("v")))


def neighbour_lists(trees: DataFrame) -> DataFrame:
    return arcs(trees).groupBy("tree_id", F.col("u").alias("node")).agg(F.array_sort(F.collect_list("v")).alias("neighbours"))


def degrees(trees: DataFrame) -> DataFrame:
    return arcs(trees).groupBy("tree_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def degree_distribution(trees: DataFrame) -> DataFrame:
    return degrees(trees).groupBy("tree_id", "degree").agg(F.count("*").alias("nodes")).orderBy("tree_id", "degree")


def average_degree(trees: DataFrame) -> DataFrame:
    return degrees(trees).groupBy("tree_id").agg(F.avg("degree").alias("average_degree"))


def _adjacency(u, v) -> dict[int, list[int]]:
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(u, v, strict=True):
        near[a].append(b)
        near[b].append(a)
    return near


def hops(near: dict[int, list[int]], start: int) -> dict[int, int]:
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def centres(near: dict[int, list[int]]) -> list[int]:
    """The middle of a longest path: one or two nodes."""
    far = max(hops(near, min(near)).items(), key=lambda x: (x[1], -x[0]))[0]
    down = hops(near, far)
    end = max(down.items(), key=lambda x: (x[1], -x[0]))[0]
    path = [end]
    while path[-1] != far:
        path.append(next(y for y in near[path[-1]] if down[y] == down[path[-1]] - 1))
    n = len(path)
    return sorted({path[(n - 1) // 2], path[n // 2]})


def _per_tree(trees: DataFrame, f, schema: str) -> DataFrame:
    kind = trees.schema["tree_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(_adjacency(pdf.u, pdf.v))
        return out.assign(tree_id=pdf.tree_id.iloc[0])

    return trees.groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, {schema}")


def distances(trees: DataFrame, start: int) -> DataFrame:
    """tree_id, node, hops from one node."""
    return _per_tree(trees, lambda near: pd.DataFrame(sorted(hops(near, start).items()), columns=["node", "hops"]), "node long, hops int")


def tree_reach(trees: DataFrame) -> DataFrame:
    """tree_id, reached: nodes of the component of the least node, itself included; all of them, if the edges are one tree."""
    return _per_tree(trees, lambda near: pd.DataFrame({"reached": [len(hops(near, min(near)))]}), "reached long")


def diameters(trees: DataFrame) -> DataFrame:
    """tree_id, diameter in edges: the farthest node from a farthest node."""

    def one(near):
        first = hops(near, min(near))
        return pd.DataFrame({"diameter": [max(hops(near, max(first, key=first.get)).values())]})

    return _per_tree(trees, one, "diameter int")


def centres_and_leaves(trees: DataFrame) -> DataFrame:
    """tree_id, node, is_centre, is_leaf: of the nodes that are one of them."""

    def one(near):
        c = set(centres(near))
        rows = [(x, x in c, len(near[x]) == 1) for x in sorted(near) if x in c or len(near[x]) == 1]
        return pd.DataFrame(rows, columns=["node", "is_centre", "is_leaf"])

    return _per_tree(trees, one, "node long, is_centre boolean, is_leaf boolean")


def centre_moment(trees: DataFrame, p: float = 1.0, leaves_only: bool = False) -> DataFrame:
    """tree_id, moment: L^p mean over nodes (or leaves) of the mean distance to the centres."""

    def one(near):
        each = [hops(near, c) for c in centres(near)]
        nodes = [x for x in near if not leaves_only or len(near[x]) == 1]
        d = np.array([np.mean([h[x] for h in each]) for x in nodes])
        return pd.DataFrame({"moment": [float(np.mean(d**p) ** (1 / p))]})

    return _per_tree(trees, one, "moment double")


def subtree_masses(trees: DataFrame, root: int, masses: DataFrame) -> DataFrame:
    """tree_id, node, mass: of the node and all below it, the tree hanging from ``root``. masses: (node, mass)."""
    order_schema = "node long, parent long, depth int"

    def one(near):
        depth = hops(near, root)
        rows = [(x, next((y for y in near[x] if depth[y] == d - 1), -1), d) for x, d in depth.items()]
        return pd.DataFrame(rows, columns=["node", "parent", "depth"])

    placed = _per_tree(trees, one, order_schema).join(masses, "node")
    kind = trees.schema["tree_id"].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip(pdf.node, pdf.mass.astype(float), strict=True))
        for x, parent in pdf.sort_values("depth", ascending=False)[["node", "parent"]].itertuples(index=False):
            if parent >= 0:
                total[parent] += total[x]
        return pd.DataFrame({"tree_id": pdf.tree_id.iloc[0], "node": list(total), "mass": list(total.values())})

    return placed.groupBy("tree_id").applyInPandas(fold, f"tree_id {kind}, node long, mass double")


def district_roots(labels: DataFrame) -> DataFrame:
    """plan_id, district, root: the least node of each district."""
    return labels.groupBy("plan_id", "district").agg(F.min("component").alias("root"))
