"""Ensembles as arrays: a plan is one row (plan_id, districts), the district of each node in order of id.

That is how chains write their plans. Observables are evaluated inside the row,
over a graph that every task holds (checked to ``LOCAL_EDGES``), so that a
million plans are read once and nothing is shuffled on nodes or edges. Larger
graphs take the joins of ``observables`` over ``as_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.spec import Graph

LOCAL_EDGES = 4_000_000
#: Plans times edges that a task looks at together.
CELLS = 4_000_000


@dataclass
class GraphArrays:
    """A graph with nodes by place in the order of ids; edges of weight 0 are left out."""

    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    nodes: dict[str, np.ndarray]
    edges: dict[str, np.ndarray]

    @classmethod
    def of(cls, graph: Graph, bound: int | None = None) -> GraphArrays | None:
        """None for a graph of more edges or nodes than the bound."""
        bound = LOCAL_EDGES if bound is None else bound
        if graph.edges.limit(bound + 1).count() > bound or graph.nodes.limit(bound + 1).count() > bound:
            return None
        n = graph.nodes.toPandas().sort_values("id", ignore_index=True)
        e = graph.edges.toPandas()
        e = e[e[graph.spec.edge_weight] != 0]
        ids = n.id.to_numpy()
        place = lambda c: np.searchsorted(ids, e[c].to_numpy())
        return cls(ids, place("src"), place("dst"), {c: n[c].to_numpy() for c in n}, {c: e[c].to_numpy() for c in e if c not in ("src", "dst")})


#: Stands for the district of a node that a plan doesn't hold; a null in the array.
ABSENT = -(2**31)


def as_arrays(plans: DataFrame, g: GraphArrays) -> DataFrame:
    """plan_id, districts: from rows (plan_id, node, district), each district at its node's place; null where a plan doesn't hold a node."""
    shared = plans.sparkSession.sparkContext.broadcast(g.ids)
    kind = plans.schema["plan_id"].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for b in batches:
            for one in (b.slice(i, 1) for i in range(b.num_rows)):
                pairs = one.column(1).flatten()
                node, district = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                if (ids[at] != node).any():
                    raise ValueError(f"a plan has nodes that the graph lacks, as {node[ids[at] != node][0]}")
                d = np.full(len(ids), ABSENT, np.int32)
                d[at] = district
                values = pa.array(d, mask=d == ABSENT)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), values)], ["plan_id", "districts"])

    held = plans.filter(F.col("node").isNotNull() & F.col("district").isNotNull())
    pairs = F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("district").cast("int").alias("district"))).alias("pairs")
    schema = T.StructType([T.StructField("plan_id", kind), T.StructField("districts", T.ArrayType(T.IntegerType()))])
    return held.groupBy("plan_id").agg(pairs).mapInArrow(place, schema)


def as_rows(plans: DataFrame, g: GraphArrays) -> DataFrame:
    """plan_id, node, district."""
    spark = plans.sparkSession
    ids = spark.createDataFrame([(i, int(x)) for i, x in enumerate(g.ids)], "pos int, node long")  # as long as the graph
    rows = plans.select("plan_id", F.posexplode("districts").alias("pos", "district")).filter("district IS NOT NULL")
    return rows.join(F.broadcast(ids), "pos").select("plan_id", "node", "district")


def _each(plans: DataFrame, g: GraphArrays, f: Callable, schema: str) -> DataFrame:
    """f(graph, districts as a matrix) gives the row of each value and the columns of ``schema``.

    A null in an array is ABSENT in the matrix; a plan whose array is null has no
    rows, as elsewhere; an array of another length than the graph is an error.
    """
    shared = plans.sparkSession.sparkContext.broadcast(g)
    names = ["plan_id", *[x.split()[0] for x in schema.split(", ")]]
    made = T.StructType([T.StructField("plan_id", plans.schema["plan_id"].dataType), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        step = max(1, CELLS // max(1, len(graph.src), len(graph.ids)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                lengths = set(pc.list_value_length(part.column(1)).to_pylist()) - {len(graph.ids)}
                if lengths:
                    raise ValueError(f"a plan has {lengths.pop()} places, the graph {len(graph.ids)} nodes")
                d = pc.fill_null(part.column(1).flatten(), ABSENT).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                row, *columns = f(graph, d)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *[pa.array(c) for c in columns]], names)

    return plans.select("plan_id", F.col("districts").cast("array<int>")).filter("districts IS NOT NULL").mapInArrow(run, made)


def _cut(graph: GraphArrays, d: np.ndarray) -> np.ndarray:
    """Which edges lie between two districts of each plan."""
    a, b = d[:, graph.src], d[:, graph.dst]
    return (a != b) & (a != ABSENT) & (b != ABSENT)


def cut_edges(plans: DataFrame, g: GraphArrays, column: str | None = "connections") -> DataFrame:
    """plan_id, cut_edges: as ``observables.cut_edges``, without a shuffle."""

    def one(graph: GraphArrays, d: np.ndarray):
        cut = _cut(graph, d)
        return np.arange(len(d)), cut.sum(1) if column is None else cut @ graph.edges[column].astype(float)

    return _each(plans, g, one, f"cut_edges {'long' if column is None else 'double'}")


def cross_edges(plans: DataFrame, g: GraphArrays) -> DataFrame:
    """plan_id, d1 < d2, src, dst: each edge between two districts."""

    def one(graph: GraphArrays, d: np.ndarray):
        row, e = np.nonzero(_cut(graph, d))
        a, b = d[row, graph.src[e]], d[row, graph.dst[e]]
        return row, np.minimum(a, b), np.maximum(a, b), graph.ids[graph.src[e]], graph.ids[graph.dst[e]]

    return _each(plans, g, one, "d1 int, d2 int, src long, dst long")


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of values over equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    new[:1] = True
    at = np.flatnonzero(new)
    return [k[order][at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _by_district(d: np.ndarray, *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    row, at = np.nonzero(d != ABSENT)
    return _sums([row, d[row, at]], [v[at] for v in values])


def district_sums(plans: DataFrame, g: GraphArrays, column: str, kind: str = "long") -> DataFrame:
    """plan_id, district, and the sum of a node column."""

    def one(graph: GraphArrays, d: np.ndarray):
        (row, district), (total,) = _by_district(d, graph.nodes[column])
        return row, district, total

    return _each(plans, g, one, f"district int, {column} {kind}")


def node_counts(plans: DataFrame, g: GraphArrays) -> DataFrame:
    def one(graph: GraphArrays, d: np.ndarray):
        (row, district), (n,) = _by_district(d, np.ones(len(graph.ids), np.int64))
        return row, district, n

    return _each(plans, g, one, "district int, nodes long")


def _crossing(graph: GraphArrays, d: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, e = np.nonzero(_cut(graph, d))
    return row, d[row, graph.src[e]], d[row, graph.dst[e]], graph.edges[column][e].astype(float)


def isoperimetric(plans: DataFrame, g: GraphArrays, perimeter: str = "length", area: str = "area", border: str = "border_length") -> DataFrame:
    """plan_id, district, perimeter, area, score: as ``observables.isoperimetric``."""

    def one(graph: GraphArrays, d: np.ndarray):
        (row, district), (size, own) = _by_district(d, graph.nodes[area].astype(float), graph.nodes[border].astype(float))
        at, a, b, w = _crossing(graph, d, perimeter)
        (r2, d2), (cut,) = _sums([np.concatenate([at, at]), np.concatenate([a, b])], [np.concatenate([w, w])])
        low = int(district.min(initial=0))
        span = int(district.max(initial=0)) - low + 1
        own[np.searchsorted(row * span + district - low, r2 * span + d2 - low)] += cut
        return row, district, own, size, own**2 / size

    return _each(plans, g, one, "district int, perimeter double, area double, score double")


def log_linking_edges(plans: DataFrame, g: GraphArrays, weight: str = "connections") -> DataFrame:
    """plan_id, energy: as ``observables.log_linking_edges``."""

    def one(graph: GraphArrays, d: np.ndarray):
        row, a, b, w = _crossing(graph, d, weight)
        (r, _, _), (total,) = _sums([row, np.minimum(a, b), np.maximum(a, b)], [w])
        (at,), (energy,) = _sums([r], [np.log(total)])
        return at, energy

    return _each(plans, g, one, "energy double")
