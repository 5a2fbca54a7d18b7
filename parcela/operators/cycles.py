"""Cycles of a two-tree move as rows cycle(cycle_id, pos from 1, weight), n_u positions of which lie in the first district.

All operators partition by cycle, so that cycles of any number run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_choice(table: DataFrame, keys: list[str], order: str, weight: str, draw: str) -> DataFrame:
    """The first row of each group whose running share of the weight exceeds ``draw`` (0..1): a weighted categorical sample."""
    w = Window.partitionBy(*keys).orderBy(order)
    share = table.withColumn("running", F.sum(weight).over(w)).withColumn("total", F.sum(weight).over(Window.partitionBy(*keys)))
    hit = share.filter(F.col("running") > F.col(draw) * F.col("total"))
    return hit.groupBy(*keys).agg(F.min_by(order, "running").alias("chosen"))


def inverse_path_weights(path: DataFrame) -> DataFrame:
    """cycle_id, pos, running: running sums of 1 / weight along a path."""
    w = Window.partitionBy("cycle_id").orderBy("pos")
    return path.select("cycle_id", "pos", F.sum(1.0 / F.col("weight")).over(w).alias("running"))


def collapsed_weights(masses: DataFrame) -> DataFrame:
    """cycle_id, pos, weight: what hangs off each node of a path alone, from the masses of nested subtrees in order of size."""
    w = Window.partitionBy("cycle_id").orderBy("pos")
    return masses.select("cycle_id", "pos", (F.col("mass") - F.coalesce(F.lag("mass").over(w), F.lit(0))).alias("weight"))


def _weights(cycle: DataFrame) -> DataFrame:
    """cycle_id, weights: one row a cycle, its weights in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col("weight").cast("double").alias("weight"))))
    return cycle.groupBy("cycle_id").agg(F.transform(pairs, lambda p: p["weight"]).alias("weights"))


def _prefix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all lists' values up to each place, from 0; and where each list begins, and the last ends."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.concatenate([[0.0], np.cumsum(values)]), starts


def cut_arcs(cycle: DataFrame, low: float, high: float, current: DataFrame | None = None) -> DataFrame:
    """cycle_id, a, b, pop: arcs a..b (b short of the end) whose weight and remainder both lie in low..high.

    Prefix sums are sorted, so that the ends of the arcs from each position are
    found by search, for all cycles of a batch together: what is made are arcs
    found. ``current`` rows (cycle_id, b) take out the cut that stands, 1..b.
    """
    schema = T.StructType([cycle.schema["cycle_id"], *T.StructType.fromDDL("a int, b int, pop double").fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, starts = _prefix(batch.column(1))
            of = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            total = (upto[starts[1:]] - upto[starts[:-1]])[of]
            least, most, place = np.maximum(low, total - high), np.minimum(high, total - low), np.arange(len(of))
            slack = 1e-9 * max(1.0, abs(upto[-1]))  # the range is a little wide, and what it holds is then looked at
            first = np.maximum(place, np.searchsorted(upto, upto[:-1] + least - slack) - 1)
            last = np.minimum(starts[of + 1] - 2, np.searchsorted(upto, upto[:-1] + most + slack, side="right") - 2)
            k = np.maximum(0, last - first + 1)
            a = np.repeat(place, k)
            b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)
            pop, whole = upto[b + 1] - upto[a], total[a]
            ok = (pop >= low) & (pop <= high) & (whole - pop >= low) & (whole - pop <= high)
            a, b, pop = a[ok], b[ok], pop[ok]
            before = starts[of[a]] - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[a])), pa.array(a - before, pa.int32()), pa.array(b - before, pa.int32()), pa.array(pop)], names=schema.names)

    out = _weights(cycle).mapInArrow(search, schema)
    if current is not None:
        out = out.join(current.select("cycle_id", F.lit(1).alias("a"), "b"), ["cycle_id", "a", "b"], "left_anti")
    return out


def cuttable_pairs(cycles: DataFrame, arcs: DataFrame) -> DataFrame:
    """cycle_id, pairs: arcs found, and the one that stands. cycles: (cycle_id)."""
    k = arcs.groupBy("cycle_id").agg(F.count("*").alias("k"))
    return cycles.join(k, "cycle_id", "left").select("cycle_id", (F.coalesce("k", F.lit(0)) + 1).alias("pairs"))


def unique_cuttable_edges(cycles: DataFrame, arcs: DataFrame) -> DataFrame:
    """cycle_id, edges: distinct cut positions, with 1 and n_u + 1 always among them. cycles: (cycle_id, n, n_u)."""
    own = cycles.select("cycle_id", F.explode(F.array(F.lit(1).cast("long"), (F.col("n_u") + 1).cast("long"))).alias("at"))
    more = arcs.join(cycles, "cycle_id").select("cycle_id", F.explode(F.array(F.col("a").cast("long"), (F.col("b") % F.col("n") + 1).cast("long"))).alias("at"))
    return own.unionByName(more).groupBy("cycle_id").agg(F.count_distinct("at").alias("edges"))


def overlaps(cycle: DataFrame, cycles: DataFrame, arcs: DataFrame) -> DataFrame:
    """cycle_id, a, b, n_u, overlap, total: weight whose side an arc changes. A cycle meets its arcs in one row, where prefix sums are read by place."""
    schema = T.StructType([cycle.schema["cycle_id"], *T.StructType.fromDDL("a int, b int, n_u long, overlap double, total double").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, starts = _prefix(batch.column(1))
            found = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            a, b = (found.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            base, n, n_u = starts[of], np.diff(starts)[of], batch.column(2).to_numpy(zero_copy_only=False)[of]
            sums = lambda x: upto[base + np.clip(x, 0, n)] - upto[base]
            inside = np.where(a <= n_u, sums(np.minimum(n_u, b)) - sums(a - 1), np.where(a > n_u + 1, sums(a - 1) - sums(n_u), 0.0))
            after = np.where(b < n, sums(n) - sums(np.maximum(n_u, b)), 0.0)
            columns = [batch.column(0).take(pa.array(of)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n_u, pa.int64()), pa.array(inside + after), pa.array(sums(n))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    pairs = arcs.groupBy("cycle_id").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("arcs"))
    rows = _weights(cycle).join(cycles.select("cycle_id", F.col("n_u").cast("long").alias("n_u")), "cycle_id").join(pairs, "cycle_id")
    return rows.select("cycle_id", "weights", "n_u", "arcs").mapInArrow(read, schema)


def swappable(found: DataFrame, cycles: DataFrame) -> DataFrame:
    """cycle_id, most, average: share of the total that an arc swaps; the average counts the standing cut as 0. cycles: (cycle_id, total)."""
    less = F.least(F.col("overlap"), F.col("total") - F.col("overlap"))
    per = found.groupBy("cycle_id").agg(F.max(less).alias("m"), F.sum(less).alias("s"), F.count("*").alias("k"))
    j = cycles.select("cycle_id", F.col("total").alias("all")).join(per, "cycle_id", "left").na.fill(0, ["m", "s", "k"])
    return j.select("cycle_id", (F.col("m") / F.col("all")).alias("most"), (F.col("s") / ((F.col("k") + 1) * F.col("all"))).alias("average"))


def mark_stays(found: DataFrame, mark: Column, swap: Column) -> DataFrame:
    """``found`` with stays: whether the districts keep their sides, from the position of a marked node and whether its label is to be swapped.

    The marked node lies in the first district where its position is up to n_u,
    and on the arc's side where the arc holds it. Labels stay if it changes sides
    just where they are swapped.
    """
    moves = (mark <= F.col("n_u")) != mark.between(F.col("a"), F.col("b"))
    return found.withColumn("stays", ~(moves != ~swap))


def changed_mass(found: DataFrame, stays: str | None = None) -> DataFrame:
    """cycle_id, a, b, changed: the overlap, or what is left of the total where column ``stays`` is false; without such a column, the less of both."""
    rest = F.col("total") - F.col("overlap")
    changed = F.least(F.col("overlap"), rest) if stays is None else F.when(F.col(stays), F.col("overlap")).otherwise(rest)
    return found.select("cycle_id", "a", "b", changed.alias("changed"))
