"""Constraints on plans, compiled to one boolean a plan. Cheap ones are aggregates; only plans that pass them reach the matching."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.sources.shared import written

from .nodesets import shared_units
from .observables import district_sums


@dataclass(frozen=True)
class Population:
    low: float
    high: float
    population: str = "pop"

    @classmethod
    def around(cls, total: float, districts: int, tolerance: float, ideal: float | None = None, population: str = "pop") -> Population:
        ideal = total / districts if ideal is None else ideal
        return cls(math.ceil((1 - tolerance) * ideal), math.floor((1 + tolerance) * ideal), population)

    def check(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        pops = district_sums(nodes, plans, self.population)
        return pops.groupBy("plan_id").agg(F.bool_and(F.col(self.population).between(self.low, self.high)).alias("ok"))


@dataclass(frozen=True)
class PackNodes:
    """Each unit of n ideal districts must hold at least floor(n) - unpack whole districts.

    With ``districts``, plans of fewer ones are being built: what such a plan has
    not yet claimed of a unit counts for floor(rest / ideal) districts.
    """

    unit: str
    ideal: float
    unpack: int = 0
    population: str = "pop"
    districts: int | None = None

    def targets(self, nodes: DataFrame) -> DataFrame:
        t = nodes.groupBy(self.unit).agg((F.floor(F.sum(self.population) / self.ideal) - self.unpack).alias("target"))
        return t.filter("target > 0")

    def check(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        units = plans.join(nodes.select(F.col("id").alias("node"), self.unit), "node").groupBy("plan_id", "district", self.unit).agg(F.count("*").alias("n"))
        per = units.groupBy("plan_id", "district").agg(F.min(self.unit).alias(self.unit), F.count("*").alias("k"))
        whole = per.filter("k = 1").groupBy("plan_id", self.unit).agg(F.count("*").alias("packed"))
        every = units.select("plan_id", self.unit).distinct().join(self.targets(nodes), self.unit)
        if self.districts is not None:  # a unit that no district has reached has to be asked as well
            every = plans.select("plan_id").distinct().join(F.broadcast(self.targets(nodes)))  # one row a unit over the ideal
        got = every.join(whole, ["plan_id", self.unit], "left").withColumn("packed", F.coalesce("packed", F.lit(0)))
        if self.districts is not None:
            pops = nodes.select(F.col("id").alias("node"), self.unit, F.col(self.population).alias("people"))
            size = pops.groupBy(self.unit).agg(F.sum("people").alias("size"))
            claimed = plans.join(pops, "node").groupBy("plan_id", self.unit).agg(F.sum("people").alias("claimed"))
            number = plans.groupBy("plan_id").agg(F.count_distinct("district").alias("number"))
            got = got.join(claimed, ["plan_id", self.unit], "left").join(size, self.unit).join(number, "plan_id")
            rest = F.floor((F.col("size") - F.coalesce("claimed", F.lit(0))) / self.ideal)
            got = got.withColumn("packed", F.col("packed") + F.when((F.col("number") < self.districts) & (F.col("packed") < F.col("target")), rest).otherwise(0))
        out = got.groupBy("plan_id").agg(F.bool_and(F.col("packed") >= F.col("target")).alias("ok"))
        return plans.select("plan_id").distinct().join(out, "plan_id", "left").select("plan_id", F.coalesce("ok", F.lit(True)).alias("ok"))


@dataclass(frozen=True)
class MaxCoarseSplits:
    unit: str
    most: int

    def splits(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        """plan_id, splits: units counted once for each district they reach into, less the number of units."""
        j = plans.join(nodes.select(F.col("id").alias("node"), self.unit), "node")
        return j.groupBy("plan_id").agg((F.count_distinct("district", self.unit) - F.count_distinct(self.unit)).alias("splits"))

    def check(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        return self.splits(nodes, plans).select("plan_id", (F.col("splits") <= self.most).alias("ok"))


@dataclass(frozen=True)
class MaxSharedCoarse:
    """No two districts reach into more than ``most`` of the same units."""

    unit: str
    most: int

    def check(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        worst = shared_units(plans, nodes, self.unit).groupBy("plan_id").agg(F.max("shared").alias("worst"))
        return plans.select("plan_id").distinct().join(worst, "plan_id", "left").select("plan_id", (F.coalesce("worst", F.lit(0)) <= self.most).alias("ok"))


@dataclass(frozen=True)
class AllowedExcess:
    """A unit under one ideal district may meet excess + 2 districts, a larger one ceil(n) + excess."""

    unit: str
    ideal: float
    excess: int = 0
    population: str = "pop"

    def check(self, nodes: DataFrame, plans: DataFrame) -> DataFrame:
        j = plans.join(nodes.select(F.col("id").alias("node"), self.unit, F.col(self.population).alias("pop")), "node")
        u = j.groupBy("plan_id", self.unit).agg(F.sum("pop").alias("pop"), F.count_distinct("district").alias("k"))
        most = F.when(F.col("pop") < self.ideal, self.excess + 2).otherwise(F.ceil(F.col("pop") / self.ideal) + self.excess)
        return u.groupBy("plan_id").agg(F.bool_and(F.col("k") <= most).alias("ok"))


@dataclass(frozen=True)
class ContiguousTraversals:
    """What a district uses of a unit must be connected."""

    unit: str

    def check(self, nodes: DataFrame, plans: DataFrame, edges: DataFrame) -> DataFrame:
        from .trees import component_labels

        parts = plans.join(nodes.select(F.col("id").alias("node"), F.col(self.unit).cast("string").alias("u")), "node")
        labels = component_labels(edges, parts.select("plan_id", "node", F.concat_ws("|", "district", "u").alias("district")))
        per = labels.groupBy("plan_id", "district").agg(F.count_distinct("component").alias("k"))
        return per.groupBy("plan_id").agg(F.bool_and(F.col("k") <= 1).alias("ok"))


def intersection_matrix(nodes: DataFrame, initial: DataFrame, plans: DataFrame, population: str = "pop") -> DataFrame:
    """plan_id, d0 (initial district), d1, pop."""
    first = initial.select("node", F.col("district").alias("d0"))
    pops = nodes.select(F.col("id").alias("node"), F.col(population).alias("pop"))
    return plans.join(first, "node").join(pops, "node").groupBy("plan_id", "d0", F.col("district").alias("d1")).agg(F.sum("pop").alias("pop"))


def best_assignment(value: np.ndarray) -> np.ndarray:
    """Column for each row of a square matrix, with the largest total: Hungarian method with potentials."""
    cost, n = value.max() - value, len(value)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = np.concatenate([[np.inf], cost[i0 - 1] - u[i0] - v[1:]])
            better = ~used & (reduced < slack)
            slack[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, slack)))
            delta = slack[j1]
            u[match[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


@dataclass(frozen=True)
class MaxHamming:
    """Districts are matched to the initial ones by most people in common; the distance is the mean or the largest share moved."""

    most: float
    norm: str = "1"
    population: str = "pop"

    def distances(self, nodes: DataFrame, initial: DataFrame, plans: DataFrame) -> DataFrame:
        norm = self.norm

        def one(t: pa.Table) -> pa.Table:  # in Arrow, where a plan's id of any type passes as it is
            d0, d1, pop = (t.column(c).to_numpy() for c in ("d0", "d1", "pop"))
            rows, columns = (np.unique(d, return_inverse=True)[1] for d in (d0, d1))
            m = np.zeros((rows.max() + 1, columns.max() + 1))
            np.add.at(m, (rows, columns), pop.astype(float))
            k = max(m.shape)
            full = np.zeros((k, k))
            full[: m.shape[0], : m.shape[1]] = m
            to = best_assignment(full)
            kept = full[np.arange(k), to]
            before, after = full.sum(1), full.sum(0)[to]
            with np.errstate(invalid="ignore", divide="ignore"):
                moved = (np.nan_to_num(1 - kept / before) + np.nan_to_num(1 - kept / after)) / 2
            return pa.table({"plan_id": t.column("plan_id").slice(0, 1), "distance": [float(moved.mean() if norm == "1" else moved.max())]})

        matrix = intersection_matrix(nodes, initial, plans, self.population)
        kind = matrix.schema["plan_id"].dataType
        schema = T.StructType([T.StructField("plan_id", kind), T.StructField("distance", T.DoubleType())])
        return matrix.groupBy("plan_id").applyInArrow(one, schema)

    def check(self, nodes: DataFrame, plans: DataFrame, initial: DataFrame) -> DataFrame:
        return self.distances(nodes, initial, plans).select("plan_id", (F.col("distance") <= self.most).alias("ok"))


class Constraints(dict):
    """At most one constraint of each type; the last one added wins."""

    def add(self, constraint) -> Constraints:
        self[type(constraint)] = constraint
        return self


def satisfied(constraints: Constraints, nodes: DataFrame, plans: DataFrame, edges: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """plan_id, ok: all constraints hold. Aggregates come first; costly checks see only the plans that are left."""
    order = [Population, PackNodes, MaxCoarseSplits, MaxSharedCoarse, AllowedExcess, ContiguousTraversals, MaxHamming]
    out, left = plans.select("plan_id").distinct(), plans
    for kind in order:
        if kind not in constraints:
            continue
        c = constraints[kind]
        extra = {ContiguousTraversals: {"edges": edges}, MaxHamming: {"initial": initial}}.get(kind, {})
        # written, as the next check reads it several times
        passed = written(c.check(nodes, left, **extra).filter("ok").select("plan_id"), "passed")
        left = plans.join(passed, "plan_id", "left_semi")
    good = left.select("plan_id").distinct().withColumn("good", F.lit(True))
    return out.join(good, "plan_id", "left").select("plan_id", F.coalesce("good", F.lit(False)).alias("ok"))
