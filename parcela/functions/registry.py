"""User functions: energies and observables of plans by name, as DataFrame transformations.

An energy is a function ``f(graph, plans) -> DataFrame(plan_id, district, value)``
over all plans at once; its sum over districts enters the measure.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.operators import observables as O
from parcela.operators import trees
from parcela.spec import Graph

EnergyTable = Callable[[Graph, DataFrame], DataFrame]


def log_forests(graph: Graph, plans: DataFrame) -> DataFrame:
    return trees.log_spanning_trees(graph.edges, plans, graph.spec.edge_weight).withColumnRenamed("log_trees", "value")


def isoperimetric(exponent: float = 1.0) -> EnergyTable:
    def energy(graph: Graph, plans: DataFrame) -> DataFrame:
        scores = O.isoperimetric(graph.nodes, graph.edges, plans, graph.spec.edge_perimeter)
        return scores.select("plan_id", "district", F.pow("score", F.lit(exponent)).alias("value"))

    return energy


def district_total(column: str) -> EnergyTable:
    return lambda graph, plans: O.district_sums(graph.nodes, plans, column).withColumnRenamed(column, "value")


def partisan_margins(votes: DataFrame, election: str, first: str, second: str) -> EnergyTable:
    def observable(graph: Graph, plans: DataFrame) -> DataFrame:
        sums = O.vote_sums(votes.filter(F.col("election") == election), plans)
        return O.partisan_margins(sums, first, second).select("plan_id", "district", F.col("margin").alias("value"))

    return observable


def performance(votes: DataFrame, weights: DataFrame, candidate: str, target: int) -> EnergyTable:
    """The performance score of a plan, as one row each with district 0: votes(node, election, stage, candidate, votes), weights(election, weight)."""

    def energy(graph: Graph, plans: DataFrame) -> DataFrame:
        margins = O.performance_margins(O.vote_sums(votes, plans), candidate)
        return O.performance_score(margins, target, weights).select("plan_id", F.lit(0).alias("district"), F.col("score").alias("value"))

    return energy


def performance_to_target(votes: DataFrame, weights: DataFrame, candidate: str, minority: str | list[str], total_pop: str, districts: int) -> EnergyTable:
    """As ``performance``, with the minority's share of the population as a whole number of districts for the target."""

    def energy(graph: Graph, plans: DataFrame) -> DataFrame:
        target = O.performance_target(graph.nodes, minority, total_pop, districts).first()[0]
        return performance(votes, weights, candidate, int(target))(graph, plans)

    return energy


class Measure:
    """Weighted energies; one of weight 0 is not kept."""

    def __init__(self):
        self.energies: dict[str, tuple[EnergyTable, float, str]] = {}

    def push(self, name: str, energy: EnergyTable, weight: float, description: str = "") -> Measure:
        if weight:
            self.energies[name] = (energy, weight, description)
        return self

    def table(self, graph: Graph, plans: DataFrame) -> DataFrame:
        """plan_id, name, district, value."""
        parts = [e(graph, plans).select("plan_id", F.lit(n).alias("name"), "district", F.col("value").cast("double").alias("value")) for n, (e, _, _) in self.energies.items()]
        return reduce(DataFrame.unionByName, parts)

    def weights(self, like: DataFrame) -> DataFrame:
        rows = [(n, float(w), d) for n, (_, w, d) in self.energies.items()]
        return like.sparkSession.createDataFrame(rows, "name string, weight double, description string")

    def log_energy(self, graph: Graph, plans: DataFrame) -> DataFrame:
        return O.log_energy(self.table(graph, plans), self.weights(plans))
