"""Observables and energies of all plans at once: nodes and edges joined with plans(plan_id, node, district)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(table: DataFrame, column: str, operation=F.sum) -> DataFrame:
    """Any aggregate over one attribute."""
    return table.agg(operation(column).alias("value"))


def district_sums(nodes: DataFrame, plans: DataFrame, *columns: str) -> DataFrame:
    """plan_id, district and the sum of each column. Nodes are joined by id; the sums combine before the shuffle."""
    joined = plans.join(nodes.select(F.col("id").alias("node"), *columns), "node")
    return joined.groupBy("plan_id", "district").agg(*[F.sum(c).alias(c) for c in columns])


def node_counts(plans: DataFrame) -> DataFrame:
    return plans.groupBy("plan_id", "district").agg(F.count("*").alias("nodes"))


def cross_edges(edges: DataFrame, plans: DataFrame, weight: str = "connections") -> DataFrame:
    """plan_id, d1 < d2, and the edge: each edge between two districts once; an edge of weight 0 is no edge."""
    ends = edges.filter(F.col(weight) != 0)
    a = plans.select("plan_id", F.col("node").alias("src"), F.col("district").alias("da"))
    b = plans.select(F.col("plan_id").alias("p2"), F.col("node").alias("dst"), F.col("district").alias("db"))
    joined = ends.join(a, "src").join(b, (F.col("plan_id") == F.col("p2")) & (ends.dst == b.dst)).filter("da <> db")
    data = [c for c in edges.columns if c not in ("src", "dst")]
    return joined.select("plan_id", F.least("da", "db").alias("d1"), F.greatest("da", "db").alias("d2"), "src", ends.dst, *data)


def cut_edges(edges: DataFrame, plans: DataFrame, column: str | None = "connections", weight: str = "connections") -> DataFrame:
    """plan_id, cut_edges: the sum of a column over the edges between districts, or their number.

    A zero for every row of ``plans`` stands for the plans that cut nothing; it
    vanishes in the partial sums, before anything is shuffled.
    """
    kind = "long" if column is None else "double"
    value = F.lit(1) if column is None else F.col(column)
    cut = cross_edges(edges, plans, weight).select("plan_id", value.cast(kind).alias("v"))
    rows = cut.unionByName(plans.select("plan_id", F.lit(0).cast(kind).alias("v")))
    return rows.groupBy("plan_id").agg(F.sum("v").alias("cut_edges"))


def isoperimetric(nodes: DataFrame, edges: DataFrame, plans: DataFrame, perimeter: str = "length") -> DataFrame:
    """plan_id, district, perimeter, area, score = perimeter^2 / area. A crossing edge adds to both its districts."""
    own = district_sums(nodes, plans, "area", "border_length")
    cross = cross_edges(edges, plans).select("plan_id", F.explode(F.array("d1", "d2")).alias("district"), perimeter)
    cross = cross.groupBy("plan_id", "district").agg(F.sum(perimeter).alias("cut"))
    out = own.join(cross, ["plan_id", "district"], "left").withColumn("perimeter", F.col("border_length") + F.coalesce("cut", F.lit(0.0)))
    return out.select("plan_id", "district", "perimeter", "area", (F.col("perimeter") ** 2 / F.col("area")).alias("score"))


def isoperimetric_score(scores: DataFrame, exponent: float = 1.0) -> DataFrame:
    return scores.groupBy("plan_id").agg(F.sum(F.pow("score", F.lit(exponent))).alias("score"))


def vote_sums(votes: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, election, stage, district, candidate, votes."""
    return plans.join(votes, "node").groupBy("plan_id", "election", "stage", "district", "candidate").agg(F.sum("votes").alias("votes"))


def performance_margins(sums: DataFrame, candidate: str) -> DataFrame:
    """plan_id, election, stage, district, margin: 0 where the candidate leads or ties, else the lead over it as a share of the leader's votes."""
    own = F.max(F.when(F.col("candidate") == candidate, F.col("votes")).otherwise(0))
    out = sums.groupBy("plan_id", "election", "stage", "district").agg(F.max("votes").alias("best"), own.alias("own"))
    margin = F.when(F.col("own") >= F.col("best"), F.lit(0.0)).otherwise((F.col("best") - F.col("own")) / F.col("best"))
    return out.select("plan_id", "election", "stage", "district", margin.alias("margin"))


def k_lowest(table: DataFrame, keys: list[str], value: str, k: int | Column, tie: str) -> DataFrame:
    """The k rows of each group with the lowest values."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def performance_score(margins: DataFrame, target: int, weights: DataFrame) -> DataFrame:
    """plan_id, score: for each election the sum of the ``target`` smallest two-stage margins, weighted by ``weights(election, weight)``."""
    both = margins.groupBy("plan_id", "election", "district").agg(F.sum("margin").alias("margin"))
    least = k_lowest(both, ["plan_id", "election"], "margin", target, "district").groupBy("plan_id", "election").agg(F.sum("margin").alias("margin"))
    return least.join(weights, "election").groupBy("plan_id").agg(F.sum(F.col("margin") * F.col("weight")).alias("score"))


def performance_report(margins: DataFrame, weights: DataFrame) -> DataFrame:
    """plan_id, won (total weight of the elections won in every stage), districts: how many districts have it; only won > 0."""
    won = margins.groupBy("plan_id", "election", "district").agg(F.max("margin").alias("worst")).filter("worst = 0")
    per = won.join(weights, "election").groupBy("plan_id", "district").agg(F.round(F.sum("weight"), 9).alias("won")).filter("won > 0")
    return per.groupBy("plan_id", "won").agg(F.count("*").alias("districts"))


def performance_target(nodes: DataFrame, minority: str | list[str], total_pop: str, districts: int) -> DataFrame:
    """target: the minority's share of the population as a whole number of districts; several columns are added up."""
    columns = [minority] if isinstance(minority, str) else minority
    part = sum((F.sum(c) for c in columns), F.lit(0))
    return nodes.agg(F.floor(part / F.sum(total_pop) * districts).alias("target"))


def partisan_margins(sums: DataFrame, first: str, second: str) -> DataFrame:
    """plan_id, election, district, margin: 100 v1 / (v1 + v2); null where there are no votes."""
    v1, v2 = (F.coalesce(F.sum(F.when(F.col("candidate") == c, F.col("votes"))), F.lit(0)) for c in (first, second))
    out = sums.groupBy("plan_id", "election", "district").agg(v1.alias("v1"), v2.alias("v2"))
    return out.select("plan_id", "election", "district", F.try_divide(F.col("v1") * 100.0, F.col("v1") + F.col("v2")).alias("margin"))


def partisan_seats(margins: DataFrame) -> DataFrame:
    won = F.sum(F.when(F.col("margin") > 50.0, 1).otherwise(0))
    return margins.groupBy("plan_id", "election").agg(won.alias("seats"))


def minority_fraction(nodes: DataFrame, plans: DataFrame, minority: str, total_pop: str) -> DataFrame:
    sums = district_sums(nodes, plans, minority, total_pop)
    return sums.select("plan_id", "district", F.try_divide(F.col(minority).cast("double"), F.col(total_pop)).alias("fraction"))


def ousted_population(nodes: DataFrame, plans: DataFrame, unit: str, ideal: float, population: str = "pop") -> DataFrame:
    """plan_id, ousted: people of each unit outside the districts that the unit could fill by itself.

    A unit of up to one ideal district: all but its largest share. A larger one:
    for its floor(n) largest shares, the part of those districts that is not the
    unit's; and what its next share lacks of the remainder.
    """
    pop = district_sums(nodes, plans, population).withColumnRenamed(population, "district_pop")
    share = plans.join(nodes.select(F.col("id").alias("node"), unit, population), "node").groupBy("plan_id", unit, "district").agg(F.sum(population).alias("share"))
    share = share.join(pop, ["plan_id", "district"])
    w = Window.partitionBy("plan_id", unit)
    ranked = share.withColumn("n", F.sum("share").over(w) / ideal).withColumn("all", F.sum("share").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("share").desc(), "district")))
    whole = F.floor("n")
    rest = F.greatest(F.lit(0.0), ideal * (F.col("n") - whole) - F.coalesce(F.max(F.when(F.col("rank") == whole + 1, F.col("share"))).over(w), F.lit(0)))
    ranked = ranked.withColumn("rest", rest).withColumn("whole", whole)
    large = F.sum(F.when(F.col("rank") <= F.col("whole"), F.col("district_pop") - F.col("share")).otherwise(0)) + F.max("rest")
    small = F.max("all") - F.max("share")
    units = ranked.groupBy("plan_id", unit).agg(F.when(F.max("n") <= 1, small).otherwise(large).cast("double").alias("ousted"))
    return units.groupBy("plan_id").agg(F.sum("ousted").alias("ousted"))


def split_units(nodes: DataFrame, plans: DataFrame, unit: str, population: str = "pop", energy=F.sqrt) -> DataFrame:
    """plan_id, split (units in several districts), energy: the sum of f(1 - largest share / unit)."""
    share = plans.join(nodes.select(F.col("id").alias("node"), unit, population), "node").groupBy("plan_id", unit, "district").agg(F.sum(population).alias("share"))
    fraction = (1 - F.try_divide(F.max("share").cast("double"), F.sum("share"))).alias("fraction")
    units = share.groupBy("plan_id", unit).agg(F.coalesce(fraction, F.lit(0.0)).alias("fraction"))
    return units.groupBy("plan_id").agg(F.sum((F.col("fraction") > 0).cast("int")).alias("split"), F.sum(energy("fraction")).alias("energy"))


def log_linking_edges(edges: DataFrame, plans: DataFrame, weight: str = "connections") -> DataFrame:
    pairs = cross_edges(edges, plans, weight).groupBy("plan_id", "d1", "d2").agg(F.sum(weight).alias("w"))
    return pairs.groupBy("plan_id").agg(F.sum(F.log("w")).alias("energy"))


def log_energy(energies: DataFrame, measure: DataFrame) -> DataFrame:
    """plan_id, log_energy: the weighted sum of energies(plan_id, name, value) by measure(name, weight, description); weight 0 is left out."""
    return energies.join(measure.filter("weight <> 0"), "name").groupBy("plan_id").agg(F.sum(F.col("value") * F.col("weight")).alias("log_energy"))


def delta_energy(energies: DataFrame, measure: DataFrame, old: str = "old_plan", new: str = "new_plan", pairs: DataFrame | None = None) -> DataFrame:
    """For each pair of plans: exp(E_old - E_new) over the districts whose values differ. energies: (plan_id, name, district, value)."""
    w = energies.join(measure.filter("weight <> 0").select("name", "weight"), "name").select("plan_id", "name", "district", (F.col("value") * F.col("weight")).alias("e"))
    a, b = (pairs.join(w.withColumnRenamed("plan_id", c), c) for c in (old, new))
    keys = [old, new, "name", "district"]
    both = a.withColumnRenamed("e", "e0").join(b.withColumnRenamed("e", "e1"), keys, "full").na.fill(0.0, ["e0", "e1"])
    changed = both.filter("e0 <> e1").groupBy(old, new).agg(F.sum(F.col("e0") - F.col("e1")).alias("d"))
    return pairs.join(changed, [old, new], "left").select(old, new, F.exp(F.coalesce("d", F.lit(0.0))).alias("ratio"))
