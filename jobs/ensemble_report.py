"""Report of an ensemble of plans: every measure of every plan and district in one table, partitioned by measure.

    python -m jobs.ensemble_report --tables DIR --output DIR [--config jobs/ensemble_report.toml]

Reads ``customer``, ``orders`` and ``nation`` as a lattice of units with their
populations and votes (``parcela.sources.tables``), and the plans: the maps of an
ensemble file (setting ``ensemble``; names of its nodes are unit ids), or the
closed-form plans of the lattice. Writes ``report/measure=NAME`` with plan_id,
district, election and value; district and election are null where a measure has
none. A run replaces the partitions of the measures that it computes and leaves
the others, so that it may be repeated, or go on with other measures, at will.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, replace_partitions, settings, table
from parcela.operators import observables as O
from parcela.sources import ensemble
from parcela.sources import tables as S

log = logging.getLogger("jobs.ensemble_report")

SCHEMA = "plan_id string, district int, election string, value double, measure string"
MEASURES = ("population", "deviation", "nodes", "balanced", "cut_edges", "compactness", "margin", "seats", "split_units")


@dataclass(frozen=True)
class Settings:
    tolerance: float = 0.05
    #: The candidates of a margin: its share of the two is the first one's.
    first: str = "F"
    second: str = "O"
    measures: list[str] = field(default_factory=lambda: list(MEASURES))
    #: Folder of an ensemble whose maps are reported on; empty: the closed-form plans.
    ensemble: str = ""
    #: Files of a measure.
    files: int = 4

    def __post_init__(self):
        if unknown := sorted(set(self.measures) - set(MEASURES)):
            raise ValueError(f"no measure is called {', '.join(unknown)}")


def votes(spark: SparkSession, tables: str) -> DataFrame:
    """node, election, stage, candidate, votes: the orders of each customer by priority and status."""
    orders = table(spark, tables, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("election"), F.col("o_orderstatus").alias("candidate"))
    return orders.groupBy("node", "election", "candidate").agg(F.count("*").alias("votes")).withColumn("stage", F.lit(1))


def measured(spark: SparkSession, tables: str, s: Settings) -> DataFrame:
    """SCHEMA: rows of all measures of the settings."""
    g = S.customer_lattice(spark, tables)
    plans = ensemble.map_plans(ensemble.read_maps(spark, s.ensemble)) if s.ensemble else S.customer_plans(g.nodes)
    plans = plans.select(F.col("plan_id").cast("string").alias("plan_id"), F.col("node").cast("long").alias("node"), F.col("district").cast("int").alias("district"))
    none = F.lit(None)

    def rows(df: DataFrame, measure: str, value: Column | str, district: Column | str = none, election: Column | str = none) -> DataFrame:
        of = lambda c: F.col(c) if isinstance(c, str) else c
        return df.select("plan_id", of(district).cast("int").alias("district"), of(election).cast("string").alias("election"), of(value).cast("double").alias("value"), F.lit(measure).alias("measure"))

    pops = O.district_sums(g.nodes, plans, "pop")
    ideal = pops.groupBy("plan_id").agg((F.sum("pop") / F.count("*")).alias("ideal"))
    off = pops.join(ideal, "plan_id").select("plan_id", "district", F.coalesce(F.try_divide(F.col("pop"), F.col("ideal")) - 1, F.lit(0.0)).alias("off"))
    margins = lambda: O.partisan_margins(O.vote_sums(votes(spark, tables), plans), s.first, s.second)
    made = {
        "population": lambda: rows(pops, "population", "pop", "district"),
        "deviation": lambda: rows(off, "deviation", "off", "district"),
        "nodes": lambda: rows(O.node_counts(plans), "nodes", "nodes", "district"),
        "balanced": lambda: rows(off.groupBy("plan_id").agg(F.bool_and(F.abs("off") <= s.tolerance).cast("int").alias("ok")), "balanced", "ok"),
        "cut_edges": lambda: rows(O.cut_edges(g.edges, plans), "cut_edges", "cut_edges"),
        "compactness": lambda: rows(O.isoperimetric(g.nodes.withColumn("border_length", F.lit(0.0)), g.edges, plans), "compactness", "score", "district"),
        "margin": lambda: rows(margins(), "margin", "margin", "district", "election"),
        "seats": lambda: rows(O.partisan_seats(margins()), "seats", "seats", election="election"),
        "split_units": lambda: rows(O.split_units(g.nodes, plans, "nation"), "split_units", "split"),
    }
    out = None
    for name in s.measures:
        out = made[name]() if out is None else out.unionByName(made[name]())
    return spark.createDataFrame([], SCHEMA) if out is None else out


def run(spark: SparkSession, tables: str, output: str, s: Settings | None = None) -> DataFrame:
    """Computes and writes the report; returns the whole of it as it then stands."""
    s, path = s or Settings(), f"{output.rstrip('/')}/report"
    for name in ("customer", "orders", "nation"):
        log.info("read %s rows of %s", table(spark, tables, name).count(), name)
    out = measured(spark, tables, s)
    # a measure's rows go to so many files, whatever tasks they came from
    dealt = out.repartition("measure", F.pmod(F.xxhash64("plan_id"), F.lit(s.files)))
    replace_partitions(dealt, path, "measure")
    report = spark.read.schema(SCHEMA).parquet(path)
    for r in report.groupBy("measure").agg(F.count("*").alias("n")).orderBy("measure").collect():  # a row for each measure
        log.info("%s has %s rows of %s%s", path, r.n, r.measure, "" if r.measure in s.measures else " (from an earlier run)")
    return report


if __name__ == "__main__":
    main("ensemble_report", lambda spark, a: run(spark, a.tables, a.output, settings(Settings, a.config)))
