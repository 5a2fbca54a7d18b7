"""A run from its parameters to an ensemble file: graph, chains in chunks, maps with reports and diagnostics.

Each chunk of steps is one job. Its rows, forests included, are written to
``state`` under the steps that it holds; the maps of a chunk are made from these
rows alone and replace those of an earlier attempt. So a run that was broken off
goes on from its last whole chunk, with the same result, and no task holds more
than a chunk's outputs.

The header says which run it is: all parameters, the energies with their weights,
the graph's size, and the chunk. A run that finds the header of another one
refuses to go on; only its number of steps may have grown. (Functions can't be
compared: energies of the user's are told apart by name and weight.)
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators import arrays as A
from parcela.operators.constraints import Population
from parcela.plans.chain import LOG_FIELDS, Energy, as_plans, resume, run_chains
from parcela.plans.forest import LocalGraph
from parcela.sources import ensemble, run_config
from parcela.sources.json_graph import load_graph
from parcela.spec import Graph, GraphSpec

#: Nodes up to which a graph is held whole by every task of a chain.
LOCAL_NODES = 2_000_000
#: What may differ between a header and the run that goes on with it.
MAY_GROW = "two_tree_steps"


def spec_of(config: run_config.RunConfig) -> GraphSpec:
    c = config
    return GraphSpec(c.population, tuple(c.levels), c.area, c.node_border, c.edge_weight, c.edge_perimeter)


def local_graph(graph: Graph) -> LocalGraph:
    if graph.nodes.limit(LOCAL_NODES + 1).count() > LOCAL_NODES:
        raise ValueError(f"a chain holds graphs of up to {LOCAL_NODES} nodes")
    return LocalGraph.from_tables(graph.nodes.toPandas(), graph.edges.toPandas(), graph.spec)


def _maps(writer: ensemble.Writer, rows: DataFrame, graph: Graph, g: LocalGraph) -> DataFrame:
    """Rows of an ensemble file: the plan by node name, its cut edges, and the diagnostics of the proposals since the last map."""
    plans = rows.select(F.struct("chain_id", "step").alias("plan_id"), "districts")
    name = graph.spec.levels[-1]
    names = graph.nodes.select(F.col("id").alias("node"), F.col(name).cast("string").alias("name"))
    maps = ensemble.node_map(as_plans(rows, g), names).select("plan_id", "plan_id.step", "districting")
    weights = A.GraphArrays(g.ids, g.u, g.v, {}, {"weight": g.w})
    writer.reports = {}
    fields = [f for f in LOG_FIELDS if f != "proposal"]
    known = rows.select(F.struct("chain_id", "step").alias("plan_id"), "chain_id", *[F.col(f"log.{f}").alias(f) for f in fields])
    writer.push_report("chain_id", known, "chain_id")
    writer.push_report("cut_edges", A.cut_edges(plans, weights, "weight"), "cut_edges")
    for field in fields:
        writer.push_report(f"(two_tree,{field})", known, field)
    return maps


def same_run(spark: SparkSession, path: str, header: ensemble.Header) -> None:
    """Raises if ``path`` holds another run than that of ``header``."""
    found = ensemble.find_header(spark, path)
    if found is None:
        return
    old, new = json.loads(json.dumps(asdict(found))), json.loads(json.dumps(asdict(header)))
    old, new = ({k: v for k, v in h.items() if k not in ("date", "extra")} | h["extra"] for h in (old, new))
    other = sorted(k for k in {*old, *new} if old.get(k) != new.get(k) and not (k == MAY_GROW and old.get(k, 0) < new[k]))
    if other:
        raise ValueError(f"{path} holds another run: " + ", ".join(f"{k} was {old.get(k)}, is {new.get(k)}" for k in other))


def run(
    spark: SparkSession, config: run_config.RunConfig, graph: Graph | None = None, chunk_outputs: int = 100, energies: dict[str, Energy] | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Runs ``config`` (or goes on with it) and returns the maps at ``config.output``. ``weights`` add energies of the user's to the measure."""
    graph = graph or load_graph(spark, config.graph, spec_of(config))
    g = local_graph(graph)
    bounds = Population.around(float(g.pop.sum()), config.districts, config.tolerance, population=graph.spec.population)
    mix = {"two_tree": config.two_tree_frac, "one_tree": 1 - config.two_tree_frac}
    measure = {"log_forests": config.gamma, "isoperimetric": config.iso_weight} | (weights or {})
    size, state, done = config.every * chunk_outputs, None, 0
    extra = asdict(config) | {"chunk": size, "nodes": len(g.ids), "edges": len(g.u), "people": float(g.pop.sum())}
    header = ensemble.Header(config.districts, bounds.low, bounds.high, list(measure), list(measure.values()), list(graph.spec.levels), extra=extra)
    same_run(spark, config.output, header)
    writer = ensemble.Writer(spark, config.output, header)
    while done < config.steps:
        n, folder = min(size, config.steps - done), f"{config.output}/state"
        found = ensemble.find_part(spark, folder, done + 1)
        if found is None:
            chains = run_config.chains(spark, config).withColumn("steps", F.lit(n).cast("long"))
            made = (
                run_chains(chains, g, config.districts, bounds.low, bounds.high, config.every, mix, measure, energies) if state is None
                else resume(state, g, n, bounds.low, bounds.high, config.every, mix, measure, energies)
            )
            made.write.mode("overwrite").parquet(f"{folder}/part-{ensemble.part_name(done + 1, done + n)}")
            found = ensemble.find_part(spark, folder, done + 1)
        rows, last = found
        writer.output(_maps(writer, rows, graph, g), ensemble.part_name(done + 1, last))
        ends = rows.groupBy("chain_id").agg(F.max("step").alias("step"))
        state, done = rows.join(ends, ["chain_id", "step"]), last
    writer.close()
    return ensemble.read_maps(spark, config.output)


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """The proposal log of a run: chain_id and LOG."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/state")
    return rows.select("chain_id", F.explode("log").alias("p")).select("chain_id", "p.*")


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), run_config.load())
