"""Graphs, plans, votes and proposal logs derived from star-schema tables.

* nation lattice: 25 nations on a 5 x 5 grid with rook adjacency; population is
  the number of customers, county the region;
* customer lattice: customers row by row on a grid of width ceil(sqrt(n)); it
  grows with the data; population is the number of orders;
* trade graph: nations joined by the line items between their suppliers and
  customers;
* plans: assignments in closed form, any number of them;
* votes: orders by priority (elections) and status (candidates).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators.arrays import GraphArrays
from parcela.spec import Graph, GraphSpec, unordered

CUSTOMER_PLANS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid_edges(nodes: DataFrame) -> DataFrame:
    """Rook adjacency by an equi-join: each node looks up its right and upper neighbour."""
    ahead = F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))
    arcs = nodes.select(F.col("id").alias("a"), F.explode(ahead).alias("to")).select("a", "to.x", "to.y")
    pairs = arcs.join(nodes.select(F.col("id").alias("b"), "x", "y"), ["x", "y"])
    src, dst = unordered("a", "b")
    return pairs.select(src.alias("src"), dst.alias("dst"), F.lit(1.0).alias("length"), F.lit(1.0).alias("connections"))


def nation_lattice(spark: SparkSession, sf_dir: str) -> Graph:
    pops = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("pop"))
    n = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("y"),
        F.col("n_regionkey").alias("county"), F.col("n_name").alias("name"),
    )
    side = sum(((F.col(c) == v).cast("int") for c in "xy" for v in (0, 4)), F.lit(0))
    nodes = n.join(pops, "id", "left").withColumn("pop", F.coalesce("pop", F.lit(0))).withColumn("area", F.lit(1.0)).withColumn("border_length", side.cast("double"))
    return Graph(nodes, _grid_edges(nodes), GraphSpec(levels=("county", "name")))


def customer_lattice(spark: SparkSession, sf_dir: str) -> Graph:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    w = math.ceil(math.sqrt(customers.agg(F.max("id")).first()[0] + 1))
    pops = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("pop"))
    regions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    nodes = customers.join(pops, "id", "left").join(F.broadcast(regions), "nation")  # 25 rows by definition
    nodes = nodes.select(
        "id", (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"), "nation", "region", F.coalesce("pop", F.lit(0)).alias("pop"), F.lit(1.0).alias("area")
    )
    return Graph(nodes, _grid_edges(nodes), GraphSpec(levels=("region", "nation", "id")))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, connections (line items), length (quantity) between nations, without those inside one nation."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    seller = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    joined = item.join(order, item.l_orderkey == order.o_orderkey).join(buyer, F.col("o_custkey") == buyer.c_custkey).join(seller, F.col("l_suppkey") == seller.s_suppkey)
    src, dst = unordered("a", "b")
    return joined.filter("a <> b").groupBy(src.alias("src"), dst.alias("dst")).agg(F.count("*").cast("double").alias("connections"), F.sum("l_quantity").alias("length"))


def nation_plans(nodes: DataFrame) -> DataFrame:
    """plan_id, node, district: columns, rows, and diagonals (not contiguous)."""
    x, y = F.col("x"), F.col("y")
    d = F.array(x, y, (x + 2 * y) % 5)
    return nodes.select("id", F.posexplode(d).alias("plan_id", "d")).select("plan_id", F.col("id").alias("node"), (F.col("d") + 1).alias("district"))


def customer_plans(nodes: DataFrame, n_plans: int = CUSTOMER_PLANS) -> DataFrame:
    """plan_id, node, district: plan p cuts the grid into p + 2 stripes of columns, alternately shifted by rows."""
    plan = F.explode(F.sequence(F.lit(0), F.lit(n_plans - 1))).alias("plan_id")
    p = nodes.select("id", "x", "y", plan)
    return p.select("plan_id", F.col("id").alias("node"), ((F.col("x") + F.col("y") * (F.col("plan_id") % 2)) % (F.col("plan_id") + 2) + 1).alias("district"))


def customer_plan_arrays(spark: SparkSession, g: GraphArrays, n_plans: int = CUSTOMER_PLANS) -> DataFrame:
    """plan_id, districts: the plans of ``customer_plans``, each as one row."""
    shared = spark.sparkContext.broadcast((g.nodes["x"].astype(np.int32), g.nodes["y"].astype(np.int32)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        for b in batches:
            for p in b.column(0).to_pylist():
                d = pa.array((x + y * (p % 2)) % (p + 2) + 1, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d)], ["plan_id", "districts"])

    return spark.range(n_plans).mapInArrow(make, "plan_id int, districts array<int>")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, election, stage, candidate, votes: orders of a nation's customers by priority; F, O, P in the first stage, F and O in the second."""
    order = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    buyer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("node"))
    joined = order.join(buyer, order.o_custkey == buyer.c_custkey)
    second = F.when(F.col("o_orderstatus") == "F", "F").otherwise("O")
    stages = F.explode(F.array(F.struct(F.lit(1).alias("stage"), F.col("o_orderstatus").alias("candidate")), F.struct(F.lit(2).alias("stage"), second.alias("candidate"))))
    long = joined.select("node", F.col("o_orderpriority").alias("election"), stages.alias("s"))
    return long.groupBy("node", "election", F.col("s.stage").alias("stage"), F.col("s.candidate").alias("candidate")).agg(F.count("*").alias("votes"))


def comb_trees(graph: Graph) -> DataFrame:
    """tree_id, u, v: two spanning trees of the nation lattice, columns on the bottom row and rows on the left column."""
    u = graph.nodes.select(F.col("id").alias("src"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    v = graph.nodes.select(F.col("id").alias("dst"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    e = graph.edges.join(u, "src").join(v, "dst")
    first = (F.col("ux") == F.col("vx")) | ((F.col("uy") == 0) & (F.col("vy") == 0))
    second = (F.col("uy") == F.col("vy")) | ((F.col("ux") == 0) & (F.col("vx") == 0))
    ids = F.explode(F.filter(F.array(F.when(first, 0), F.when(second, 1)), lambda t: t.isNotNull())).alias("tree_id")
    return e.select(ids, F.col("src").alias("u"), F.col("dst").alias("v"))


def proposal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, proposal, value: events as a log of proposals."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("proposal"), "value")
