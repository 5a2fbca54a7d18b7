"""Queries over the driver's tables for every operator, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.functions import expressions as X
from parcela.operators import arrays as A
from parcela.operators import constraints as C
from parcela.operators import cycles as Y
from parcela.operators import diagnostics as G
from parcela.operators import hierarchy as H
from parcela.operators import nodesets as N
from parcela.operators import observables as O
from parcela.operators import ordered as Q
from parcela.operators import trees as R
from parcela.sources import ensemble, json_graph, run_config
from parcela.sources import tables as S
from parcela.sources.shared import shared_dir, written
from parcela.spec import Graph, GraphSpec

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- views that the SQL builds on

NATION = """
nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_regionkey AS county, any_value(n_name) AS name, count(c_custkey) AS pop, 1.0::DOUBLE AS area,
  ((n_nationkey % 5 = 0)::INT + (n_nationkey % 5 = 4)::INT + (n_nationkey // 5 = 0)::INT + (n_nationkey // 5 = 4)::INT)::DOUBLE AS border_length
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
edges AS (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS length, 1.0::DOUBLE AS connections FROM nodes a JOIN nodes b ON a.id < b.id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
plans AS (SELECT p.plan_id, n.id AS node, CASE p.plan_id WHEN 0 THEN n.x WHEN 1 THEN n.y ELSE (n.x + 2 * n.y) % 5 END + 1 AS district FROM nodes n, (VALUES (0), (1), (2)) p(plan_id)),
crossing AS (SELECT pa.plan_id, least(pa.district, pb.district) AS d1, greatest(pa.district, pb.district) AS d2, src, dst, length, connections
  FROM edges JOIN plans pa ON pa.node = src JOIN plans pb ON pb.node = dst AND pb.plan_id = pa.plan_id WHERE pa.district <> pb.district)"""

CUSTOMER = """
w AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS w FROM customer),
opop AS (SELECT o_custkey, count(*) AS pop FROM orders GROUP BY o_custkey),
nodes AS (SELECT c_custkey AS id, c_custkey % w AS x, c_custkey // w AS y, CAST(c_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, coalesce(pop, 0) AS pop, 1.0::DOUBLE AS area
  FROM customer JOIN w ON true JOIN nation ON n_nationkey = c_nationkey LEFT JOIN opop ON o_custkey = c_custkey),
edges AS (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS length, 1.0::DOUBLE AS connections FROM nodes a JOIN nodes b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
plans AS (SELECT p.plan_id, n.id AS node, (n.x + n.y * (p.plan_id % 2)) % (p.plan_id + 2) + 1 AS district FROM nodes n, (SELECT unnest(range(8)) AS plan_id) p),
crossing AS (SELECT pa.plan_id, least(pa.district, pb.district) AS d1, greatest(pa.district, pb.district) AS d2, src, dst, length, connections
  FROM edges JOIN plans pa ON pa.node = src JOIN plans pb ON pb.node = dst AND pb.plan_id = pa.plan_id WHERE pa.district <> pb.district)"""

TRADE = """
trade AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*)::DOUBLE AS connections, sum(l_quantity) AS length
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""

VOTES = """
ballots AS (SELECT c_nationkey::BIGINT AS node, o_orderpriority AS election, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey),
votes AS (SELECT node, election, 1 AS stage, st AS candidate, count(*) AS votes FROM ballots GROUP BY ALL
  UNION ALL SELECT node, election, 2, CASE WHEN st = 'F' THEN 'F' ELSE 'O' END, count(*) FROM ballots GROUP BY ALL),
vsums AS (SELECT plan_id, election, stage, district, candidate, sum(votes)::BIGINT AS votes FROM plans JOIN votes USING (node) GROUP BY ALL),
margins AS (SELECT plan_id, election, stage, district, CASE WHEN own >= best THEN 0.0::DOUBLE ELSE (best - own)::DOUBLE / best END AS margin FROM (
  SELECT plan_id, election, stage, district, max(votes) AS best, max(CASE WHEN candidate = 'F' THEN votes ELSE 0 END) AS own FROM vsums GROUP BY ALL)),
weights AS (SELECT DISTINCT o_orderpriority AS election, CASE WHEN o_orderpriority LIKE '1%' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM orders)"""

COMBS = """
ends AS (SELECT src, dst, u.x AS ux, u.y AS uy, v.x AS vx, v.y AS vy FROM edges JOIN nodes u ON u.id = src JOIN nodes v ON v.id = dst),
trees AS (SELECT 0 AS tree_id, src AS u, dst AS v FROM ends WHERE ux = vx OR (uy = 0 AND vy = 0) UNION ALL SELECT 1, src, dst FROM ends WHERE uy = vy OR (ux = 0 AND vx = 0)),
arcs AS (SELECT tree_id, u, v FROM trees UNION ALL SELECT tree_id, v, u FROM trees)"""

DIST = """
dist AS (SELECT DISTINCT tree_id, u AS a, u AS b, CAST(-1 AS BIGINT) AS prev, 0 AS d FROM arcs
  UNION ALL SELECT dist.tree_id, a, arcs.v, dist.b, d + 1 FROM dist JOIN arcs ON arcs.tree_id = dist.tree_id AND arcs.u = dist.b AND arcs.v <> dist.prev),
ecc AS (SELECT tree_id, a AS node, max(d) AS e FROM dist GROUP BY 1, 2),
centres AS (SELECT tree_id, node FROM ecc JOIN (SELECT tree_id, min(e) AS e FROM ecc GROUP BY 1) USING (tree_id, e)),
deg AS (SELECT tree_id, u AS node, count(*) AS degree FROM arcs GROUP BY 1, 2),
mean AS (SELECT dist.tree_id, b AS node, avg(d) AS d FROM dist JOIN centres ON centres.tree_id = dist.tree_id AND centres.node = a GROUP BY 1, 2)"""

#: Nodes b that a reaches inside its district.
REACH = "inner_e AS (SELECT pa.plan_id, pa.district, src AS u, dst AS v FROM edges JOIN plans pa ON pa.node = src JOIN plans pb ON pb.node = dst AND pb.plan_id = pa.plan_id AND pb.district = pa.district), ie AS (SELECT * FROM inner_e UNION ALL SELECT plan_id, district, v, u FROM inner_e), reach AS (SELECT plan_id, district, node AS a, node AS b FROM plans UNION SELECT r.plan_id, r.district, a, ie.v FROM reach r JOIN ie ON ie.plan_id = r.plan_id AND ie.u = r.b)"

#: Cycles: the lines of an order are the positions, quantities the weights, the first half lies in the first district.
CYCLE = """
cycle AS (SELECT l_orderkey AS cycle_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS pos, l_quantity AS weight FROM lineitem),
s AS (SELECT cycle_id, pos, weight, sum(weight) OVER (PARTITION BY cycle_id ORDER BY pos) AS upto, sum(weight) OVER (PARTITION BY cycle_id) AS total, count(*) OVER (PARTITION BY cycle_id) AS n FROM cycle),
cycles AS (SELECT cycle_id, count(*) AS n, greatest(1, count(*) // 2) AS n_u, sum(weight) AS total FROM cycle GROUP BY 1),
arc AS (SELECT a.cycle_id, a.pos AS a, b.pos AS b, b.upto - a.upto + a.weight AS pop FROM s a JOIN s b ON a.cycle_id = b.cycle_id AND a.pos <= b.pos AND b.pos < b.n
  WHERE b.upto - a.upto + a.weight BETWEEN 20 AND 90 AND b.total - (b.upto - a.upto + a.weight) BETWEEN 20 AND 90),
swap AS (SELECT a.cycle_id, a, b, any_value(c.total) AS total,
  sum(CASE WHEN a <= n_u AND pos BETWEEN a AND least(n_u, b) THEN weight WHEN a > n_u + 1 AND pos BETWEEN n_u + 1 AND a - 1 THEN weight ELSE 0 END)
  + sum(CASE WHEN b < n AND pos >= greatest(n_u + 1, b + 1) THEN weight ELSE 0 END) AS overlap
  FROM arc a JOIN cycles c USING (cycle_id) JOIN cycle k ON k.cycle_id = a.cycle_id GROUP BY a.cycle_id, a, b)"""

LOW, HIGH = 20, 90


def register(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {'RECURSIVE ' * recursive}" + ",".join(views) + "\n" if views else "") + sql
        return f

    return put


def nation(f, *args, **kw):
    """A query over the nation lattice g and its plans."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = S.nation_lattice(spark, sf_dir)
        return f(g, S.nation_plans(g.nodes), *args, **kw)

    return run


def customer(f, *args, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = S.customer_lattice(spark, sf_dir)
        return f(g, S.customer_plans(g.nodes), *args, **kw)

    return run


#: Edges up to which few plans are evaluated as arrays: of more, their rows are less work than a graph in every task.
FEW_PLANS_EDGES = 500_000


def arrays(f, rows, n_plans: int = S.CUSTOMER_PLANS):
    """A query over the customer lattice whose plans are arrays; over a graph too large for every task, one over their rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = S.customer_lattice(spark, sf_dir)
        local = A.GraphArrays.of(g, FEW_PLANS_EDGES if n_plans <= S.CUSTOMER_PLANS else None)
        return rows(g, S.customer_plans(g.nodes, n_plans)) if local is None else f(S.customer_plan_arrays(spark, local, n_plans), local)

    return run


def small_arrays(f, edges=lambda spark, sf_dir, g: g.edges):
    """A query over the plans of the nation lattice as arrays, perhaps with other edges."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = S.nation_lattice(spark, sf_dir)
        local = A.GraphArrays.of(Graph(g.nodes, edges(spark, sf_dir, g), g.spec))
        return f(A.as_arrays(S.nation_plans(g.nodes), local), local)

    return run


# ---------------------------------------------------------------- sources and sinks


def _document(spark: SparkSession, sf_dir: str) -> str:
    """The path of the nation lattice as one adjacency-form document: one row of 25 nodes by definition. TOTPOP, G20D, crossing and len2 are attributes that only this file has."""
    g = S.nation_lattice(spark, sf_dir)
    arcs = g.edges.select("src", "dst", "length").union(g.edges.select("dst", "src", "length"))
    out = arcs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("id"), "length", (F.col("src") * 100 + F.col("dst")).alias("len2"), F.lit(None).cast("double").alias("connections")))).alias("out"))
    n = g.nodes.join(out, g.nodes.id == out.src).select(F.struct("id", F.col("county").cast("string").alias("county"), "pop", "area", "border_length", F.col("pop").alias("TOTPOP"), (F.col("pop") * 3 + F.col("id")).alias("G20D"), F.concat_ws("-", "county", "id").alias("crossing")).alias("n"), "out")
    rows = n.agg(F.array_sort(F.collect_list(F.struct(F.col("n.id").alias("i"), "n", "out"))).alias("r"))
    text = rows.select(F.to_json(F.struct(F.transform("r", lambda x: x["n"]).alias("nodes"), F.transform("r", lambda x: x["out"]).alias("adjacency"))).alias("j"))
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/graph-{uuid4().hex}.json"
    text.write.text(path)
    return path


def _parsed(spark, sf_dir, spec=None):
    return json_graph.load_graph(spark, _document(spark, sf_dir), spec or GraphSpec(levels=("county", "id")))


@register("s1_json_graph_scan", "SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, sum(connections) AS weight, (SELECT sum(pop)::BIGINT FROM nodes) AS pop FROM edges", NATION)
def s1(spark, sf_dir):
    g = _parsed(spark, sf_dir)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.sum("pop").alias("pop")).withColumn("k", F.lit(1))
    e = g.edges.agg(F.count("*").alias("edges"), F.sum("connections").alias("weight")).withColumn("k", F.lit(1))
    return n.join(e, "k").drop("k")


register("s2_graph_attributes", "SELECT id, pop AS TOTPOP, pop * 3 + id AS G20D, county::VARCHAR || '-' || id::VARCHAR AS crossing FROM nodes", NATION)(
    lambda spark, sf: _parsed(spark, sf, GraphSpec(population="TOTPOP", keep=frozenset({"TOTPOP", "G20D", "crossing"}))).nodes
)
register("s7_edge_attributes", "SELECT src, dst, src * 100 + dst AS len2 FROM edges", NATION)(lambda spark, sf: _parsed(spark, sf).edges.select("src", "dst", "len2"))
register("s4_edge_dedup", "SELECT src, dst, length, connections FROM edges", NATION)(lambda spark, sf: _parsed(spark, sf).edges.select("src", "dst", "length", "connections"))
register("s5_node_projection", "SELECT id, county::VARCHAR AS county, pop FROM nodes", NATION)(lambda spark, sf: _parsed(spark, sf, GraphSpec(keep=frozenset({"county", "pop"}))).nodes)
register("s6_attribute_by_key", "SELECT id, sqrt(pop) AS value FROM nodes", NATION)(nation(lambda g, p: json_graph.attribute(g.nodes, "pop", F.sqrt)))


def _flat_map(df: DataFrame, key: str, column: str) -> DataFrame:
    entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return df.select(key, F.array_join(entries, ",").alias(column))


MAP = "string_agg(name || '=' || district::VARCHAR, ',' ORDER BY name || '=' || district::VARCHAR)"
register("s11_node_map", f"SELECT plan_id, {MAP} AS districting FROM plans JOIN nodes ON id = node GROUP BY 1", NATION)(
    nation(lambda g, p: _flat_map(ensemble.node_map(p, g.nodes.select(F.col("id").alias("node"), "name")), "plan_id", "districting"))
)


def _ensemble_rows(spark, sf_dir, with_districting=True):
    g = S.nation_lattice(spark, sf_dir)
    p = S.nation_plans(g.nodes)
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/ensemble-{uuid4().hex}"
    w = ensemble.Writer(spark, path, ensemble.Header(5, 0, 1e9), with_districting=with_districting).push_report("cut_edges", O.cut_edges(g.edges, p), "cut_edges")
    maps = ensemble.node_map(p, g.nodes.select(F.col("id").alias("node"), "name")).withColumn("step", F.col("plan_id") + 1)
    w.rows(maps).write.mode("overwrite").option("compression", "gzip").json(f"{path}/maps")
    return ensemble.read_maps(spark, path)


@register("s8_ensemble_sink", f"SELECT 'step' || (plan_id + 1) AS name, 1.0::DOUBLE AS weight, {MAP} AS districting FROM plans JOIN nodes ON id = node GROUP BY plan_id", NATION)
def s8(spark, sf_dir):
    return _flat_map(_ensemble_rows(spark, sf_dir).withColumn("k", F.struct("name", "weight")), "k", "districting").select("k.*", "districting")


@register("s9_output_report", "SELECT 'step' || (plan_id + 1) AS name, sum(connections) AS cut_edges FROM crossing GROUP BY plan_id", NATION)
def s9(spark, sf_dir):
    return _ensemble_rows(spark, sf_dir).select("name", F.get_json_object(F.col("data")["cut_edges"], "$.value").cast("double").alias("cut_edges"))


register("s10_output_without_districting", "SELECT 'step' || (plan_id + 1) AS name, 0 AS entries FROM plans GROUP BY plan_id", NATION)(
    lambda spark, sf: _ensemble_rows(spark, sf, False).select("name", F.coalesce(F.size("districting"), F.lit(0)).alias("entries"))
)
register("s14_chain_seeds", "SELECT n_nationkey::BIGINT AS chain_id, (454190 + 15123 * n_nationkey)::BIGINT AS seed FROM nation")(
    lambda spark, sf: S.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("chain_id"), run_config.chain_seed(F.col("n_nationkey").cast("long")).alias("seed"))
)

# ---------------------------------------------------------------- projections and predicates

UNITS = "units AS (SELECT DISTINCT region, nation FROM nodes)"
CPATH = "npath AS (SELECT id, region::VARCHAR || '/' || nation::VARCHAR AS up, region, nation FROM nodes)"


def _pathed(g):
    return H.with_path(g.nodes, list(g.spec.levels))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "/") for c in columns})


register(
    "p1_edge_weight_mixed_levels",
    "SELECT coalesce(sum(connections), 0)::DOUBLE AS weight FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE (a.region = 0 AND b.region = 1 AND b.nation = 1) OR (b.region = 0 AND a.region = 1 AND a.nation = 1)",
    CUSTOMER,
)(customer(lambda g, p: H.edge_weight(g.edges, _pathed(g), ["0"], ["1", "1"])))
register("p2_modify_edge_weights", "SELECT src, dst, sqrt(a.pop * b.pop) + length AS connections FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst", CUSTOMER)(
    customer(lambda g, p: json_graph.modify_edge_weights(g, lambda u, v, e: F.sqrt(u("pop") * v("pop")) + e("length")).edges.select("src", "dst", "connections"))
)
register("p3_zero_weight_edges", "SELECT src, dst, connections FROM (SELECT src, dst, (src % 3)::DOUBLE AS connections FROM edges) WHERE connections <> 0", CUSTOMER)(
    customer(lambda g, p: g.edges.withColumn("connections", (F.col("src") % 3).cast("double")).filter("connections <> 0").select("src", "dst", "connections"))
)
register("p5_in_cluster", "SELECT id FROM nodes WHERE (region = 0 AND nation = 0) OR region = 2", CUSTOMER)(
    customer(lambda g, p: g.nodes.filter(H.matches([{"region": 0, "nation": 0}, {"region": 2}])).select("id"))
)


def _sets(g, *paths: tuple[int, tuple[str, ...]]) -> DataFrame:
    spark = g.nodes.sparkSession
    return spark.createDataFrame([(s, list(p)) for s, p in paths], "set_id int, path array<string>")


def _units(g) -> DataFrame:
    """All nations as paths (region, nation)."""
    return _pathed(g).select(F.slice("path", 1, 2).alias("path")).distinct()


#: Two sets: regions 0 and 1 with nation 2 in full; nations 1 and 7 with region 1.
SETS = ((0, ("0",)), (0, ("1",)), (0, ("2", "2")), (1, ("1", "1")), (1, ("2", "7")), (1, ("1",)))
MEMBERS = """members AS (SELECT 0 AS set_id, id FROM nodes WHERE region IN (0, 1) OR (region = 2 AND nation = 2) UNION SELECT 1, id FROM nodes WHERE (region = 2 AND nation = 7) OR region = 1)"""
register(
    "p6_intersects",
    "SELECT DISTINCT set_id, region::VARCHAR || '/' || nation::VARCHAR AS path FROM members JOIN nodes USING (id)", CUSTOMER, MEMBERS,
)(customer(lambda g, p: _joined(N.intersects(_sets(g, *SETS), _units(g), _pathed(g)), "path")))
register(
    "p7_strictly_contained",
    "SELECT set_id, region::VARCHAR || '/' || nation::VARCHAR AS path FROM members JOIN nodes USING (id) GROUP BY set_id, region, nation HAVING count(*) = (SELECT count(*) FROM nodes n WHERE n.region = nodes.region AND n.nation = nodes.nation)",
    CUSTOMER, MEMBERS,
)(customer(lambda g, p: _joined(N.strictly_contains(_sets(g, *SETS), _units(g), _pathed(g)), "path")))
register("p9_edge_key", "SELECT src, dst, CASE WHEN a.region <> b.region THEN '' WHEN a.nation <> b.nation THEN a.region::VARCHAR ELSE a.region::VARCHAR || '/' || a.nation::VARCHAR END AS key FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst", CUSTOMER)(
    customer(lambda g, p: H.with_paths(g.edges, _pathed(g)).select("src", "dst", F.array_join(H.edge_key(F.col("p"), F.col("q")), "/").alias("key")))
)
register("p13_random_order", "SELECT id, row_number() OVER (PARTITION BY nation ORDER BY md5('7:' || id::VARCHAR), id)::INT AS draw FROM nodes", CUSTOMER)(
    customer(lambda g, p: X.random_element(g.nodes, ["nation"], "id", 7, 2**31 - 1).select("id", "draw"))
)

# ---------------------------------------------------------------- joins

register("j1_cross_district_edges", "SELECT plan_id, d1, d2, src, dst FROM crossing", CUSTOMER)(arrays(A.cross_edges, lambda g, p: O.cross_edges(g.edges, p).select("plan_id", "d1", "d2", "src", "dst")))
register(
    "j2_fine_neighbors",
    "SELECT DISTINCT a.region::VARCHAR AS node, b.region::VARCHAR AS nbr, b.region::VARCHAR || '/' || b.nation::VARCHAR AS fine FROM both_ways JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.region <> b.region",
    CUSTOMER, "both_ways AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges)",
)(customer(lambda g, p: _joined(H.fine_neighbors(g.edges, _pathed(g), 1), "node", "nbr", "fine")))
register(
    "j4_quotient_edges",
    "SELECT least(a.region::VARCHAR || '/' || a.nation::VARCHAR, b.region::VARCHAR || '/' || b.nation::VARCHAR) AS q1, greatest(a.region::VARCHAR || '/' || a.nation::VARCHAR, b.region::VARCHAR || '/' || b.nation::VARCHAR) AS q2, sum(length) AS length, sum(connections) AS connections FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.nation <> b.nation GROUP BY 1, 2",
    CUSTOMER,
)(customer(lambda g, p: _joined(H.quotient_edges(g.edges, _pathed(g), 2), "q1", "q2").select(F.least("q1", "q2").alias("q1"), F.greatest("q1", "q2").alias("q2"), "length", "connections")))
_CONN = """SELECT a.region::VARCHAR AS coarse, b.region::VARCHAR || '/' || b.nation::VARCHAR AS fine, {v} AS weight FROM both_ways JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.region <> b.region GROUP BY a.region, b.region, b.nation"""
BOTH = "both_ways AS (SELECT src AS u, dst AS v, connections, length FROM edges UNION ALL SELECT dst, src, connections, length FROM edges)"
for _name, _value, _sql in (("j5_connection_weight", None, "sum(connections)"), ("j6_connection_length", "length", "sum(length)"), ("j6_connection_count", "one", "count(*)::DOUBLE")):
    register(_name, _CONN.format(v=_sql), CUSTOMER, BOTH)(
        customer(lambda g, p, v: _joined(H.connections(g.edges, H.with_path(g.nodes, ["region", "nation"]), 2, None if v is None else F.lit(1.0) if v == "one" else F.col(v)), "coarse", "fine"), _value)
    )
register(
    "j7_cross_district_levels",
    "SELECT plan_id, d1, d2, CASE WHEN a.region <> b.region THEN 1 WHEN a.nation <> b.nation THEN 2 ELSE 3 END AS level, sum(connections) AS weight FROM crossing JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL",
    CUSTOMER,
)(customer(lambda g, p: H.cross_district_levels(g.edges, _pathed(g), p)))
register(
    "j8_partial_unit_weight",
    "SELECT coalesce(sum(connections), 0)::DOUBLE AS weight FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE (a.region = 0 AND a.x % 2 = 0 AND b.region = 1 AND b.x % 2 = 1) OR (b.region = 0 AND b.x % 2 = 0 AND a.region = 1 AND a.x % 2 = 1)",
    CUSTOMER,
)(customer(lambda g, p: H.edge_weight(g.edges, _pathed(g).filter(((F.col("region") == 0) & (F.col("x") % 2 == 0)) | ((F.col("region") == 1) & (F.col("x") % 2 == 1))), ["0"], ["1"])))
register(
    "j9_subgraph_edge_weights",
    "SELECT least(a.nation, b.nation) AS n1, greatest(a.nation, b.nation) AS n2, sum(connections) AS weight FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.x % 3 <> 0 AND b.x % 3 <> 0 AND a.nation <> b.nation GROUP BY 1, 2",
    CUSTOMER,
)(
    customer(
        lambda g, p: H.quotient_edges(g.edges, H.with_path(g.nodes.filter("x % 3 <> 0"), ["nation"]), 1).select(
            F.get("q1", F.lit(0)).cast("long").alias("a"), F.get("q2", F.lit(0)).cast("long").alias("b"), "connections"
        ).select(F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2"), F.col("connections").alias("weight"))
    )
)
register(
    "j10_cluster_graph",
    "SELECT id, border_length + coalesce(o, 0) AS border_length FROM nodes LEFT JOIN (SELECT u, sum(length) AS o FROM both_ways JOIN nodes n ON n.id = v WHERE n.county > 1 GROUP BY u) ON u = id WHERE county <= 1",
    NATION, BOTH,
)(nation(lambda g, p: H.cluster_graph(g.nodes, g.edges, F.col("county") <= 1)[0].select("id", "border_length")))
register(
    "j11_intersection_matrix",
    "SELECT q.plan_id, p.district AS d0, q.district AS d1, sum(pop)::BIGINT AS pop FROM plans p JOIN plans q USING (node) JOIN nodes ON id = node WHERE p.plan_id = 0 GROUP BY ALL", NATION,
)(nation(lambda g, p: C.intersection_matrix(g.nodes, p.filter("plan_id = 0"), p)))
register("j12_cluster_of_node", "SELECT id, CASE WHEN region = 0 THEN 0 WHEN nation IN (1, 2) AND region <> 0 THEN 1 END AS cluster FROM nodes", CUSTOMER)(
    customer(lambda g, p: H.cluster_of(g.nodes.withColumn("pick", (F.col("region") != 0) & F.col("nation").isin(1, 2)), [[{"region": 0}], [{"pick": True}]]))
)
def _intervals(g):
    """Of the comb whose columns stand on the bottom row: a column's foot holds the column, the first foot of all holds all."""
    place = F.col("x") * 1_000_000 + F.col("y")
    return g.nodes.select("id", place.alias("enter"), F.when(F.col("y") == 0, F.col("x") * 1_000_000 + 999_999).otherwise(place).alias("leave"))


register(
    "j13_interval_containment",
    "SELECT a.id, count(*) AS below FROM iv a JOIN iv b ON b.enter >= a.enter AND b.leave <= a.leave GROUP BY 1",
    CUSTOMER, "iv AS (SELECT id, x * 1000000 + y AS enter, CASE WHEN y = 0 THEN x * 1000000 + 999999 ELSE x * 1000000 + y END AS leave FROM nodes)",
)(customer(lambda g, p: Q.contained_counts(_intervals(g))))


# ---------------------------------------------------------------- aggregates

register("a1_total_population", "SELECT sum(pop)::BIGINT AS value FROM nodes", CUSTOMER)(customer(lambda g, p: O.total(g.nodes, "pop")))
register("a1_max_attribute", "SELECT max(pop) AS value FROM nodes", CUSTOMER)(customer(lambda g, p: O.total(g.nodes, "pop", F.max)))
register(
    "a2_quotient_ids",
    "SELECT region::VARCHAR || '/' || nation::VARCHAR AS path, min(id) AS first, row_number() OVER (ORDER BY min(id))::INT AS qid FROM nodes GROUP BY region, nation", CUSTOMER,
)(customer(lambda g, p: _joined(H.quotient_ids(_pathed(g), 2), "path")))
register(
    "a3_quotient_nodes",
    "SELECT county::VARCHAR AS path, min(id) AS first, sum(pop)::BIGINT AS pop, sum(area) AS area, string_agg(DISTINCT name, ',' ORDER BY name) AS name FROM nodes GROUP BY county", NATION,
)(nation(lambda g, p: _joined(H.quotient_nodes(_pathed(g).select("id", "path", "pop", "area", "name"), 1), "path").withColumn("name", F.array_join("name", ","))))
register(
    "a4_quotient_graph",
    "SELECT a.county AS c1, b.county AS c2, sum(length) AS length FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.county < b.county GROUP BY 1, 2", NATION,
)(nation(lambda g, p: H.quotient_graph(_pathed(g), g.edges, 1)[1].select(F.get("q1", F.lit(0)).cast("int").alias("c1"), F.get("q2", F.lit(0)).cast("int").alias("c2"), "length")))
register("a5_node_set_sum", "SELECT set_id, sum(pop)::BIGINT AS pop FROM members JOIN nodes USING (id) GROUP BY 1", CUSTOMER, MEMBERS)(
    customer(lambda g, p: N.expand(_sets(g, *SETS), _pathed(g)).join(g.nodes, "id").groupBy("set_id").agg(F.sum("pop").alias("pop")))
)
register("a6_district_population", "SELECT plan_id, district, sum(pop)::BIGINT AS pop FROM plans JOIN nodes ON id = node GROUP BY 1, 2", CUSTOMER)(arrays(lambda p, g: A.district_sums(p, g, "pop"), lambda g, p: O.district_sums(g.nodes, p, "pop")))
_CUT = "SELECT plan_id, {v} AS cut_edges FROM (SELECT DISTINCT plan_id FROM plans) LEFT JOIN crossing USING (plan_id) GROUP BY 1"
register("a8_cut_edge_sum", _CUT.format(v="coalesce(sum(connections), 0)::DOUBLE"), CUSTOMER)(arrays(A.cut_edges, lambda g, p: O.cut_edges(g.edges, p)))
#: As many plans as fit a test of the SQL; the bench runs it over all tables as well.
MANY = 2000
register("a8_many_plans", _CUT.format(v="coalesce(sum(connections), 0)::DOUBLE"), CUSTOMER.replace("range(8)", f"range({MANY})"))(arrays(A.cut_edges, lambda g, p: O.cut_edges(g.edges, p), MANY))
register("a9_cut_edge_count", _CUT.format(v="count(src)"), CUSTOMER)(arrays(lambda p, g: A.cut_edges(p, g, None), lambda g, p: O.cut_edges(g.edges, p, None)))
register("a9_cut_edge_perimeter", _CUT.format(v="coalesce(sum(length), 0)::DOUBLE"), CUSTOMER)(arrays(lambda p, g: A.cut_edges(p, g, "length"), lambda g, p: O.cut_edges(g.edges, p, "length")))
register("a10_node_counts", "SELECT plan_id, district, count(*) AS nodes FROM plans GROUP BY 1, 2", CUSTOMER)(arrays(A.node_counts, lambda g, p: O.node_counts(p)))
register("a12_cut_edge_histogram", "SELECT cut_edges, count(*) AS n FROM (SELECT plan_id, sum(connections) AS cut_edges FROM crossing GROUP BY 1) GROUP BY 1", CUSTOMER)(
    arrays(lambda p, g: G.histogram(A.cut_edges(p, g), "cut_edges"), lambda g, p: G.histogram(O.cut_edges(g.edges, p), "cut_edges"))
)

# ---------------------------------------------------------------- windows and rankings


def _cycle(spark, sf_dir) -> DataFrame:
    line = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    return line.select(F.col("l_orderkey").alias("cycle_id"), F.row_number().over(w).alias("pos"), F.col("l_quantity").alias("weight"))


def _cycles(cycle: DataFrame) -> DataFrame:
    return cycle.groupBy("cycle_id").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("n_u"), F.sum("weight").alias("total"))


def lines(f):
    def run(spark, sf_dir):
        c = _cycle(spark, sf_dir)
        return f(c, _cycles(c), Y.cut_arcs(c, LOW, HIGH))

    return run


register(
    "w1_weighted_choice",
    "SELECT cycle_id, min(pos)::INT AS chosen FROM s WHERE upto > total * ((cycle_id * 37 % 100) / 100) GROUP BY 1", CYCLE,
)(lines(lambda c, cs, arcs: Y.running_choice(c.withColumn("draw", (F.col("cycle_id") * 37 % 100) / 100), ["cycle_id"], "pos", "weight", "draw")))
register("w2_inverse_path_weights", "SELECT cycle_id, pos::INT AS pos, sum(1 / weight) OVER (PARTITION BY cycle_id ORDER BY pos) AS running FROM cycle", CYCLE)(lines(lambda c, cs, arcs: Y.inverse_path_weights(c)))
register("w3_collapsed_weights", "SELECT cycle_id, pos::INT AS pos, weight FROM s", CYCLE)(
    lambda spark, sf: Y.collapsed_weights(_cycle(spark, sf).withColumn("mass", F.sum("weight").over(Window.partitionBy("cycle_id").orderBy("pos"))))
)
register(
    "w5_district_ranking",
    "SELECT plan_id, county, district, share, row_number() OVER (PARTITION BY plan_id, county ORDER BY share DESC, district)::INT AS rank FROM (SELECT plan_id, county, district, sum(pop)::BIGINT AS share FROM plans JOIN nodes ON id = node GROUP BY ALL)",
    NATION,
)(nation(lambda g, p: _ranked(g, p)))


def _ranked(g, p):
    share = p.join(g.nodes.select(F.col("id").alias("node"), "county", "pop"), "node").groupBy("plan_id", "county", "district").agg(F.sum("pop").alias("share"))
    w = Window.partitionBy("plan_id", "county").orderBy(F.col("share").desc(), "district")
    return share.withColumn("rank", F.row_number().over(w))


register("w7_cut_arcs", "SELECT cycle_id, a::INT AS a, b::INT AS b, pop FROM arc", CYCLE)(lines(lambda c, cs, arcs: arcs))
register("w8_preview", "SELECT plan_id, node, district FROM plans ORDER BY plan_id, node LIMIT 10", CUSTOMER)(customer(lambda g, p: p.orderBy("plan_id", "node").limit(10)))

# ---------------------------------------------------------------- set operations

BASE = "npop AS (SELECT region, nation, count(*) AS k FROM nodes GROUP BY ALL), rpop AS (SELECT region, count(*) AS k FROM nodes GROUP BY 1)"
_COMPRESS = """, got AS ({members}),
rh AS (SELECT region, count(*) AS h FROM got JOIN nodes USING (id) GROUP BY 1), nh AS (SELECT region, nation, count(*) AS h FROM got JOIN nodes USING (id) GROUP BY ALL),
wr AS (SELECT region FROM rh JOIN rpop USING (region) WHERE h = k), wn AS (SELECT region, nation FROM nh JOIN npop USING (region, nation) WHERE h = k)
SELECT region::VARCHAR AS path FROM wr UNION ALL SELECT region::VARCHAR || '/' || nation::VARCHAR FROM wn WHERE region NOT IN (SELECT region FROM wr)
UNION ALL SELECT n.region::VARCHAR || '/' || n.nation::VARCHAR || '/' || n.id::VARCHAR FROM got JOIN nodes n USING (id) WHERE n.region NOT IN (SELECT region FROM wr) AND n.nation NOT IN (SELECT nation FROM wn)"""


def _set_query(name: str, members: str, f):
    QUERIES[name] = customer(lambda g, p: _joined(f(g, _pathed(g)), "path").select("path"))
    SQL[name] = f"WITH {CUSTOMER},{BASE},{MEMBERS}" + _COMPRESS.format(members=members)


def _two(g):
    both = [_sets(g, *[x for x in SETS if x[0] == i]).withColumn("set_id", F.lit(0)) for i in (0, 1)]
    return both


_set_query("x1_intersect_node_sets", "SELECT id FROM members WHERE set_id = 0 INTERSECT SELECT id FROM members WHERE set_id = 1", lambda g, n: N.intersect(*_two(g), n, 3))
_set_query("x2_node_set_complement", "SELECT id FROM nodes EXCEPT SELECT id FROM members WHERE set_id = 0", lambda g, n: N.complement(_sets(g, (0, ())), _two(g)[0], n, 3))
_set_query("x3_merge_node_sets", "SELECT DISTINCT id FROM members", lambda g, n: N.merge(*_two(g), n, 3))
_set_query("x4_compress", "SELECT id FROM nodes WHERE region <> 3 OR id % 7 <> 0", lambda g, n: N.compress(n.filter((F.col("region") != 3) | (F.col("id") % 7 != 0)).select(F.lit(0).alias("set_id"), "id"), n, 3))
register("x5_children", "SELECT DISTINCT region::VARCHAR || '/' || nation::VARCHAR AS path FROM nodes WHERE region IN (0, 1)", CUSTOMER)(
    customer(lambda g, p: _joined(N.children(_sets(g, (0, ("0",)), (0, ("1",))), _pathed(g)), "path").select("path"))
)
register(
    "x6_shared_units",
    "SELECT a.plan_id, a.district AS d1, b.district AS d2, count(*) AS shared FROM u a JOIN u b ON a.plan_id = b.plan_id AND a.county = b.county AND a.district < b.district GROUP BY 1, 2, 3",
    NATION, "u AS (SELECT DISTINCT plan_id, county, district FROM plans JOIN nodes ON id = node)",
)(nation(lambda g, p: N.shared_units(p, g.nodes, "county")))
register("x7_move_unit", "SELECT id FROM members WHERE set_id = 0 AND id NOT IN (SELECT id FROM nodes WHERE region = 1) UNION SELECT id FROM nodes WHERE region = 3", CUSTOMER, MEMBERS)(
    customer(lambda g, p: N.add_unit(N.remove_unit(N.expand(_two(g)[0], _pathed(g)), _sets(g, (0, ("1",))), _pathed(g)), _sets(g, (0, ("3",))), _pathed(g)).select("id"))
)
register("x8_district_node_sets", "SELECT plan_id, district, path FROM ds", NATION,
    "per AS (SELECT plan_id, district, county, count(*) AS h FROM plans JOIN nodes ON id = node GROUP BY ALL), full_c AS (SELECT plan_id, district, county FROM per WHERE h = 5), ds AS (SELECT plan_id, district, county::VARCHAR AS path FROM full_c UNION ALL SELECT p.plan_id, p.district, n.county::VARCHAR || '/' || n.name FROM plans p JOIN nodes n ON n.id = p.node WHERE NOT EXISTS (SELECT 1 FROM full_c f WHERE f.plan_id = p.plan_id AND f.district = p.district AND f.county = n.county))",
)(nation(lambda g, p: _joined(N.district_sets(p, _pathed(g), 2), "path").select("set_id.plan_id", "set_id.district", "path")))
register(
    "x9_districts_of_unit", "SELECT plan_id, county::VARCHAR AS path, string_agg(DISTINCT district::VARCHAR, ',' ORDER BY district::VARCHAR) AS districts, CASE WHEN count(DISTINCT district) = 1 THEN min(district) END AS district FROM plans JOIN nodes ON id = node GROUP BY 1, 2", NATION,
)(nation(lambda g, p: _joined(N.districts_of(_pathed(g).select(F.slice("path", 1, 1).alias("path")).distinct(), p, _pathed(g)), "path").withColumn("districts", F.array_join(F.transform("districts", lambda d: d.cast("string")), ","))))
register("x10_node_vector", "SELECT plan_id, string_agg(district::VARCHAR, ',' ORDER BY node) AS districts FROM plans GROUP BY 1", CUSTOMER)(
    customer(lambda g, p: N.node_vector(p).withColumn("districts", F.array_join(F.transform("districts", lambda d: d.cast("string")), ",")))
)

# ---------------------------------------------------------------- graphs and trees

register(
    "g1_connected_components",
    # connected inside a district of the lattice plans: reachability by recursion
    "SELECT plan_id, district, count(DISTINCT c) AS components, count(DISTINCT c) = 1 AS connected FROM (SELECT plan_id, district, a, min(b) AS c FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2",
    NATION,
    REACH,
    recursive=True,
)(nation(lambda g, p: R.connected(g.edges, p)))
register("g2_induced_subgraph", "SELECT plan_id, pa.district, src AS u, dst AS v, connections AS w FROM edges JOIN plans pa ON pa.node = src JOIN plans pb USING (plan_id) WHERE pb.node = dst AND pa.district = pb.district", CUSTOMER)(
    customer(lambda g, p: R.inner_edges(g.edges, p))
)


def combs(f):
    def run(spark, sf_dir):
        g = S.nation_lattice(spark, sf_dir)
        return f(S.comb_trees(g), g)

    return run


register("g12_tree_edges", "SELECT tree_id, u, v FROM trees", NATION, COMBS)(combs(lambda t, g: t))
register("g13_tree_diameter", "SELECT tree_id, max(d) AS diameter FROM dist GROUP BY 1", NATION, COMBS, DIST, recursive=True)(combs(lambda t, g: R.diameters(t)))
register("g14_neighbour_lists", "SELECT tree_id, u AS node, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM arcs GROUP BY 1, 2", NATION, COMBS)(
    combs(lambda t, g: R.neighbour_lists(t).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",")))
)
register("g15_degree_distribution", "SELECT tree_id, degree, count(*) AS nodes FROM (SELECT tree_id, u, count(*) AS degree FROM arcs GROUP BY 1, 2) GROUP BY 1, 2", NATION, COMBS)(combs(lambda t, g: R.degree_distribution(t)))
register("w9_degree_histogram", "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM both_ways GROUP BY 1) GROUP BY 1", CUSTOMER, "both_ways AS (SELECT src FROM edges UNION ALL SELECT dst FROM edges)")(
    customer(lambda g, p: g.edges.select("src").union(g.edges.select("dst")).groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree"))
)
register("g15_average_degree", "SELECT tree_id, avg(degree) AS average_degree FROM deg GROUP BY 1", NATION, COMBS, DIST, recursive=True)(combs(lambda t, g: R.average_degree(t)))
register(
    "g16_centres_and_leaves", "SELECT deg.tree_id, deg.node, centres.node IS NOT NULL AS is_centre, degree = 1 AS is_leaf FROM deg LEFT JOIN centres ON centres.tree_id = deg.tree_id AND centres.node = deg.node WHERE centres.node IS NOT NULL OR degree = 1",
    NATION, COMBS, DIST, recursive=True,
)(combs(lambda t, g: R.centres_and_leaves(t)))
register("g17_centre_moment", "SELECT tree_id, pow(avg(pow(d, 2)), 0.5) AS moment FROM mean GROUP BY 1", NATION, COMBS, DIST, recursive=True)(combs(lambda t, g: R.centre_moment(t, 2.0)))
register("g17_centre_leaves_moment", "SELECT mean.tree_id, avg(d) AS moment FROM mean JOIN deg ON deg.tree_id = mean.tree_id AND deg.node = mean.node WHERE degree = 1 GROUP BY 1", NATION, COMBS, DIST, recursive=True)(
    combs(lambda t, g: R.centre_moment(t, 1.0, True))
)
register("g18_distances", "SELECT tree_id, b AS node, d AS hops FROM dist WHERE a = 0", NATION, COMBS, DIST, recursive=True)(combs(lambda t, g: R.distances(t, 0)))
register(
    "g19_subtree_mass", "SELECT up.tree_id, up.a AS node, sum(pop)::DOUBLE AS mass FROM (SELECT DISTINCT tree_id, a, b FROM below) up JOIN nodes ON id = b GROUP BY 1, 2",
    NATION, COMBS,
    "hop AS (SELECT DISTINCT tree_id, 0::BIGINT AS node, -1::BIGINT AS parent FROM arcs UNION ALL SELECT hop.tree_id, arcs.v, hop.node FROM hop JOIN arcs ON arcs.tree_id = hop.tree_id AND arcs.u = hop.node AND arcs.v <> hop.parent), below AS (SELECT tree_id, node AS a, node AS b FROM hop UNION ALL SELECT below.tree_id, a, hop.node FROM below JOIN hop ON hop.tree_id = below.tree_id AND hop.parent = below.b)",
    recursive=True,
)(combs(lambda t, g: R.subtree_masses(t, 0, g.nodes.select(F.col("id").alias("node"), F.col("pop").alias("mass")))))
register("g20_district_roots", "SELECT plan_id, district, min(node) AS root FROM plans GROUP BY 1, 2", NATION)(nation(lambda g, p: R.district_roots(R.component_labels(g.edges, p))))

# ---------------------------------------------------------------- energies and observables


def voting(f):
    def run(spark, sf_dir):
        g = S.nation_lattice(spark, sf_dir)
        p, v = S.nation_plans(g.nodes), S.votes(spark, sf_dir)
        weights = v.select("election").distinct().withColumn("weight", F.when(F.col("election").startswith("1"), 2.0).otherwise(1.0))
        return f(O.vote_sums(v, p), weights)

    return run


register(
    "w4_k_lowest",
    "SELECT plan_id, election, district, margin, rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, election ORDER BY margin, district)::INT AS rank FROM (SELECT plan_id, election, district, sum(margin) AS margin FROM margins GROUP BY ALL)) WHERE rank <= 2",
    NATION, VOTES,
)(voting(lambda s, w: O.k_lowest(O.performance_margins(s, "F").groupBy("plan_id", "election", "district").agg(F.sum("margin").alias("margin")), ["plan_id", "election"], "margin", 2, "district")))
# a row of five nations is a path (one tree); a path has ln 1 = 0, so log trees are tested on the 5 x 5 whole as well
register(
    "e1_log_spanning_trees",
    "SELECT 0 AS plan_id, 1 AS district, round(sum(CASE WHEN i + j > 0 THEN ln(4 - 2 * cos(pi() * i / 5) - 2 * cos(pi() * j / 5)) ELSE 0 END) - ln(25), 6) AS log_trees FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)",
)(nation(lambda g, p: R.log_spanning_trees(g.edges, p.filter("plan_id = 0").withColumn("district", F.lit(1))).withColumn("log_trees", F.round("log_trees", 6))))
ISO = """own AS (SELECT plan_id, district, sum(area) AS area, sum(border_length) AS b FROM plans JOIN nodes ON id = node GROUP BY 1, 2),
cutp AS (SELECT plan_id, d, sum(length) AS c FROM (SELECT plan_id, d1 AS d, length FROM crossing UNION ALL SELECT plan_id, d2, length FROM crossing) GROUP BY 1, 2),
iso AS (SELECT own.plan_id, district, b + coalesce(c, 0) AS perimeter, area, (b + coalesce(c, 0)) * (b + coalesce(c, 0)) / area AS score FROM own LEFT JOIN cutp ON cutp.plan_id = own.plan_id AND d = district)"""
register("e3_isoperimetric_scores", "SELECT plan_id, district, perimeter, area, score FROM iso", NATION, ISO)(small_arrays(A.isoperimetric))
register("e4_isoperimetric_score", "SELECT plan_id, sum(pow(score, 0.5)) AS score FROM iso GROUP BY 1", NATION, ISO)(small_arrays(lambda p, g: O.isoperimetric_score(A.isoperimetric(p, g), 0.5)))
register("e5_vra_votes", "SELECT plan_id, election, stage, district, candidate, votes FROM vsums", NATION, VOTES)(voting(lambda s, w: s))
register("e6_vra_margins", "SELECT plan_id, election, stage, district, margin FROM margins", NATION, VOTES)(voting(lambda s, w: O.performance_margins(s, "F")))
register(
    "e7_vra_score",
    "SELECT plan_id, sum(margin * weight) AS score FROM (SELECT plan_id, election, margin, row_number() OVER (PARTITION BY plan_id, election ORDER BY margin, district) AS r FROM (SELECT plan_id, election, district, sum(margin) AS margin FROM margins GROUP BY ALL)) JOIN weights USING (election) WHERE r <= 2 GROUP BY 1",
    NATION, VOTES,
)(voting(lambda s, w: O.performance_score(O.performance_margins(s, "F"), 2, w)))
register(
    "e8_vra_report",
    "SELECT plan_id, won, count(*) AS districts FROM (SELECT plan_id, district, sum(weight) AS won FROM (SELECT plan_id, election, district FROM margins GROUP BY ALL HAVING max(margin) = 0) JOIN weights USING (election) GROUP BY 1, 2) WHERE won > 0 GROUP BY 1, 2",
    NATION, VOTES.replace("candidate = 'F' THEN votes", "candidate = 'O' THEN votes"),
)(voting(lambda s, w: O.performance_report(O.performance_margins(s, "O"), w)))
register("e9_vra_target", "SELECT floor(sum(CASE WHEN county < 2 THEN pop ELSE 0 END) / sum(pop) * 5)::BIGINT AS target FROM nodes", NATION)(
    nation(lambda g, p: O.performance_target(g.nodes.withColumn("m", F.when(F.col("county") < 2, F.col("pop")).otherwise(0)), "m", "pop", 5))
)
PART = """pm AS (SELECT plan_id, election, district, 100.0 * v1 / nullif(v1 + v2, 0) AS margin FROM (SELECT plan_id, election, district, coalesce(sum(CASE WHEN candidate = 'F' THEN votes END), 0)::DOUBLE AS v1, coalesce(sum(CASE WHEN candidate = 'O' THEN votes END), 0)::DOUBLE AS v2 FROM vsums WHERE stage = 1 GROUP BY ALL))"""
register("e10_partisan_margins", "SELECT plan_id, election, district, margin FROM pm", NATION, VOTES, PART)(voting(lambda s, w: O.partisan_margins(s.filter("stage = 1"), "F", "O")))
register("e11_partisan_seats", "SELECT plan_id, election, sum(CASE WHEN margin > 50 THEN 1 ELSE 0 END)::BIGINT AS seats FROM pm GROUP BY 1, 2", NATION, VOTES, PART)(
    voting(lambda s, w: O.partisan_seats(O.partisan_margins(s.filter("stage = 1"), "F", "O")))
)


def _energies(g, p):
    iso = O.isoperimetric(g.nodes, g.edges, p).select("plan_id", "district", F.lit("iso").alias("name"), F.col("score").alias("value"))
    pop = O.district_sums(g.nodes, p, "pop").select("plan_id", "district", F.lit("pop").alias("name"), F.col("pop").cast("double").alias("value"))
    measure = g.nodes.sparkSession.createDataFrame([("iso", 0.3, ""), ("pop", 0.001, ""), ("none", 0.0, "")], "name string, weight double, description string")
    return iso.unionByName(pop), measure


register("e13_log_energy", "SELECT plan_id, 0.3 * sum(score) + 0.001 * (SELECT sum(pop) FROM nodes) AS log_energy FROM iso GROUP BY 1", NATION, ISO)(nation(lambda g, p: O.log_energy(*_energies(g, p))))
register(
    "e14_delta_energy",
    "SELECT a.plan_id AS old_plan, b.plan_id AS new_plan, exp(sum(0.3 * (a.score - b.score))) AS ratio FROM iso a JOIN iso b ON a.district = b.district AND b.plan_id = a.plan_id + 1 GROUP BY 1, 2", NATION, ISO,
)(nation(lambda g, p: _delta(g, p)))


def _delta(g, p):
    e, m = _energies(g, p)
    pairs = g.nodes.sparkSession.createDataFrame([(0, 1), (1, 2)], "old_plan int, new_plan int")
    return O.delta_energy(e.filter("name = 'iso'"), m, pairs=pairs)


register(
    "e16_ousted_population",
    """SELECT plan_id, sum(CASE WHEN u.n <= 1 THEN total - top ELSE big + greatest(0, ideal * (u.n - floor(u.n)) - coalesce(nxt, 0)) END)::DOUBLE AS ousted FROM (
  SELECT plan_id, county, any_value(n) AS n, any_value(ideal) AS ideal, any_value(total) AS total, max(share) AS top, sum(CASE WHEN r <= floor(n) THEN dpop - share ELSE 0 END) AS big, max(CASE WHEN r = floor(n) + 1 THEN share END) AS nxt FROM (
    SELECT sh.*, dpop, ideal, sum(share) OVER w AS total, sum(share) OVER w / ideal AS n, row_number() OVER (PARTITION BY sh.plan_id, county ORDER BY share DESC, sh.district) AS r
    FROM sh JOIN dp ON dp.plan_id = sh.plan_id AND dp.district = sh.district, (SELECT 150.0::DOUBLE AS ideal) WINDOW w AS (PARTITION BY sh.plan_id, county)) GROUP BY 1, 2) u GROUP BY 1""",
    NATION, "dp AS (SELECT plan_id, district, sum(pop) AS dpop FROM plans JOIN nodes ON id = node GROUP BY 1, 2), sh AS (SELECT plan_id, county, district, sum(pop) AS share FROM plans JOIN nodes ON id = node GROUP BY ALL)",
)(nation(lambda g, p: O.ousted_population(g.nodes, p, "county", 150.0)))
register(
    "e19_split_units", "SELECT plan_id, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END)::BIGINT AS split, sum(sqrt(f)) AS energy FROM (SELECT plan_id, county, 1 - max(share)::DOUBLE / sum(share) AS f FROM (SELECT plan_id, county, district, sum(pop) AS share FROM plans JOIN nodes ON id = node GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1", NATION,
)(nation(lambda g, p: O.split_units(g.nodes, p, "county")))


register("e20_log_linking_edges", "SELECT plan_id, sum(ln(w)) AS energy FROM (SELECT pa.plan_id, least(pa.district, pb.district) AS a, greatest(pa.district, pb.district) AS b, sum(t.connections) AS w FROM trade t JOIN plans pa ON pa.node = t.src JOIN plans pb ON pb.node = t.dst AND pb.plan_id = pa.plan_id WHERE pa.district <> pb.district GROUP BY 1, 2, 3) GROUP BY 1", NATION, TRADE)(
    small_arrays(A.log_linking_edges, lambda spark, sf_dir, g: S.trade_graph(spark, sf_dir))
)
register("e21_minority_fraction", "SELECT plan_id, district, sum(CASE WHEN county < 2 THEN pop ELSE 0 END)::DOUBLE / nullif(sum(pop), 0) AS fraction FROM plans JOIN nodes ON id = node GROUP BY 1, 2", NATION)(
    nation(lambda g, p: O.minority_fraction(g.nodes.withColumn("m", F.when(F.col("county") < 2, F.col("pop")).otherwise(0)), p, "m", "pop"))
)

# ---------------------------------------------------------------- constraints

POPS = "dp AS (SELECT plan_id, district, sum(pop) AS pop FROM plans JOIN nodes ON id = node GROUP BY 1, 2), tot AS (SELECT sum(pop) AS t FROM nodes)"


def _total(g) -> int:
    return g.nodes.agg(F.sum("pop")).first()[0] or 0


register("c1_population", "SELECT plan_id, bool_and(pop BETWEEN ceil(0.9 * t / 5) AND floor(1.1 * t / 5)) AS ok FROM dp, tot GROUP BY 1", NATION, POPS)(
    nation(lambda g, p: C.Population.around(_total(g), 5, 0.1).check(g.nodes, p))
)
UNITC = "uc AS (SELECT plan_id, county, count(DISTINCT district) AS k, sum(pop) AS pop FROM plans JOIN nodes ON id = node GROUP BY 1, 2)"
register(
    "c2_pack_nodes",
    "SELECT plan_id, bool_and(target <= 0 OR coalesce(packed, 0) >= target) AS ok FROM (SELECT plan_id, county, target FROM (SELECT DISTINCT plan_id FROM plans), (SELECT county, floor(sum(pop) / 150.0) - 1 AS target FROM nodes GROUP BY 1)) LEFT JOIN pk USING (plan_id, county) GROUP BY 1",
    NATION, "pk AS (SELECT plan_id, county, count(*) AS packed FROM (SELECT plan_id, district, min(county) AS county FROM plans JOIN nodes ON id = node GROUP BY 1, 2 HAVING count(DISTINCT county) = 1) GROUP BY 1, 2)",
)(nation(lambda g, p: C.PackNodes("county", 150.0, 1).check(g.nodes, p)))
#: Nodes b that a reaches inside its district and county, and whether each plan's traversals hang together.
TRAVERSALS = """te AS (SELECT ie.* FROM ie JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.county = b.county),
walk AS (SELECT plan_id, district, node AS a, node AS b FROM plans UNION SELECT w.plan_id, w.district, a, te.v FROM walk w JOIN te ON te.plan_id = w.plan_id AND te.u = w.b),
least AS (SELECT plan_id, district, a, min(b) AS part FROM walk GROUP BY 1, 2, 3),
whole AS (SELECT plan_id, bool_and(k = 1) AS ok FROM (SELECT plan_id, district, county, count(DISTINCT part) AS k FROM least JOIN nodes ON id = a GROUP BY 1, 2, 3) GROUP BY 1)"""
register("c3_contiguous_traversals", "SELECT plan_id, ok FROM whole", NATION, REACH, TRAVERSALS, recursive=True)(nation(lambda g, p: C.ContiguousTraversals("county").check(g.nodes, p, g.edges)))
register("c4_max_coarse_splits", "SELECT plan_id, (sum(k) - count(*))::BIGINT AS splits FROM uc GROUP BY 1", NATION, UNITC)(nation(lambda g, p: C.MaxCoarseSplits("county", 3).splits(g.nodes, p)))
register("c5_max_shared_coarse", "SELECT plan_id, coalesce(max(shared), 0) <= 1 AS ok FROM (SELECT DISTINCT plan_id FROM plans) LEFT JOIN (SELECT a.plan_id, a.district, b.district, count(*) AS shared FROM u a JOIN u b ON a.plan_id = b.plan_id AND a.county = b.county AND a.district < b.district GROUP BY 1, 2, 3) USING (plan_id) GROUP BY 1", NATION, "u AS (SELECT DISTINCT plan_id, county, district FROM plans JOIN nodes ON id = node)")(
    nation(lambda g, p: C.MaxSharedCoarse("county", 1).check(g.nodes, p))
)
register("c7_allowed_excess", "SELECT plan_id, bool_and(k <= CASE WHEN pop < 300 THEN 2 ELSE ceil(pop / 300.0) END) AS ok FROM uc GROUP BY 1", NATION, UNITC)(nation(lambda g, p: C.AllowedExcess("county", 300.0).check(g.nodes, p)))
PERMS = """m AS (SELECT q.plan_id, p.district AS d0, q.district AS d1, sum(pop * 1000 + id * id)::DOUBLE AS pop FROM plans p JOIN plans q USING (node) JOIN nodes ON id = node WHERE p.plan_id = 0 GROUP BY ALL),
d5 AS (SELECT unnest(range(1, 6)) AS d), perm AS (SELECT a.d AS p1, b.d AS p2, c.d AS p3, e.d AS p4, f.d AS p5 FROM d5 a, d5 b, d5 c, d5 e, d5 f WHERE len(list_distinct([a.d, b.d, c.d, e.d, f.d])) = 5),
long AS (SELECT row_number() OVER () AS pid, [p1, p2, p3, p4, p5] AS l FROM perm), cell AS (SELECT pid, unnest(range(1, 6)) AS d0, unnest(l) AS d1 FROM long),
val AS (SELECT plan_id, pid, sum(coalesce(pop, 0)) AS v FROM cell LEFT JOIN m USING (d0, d1) WHERE plan_id IS NOT NULL GROUP BY 1, 2),
best AS (SELECT plan_id, arg_max(pid, v) AS pid FROM val GROUP BY 1)"""
register(
    "c8_hamming_distance",
    "SELECT b.plan_id::BIGINT AS plan_id, avg((1 - coalesce(m.pop, 0) / r.pop + 1 - coalesce(m.pop, 0) / c.pop) / 2) AS distance FROM best b JOIN cell USING (pid) LEFT JOIN m ON m.plan_id = b.plan_id AND m.d0 = cell.d0 AND m.d1 = cell.d1 JOIN (SELECT plan_id, d0, sum(pop) AS pop FROM m GROUP BY 1, 2) r ON r.plan_id = b.plan_id AND r.d0 = cell.d0 JOIN (SELECT plan_id, d1, sum(pop) AS pop FROM m GROUP BY 1, 2) c ON c.plan_id = b.plan_id AND c.d1 = cell.d1 GROUP BY 1",
    NATION, PERMS,
)(
    # populations made distinct, so that the best matching is the only one
    nation(lambda g, p: C.MaxHamming(0.5).distances(g.nodes.withColumn("pop", F.col("pop") * 1000 + F.col("id") * F.col("id")), p.filter("plan_id = 0"), p))
)
def _all_constraints(nodes, total) -> C.Constraints:
    out = C.Constraints()
    for c in (C.Population.around(total, 5, 0.4), C.PackNodes("county", 150.0, 1), C.MaxCoarseSplits("county", 20), C.MaxSharedCoarse("county", 5), C.AllowedExcess("county", 300.0, 4), C.ContiguousTraversals("county"), C.MaxHamming(0.85, population="odd")):
        out.add(c)
    return out


# populations of their own for the matching, so that the best one is the only one
register(
    "c9_satisfies_constraints",
    """SELECT plan_id, a.ok AND b.ok AND c.k <= 20 AND d.most <= 5 AND e.ok AND w.ok AND h.distance <= 0.85 AS ok
FROM (SELECT plan_id, bool_and(pop BETWEEN ceil(0.6 * t / 5) AND floor(1.4 * t / 5)) AS ok FROM dp, tot GROUP BY 1) a
JOIN (SELECT plan_id, bool_and(target <= 0 OR coalesce(packed, 0) >= target) AS ok FROM (SELECT plan_id, county, target FROM (SELECT DISTINCT plan_id FROM plans), (SELECT county, floor(sum(pop) / 150.0) - 1 AS target FROM nodes GROUP BY 1))
  LEFT JOIN (SELECT plan_id, county, count(*) AS packed FROM (SELECT plan_id, district, min(county) AS county FROM plans JOIN nodes ON id = node GROUP BY 1, 2 HAVING count(DISTINCT county) = 1) GROUP BY 1, 2) USING (plan_id, county) GROUP BY 1) b USING (plan_id)
JOIN (SELECT plan_id, sum(k) - count(*) AS k FROM uc GROUP BY 1) c USING (plan_id)
JOIN (SELECT plan_id, coalesce(max(shared), 0) AS most FROM (SELECT DISTINCT plan_id FROM plans) LEFT JOIN (SELECT x.plan_id, count(*) AS shared FROM un x JOIN un y ON x.plan_id = y.plan_id AND x.county = y.county AND x.district < y.district GROUP BY x.plan_id, x.district, y.district) USING (plan_id) GROUP BY 1) d USING (plan_id)
JOIN (SELECT plan_id, bool_and(k <= CASE WHEN pop < 300 THEN 6 ELSE ceil(pop / 300.0) + 4 END) AS ok FROM uc GROUP BY 1) e USING (plan_id)
JOIN whole w USING (plan_id)
JOIN (SELECT b.plan_id, avg((1 - coalesce(m.pop, 0) / r.pop + 1 - coalesce(m.pop, 0) / c.pop) / 2) AS distance FROM best b JOIN cell USING (pid) LEFT JOIN m ON m.plan_id = b.plan_id AND m.d0 = cell.d0 AND m.d1 = cell.d1
  JOIN (SELECT plan_id, d0, sum(pop) AS pop FROM m GROUP BY 1, 2) r ON r.plan_id = b.plan_id AND r.d0 = cell.d0 JOIN (SELECT plan_id, d1, sum(pop) AS pop FROM m GROUP BY 1, 2) c ON c.plan_id = b.plan_id AND c.d1 = cell.d1 GROUP BY 1) h USING (plan_id)""",
    NATION, REACH, TRAVERSALS, POPS, UNITC, PERMS, "un AS (SELECT DISTINCT plan_id, county, district FROM plans JOIN nodes ON id = node)", recursive=True,
)(
    nation(lambda g, p: _seven(g, written(g.nodes.withColumn("odd", F.col("pop") * 1000 + F.col("id") * F.col("id")), "nodes"), written(p, "plans")))
)


def _seven(g, nodes, plans):
    return C.satisfied(_all_constraints(nodes, nodes.agg(F.sum("pop")).first()[0] or 0), nodes, plans, g.edges, plans.filter("plan_id = 0"))


# ---------------------------------------------------------------- plans, chains and diagnostics

register("m1_plan_from_column", "SELECT id AS node, (nation + 1)::INT AS district FROM nodes", CUSTOMER)(customer(lambda g, p: _from_column(g.nodes, "nation")))


def _from_column(nodes: DataFrame, column: str) -> DataFrame:
    from parcela.plans.tables import plan_from_column

    return plan_from_column(nodes, column)


@register("m12_chains", None)
def m12(spark, sf_dir):
    """Four chains of 200 steps on the nation lattice, five districts within 20 %: output every 50 steps."""
    from parcela.plans.chain import run_chains
    from parcela.plans.forest import LocalGraph

    g = S.nation_lattice(spark, sf_dir)
    local = LocalGraph.from_tables(g.nodes.toPandas(), g.edges.toPandas(), g.spec)
    bounds = C.Population.around(float(local.pop.sum()), 5, 0.2)
    config = run_config.RunConfig(two_tree_steps=20, output_freq=5, two_tree_frac=0.1, chains=4)
    out = run_chains(run_config.chains(spark, config), local, 5, bounds.low, bounds.high, config.every)
    return out.select("chain_id", "step", F.array_join(F.transform("districts", lambda d: d.cast("string")), ",").alias("districts"), "accepted", "proposals")


def _chain_log(spark, sf_dir):
    """The proposals of four chains of 1,000 steps on the nation lattice."""
    from parcela.plans import chain
    from parcela.plans.forest import LocalGraph

    g = S.nation_lattice(spark, sf_dir)
    graph = LocalGraph.from_tables(g.nodes.toPandas(), g.edges.toPandas(), g.spec)
    bounds = C.Population.around(float(graph.pop.sum()), 5, 0.2)
    config = run_config.RunConfig(two_tree_steps=500, output_freq=50, two_tree_frac=0.5, chains=4)
    mix = {"two_tree": config.two_tree_frac, "one_tree": 1 - config.two_tree_frac}
    return chain.proposal_log(chain.run_chains(run_config.chains(spark, config), graph, 5, bounds.low, bounds.high, config.every, mix))


# random, so without SQL: the tests hold them against what the chains report
register("t1_chain_acceptance", None)(lambda spark, sf: G.acceptance_ratios(_chain_log(spark, sf).withColumn("value", F.col("ratio")), 100))
register("t8_chain_diagnostics", None)(lambda spark, sf: G.chain_diagnostics(_chain_log(spark, sf), 100))


def _log(f):
    return lambda spark, sf: f(S.proposal_log(spark, sf))


register("t1_acceptance_ratios", 'SELECT floor(step / 100)::BIGINT AS "window", proposal, count(*) AS proposals, avg(least(1, greatest(0, coalesce(value, 0)))) AS acceptance FROM (SELECT event_id AS step, event_type AS proposal, value FROM events) GROUP BY 1, 2')(
    _log(partial(G.acceptance_ratios, every=100))
)
register("t2_cycle_lengths", "SELECT cycle_id, n FROM cycles", CYCLE)(lines(lambda c, cs, arcs: cs.select("cycle_id", "n")))
# the last position of the first district is marked; its label is to be swapped in every second cycle
_MARK = "((n_u BETWEEN a AND b) <> (cycle_id % 2 = 0))"
register("t3_changed_nodes", f"SELECT cycle_id, a::INT AS a, b::INT AS b, CASE WHEN {_MARK} THEN n - ov ELSE ov END::DOUBLE AS changed FROM (SELECT a.cycle_id, a, b, any_value(n) AS n, any_value(n_u) AS n_u, sum(CASE WHEN a <= n_u AND pos BETWEEN a AND least(n_u, b) THEN 1 WHEN a > n_u + 1 AND pos BETWEEN n_u + 1 AND a - 1 THEN 1 ELSE 0 END) + sum(CASE WHEN b < n AND pos >= greatest(n_u + 1, b + 1) THEN 1 ELSE 0 END) AS ov FROM arc a JOIN cycles c USING (cycle_id) JOIN cycle k ON k.cycle_id = a.cycle_id GROUP BY a.cycle_id, a, b) a", CYCLE)(
    lines(lambda c, cs, arcs: Y.changed_mass(_marked(Y.overlaps(c.withColumn("weight", F.lit(1.0)), cs, arcs)), "stays"))
)
register("t4_changed_population", f"SELECT cycle_id, a::INT AS a, b::INT AS b, (CASE WHEN {_MARK} THEN s.total - overlap ELSE overlap END)::DOUBLE AS changed FROM swap s JOIN cycles USING (cycle_id)", CYCLE)(
    lines(lambda c, cs, arcs: Y.changed_mass(_marked(Y.overlaps(c, cs, arcs)), "stays"))
)
register("t4_changed_population_unmarked", "SELECT cycle_id, a::INT AS a, b::INT AS b, least(overlap, total - overlap)::DOUBLE AS changed FROM swap", CYCLE)(lines(lambda c, cs, arcs: Y.changed_mass(Y.overlaps(c, cs, arcs))))


def _marked(found: DataFrame) -> DataFrame:
    return Y.mark_stays(found, F.col("n_u"), F.col("cycle_id") % 2 == 0)


register("t5_cuttable_pairs", "SELECT c.cycle_id, count(a) + 1 AS pairs FROM cycles c LEFT JOIN arc USING (cycle_id) GROUP BY 1", CYCLE)(lines(lambda c, cs, arcs: Y.cuttable_pairs(cs.select("cycle_id"), arcs)))
register("t6_unique_cuttable_edges", "SELECT cycle_id, count(DISTINCT cut) AS edges FROM (SELECT cycle_id, 1 AS cut FROM cycles UNION ALL SELECT cycle_id, n_u + 1 FROM cycles UNION ALL SELECT cycle_id, a FROM arc UNION ALL SELECT cycle_id, b % n + 1 FROM arc JOIN cycles USING (cycle_id)) GROUP BY 1", CYCLE)(
    lines(lambda c, cs, arcs: Y.unique_cuttable_edges(cs.drop("total"), arcs))
)
register("t7_swappable_population", "SELECT c.cycle_id, coalesce(max(least(overlap, s.total - overlap)), 0) / any_value(c.total) AS most, coalesce(sum(least(overlap, s.total - overlap)), 0) / ((count(s.a) + 1) * any_value(c.total)) AS average FROM cycles c LEFT JOIN swap s USING (cycle_id) GROUP BY 1", CYCLE)(
    lines(lambda c, cs, arcs: Y.swappable(Y.overlaps(c, cs, arcs), cs.select("cycle_id", "total")))
)
register("t8_gathered_diagnostics", 'SELECT floor(step / 1000)::BIGINT AS "window", proposal, string_agg(coalesce(round(value * 1000)::BIGINT::VARCHAR, \'-\'), \',\' ORDER BY step) AS "values" FROM (SELECT event_id AS step, event_type AS proposal, value FROM events) GROUP BY 1, 2')(
    _log(lambda log: G.gathered(log, 1000).withColumn("values", F.array_join(F.transform("values", lambda x: F.coalesce(F.round(x * 1000).cast("long").cast("string"), F.lit("-"))), ",")))
)


# ---------------------------------------------------------------- the rest of the inventory


@register("p4_in_node", "SELECT id FROM nodes WHERE region = 2 AND x = 3", CUSTOMER)
def p4(spark, sf_dir):
    return S.customer_lattice(spark, sf_dir).nodes.filter(H.matches([{"region": 2, "x": 3}])).select("id")


register("p8_intact_units", "SELECT plan_id, county, count(DISTINCT district) = 1 AS intact FROM plans JOIN nodes ON id = node GROUP BY 1, 2", NATION)(nation(lambda g, p: _intact(g, p)))


def _intact(g, p):
    """A unit is intact where its list of parts is null: one district holds it all."""
    parts = p.join(g.nodes.select(F.col("id").alias("node"), "county"), "node").groupBy("plan_id", "county").agg(F.collect_set("district").alias("ds"))
    return parts.select("plan_id", "county", N.intact(F.when(F.size("ds") > 1, F.col("ds"))).alias("intact"))


register(
    "p10_scalar_math", "SELECT id, pow(pop, 0.5) AS root, ln(pop + 1) AS logarithm, floor(pop / 3.0)::BIGINT AS low, ceil(pop / 3.0)::BIGINT AS high, least(pop, 50) AS at_most, greatest(pop, 50) AS at_least FROM nodes", NATION,
)(
    nation(
        lambda g, p: g.nodes.select(
            "id", F.pow("pop", F.lit(0.5)).alias("root"), F.log(F.col("pop") + 1).alias("logarithm"), F.floor(F.col("pop") / 3.0).alias("low"), F.ceil(F.col("pop") / 3.0).alias("high"),
            F.least("pop", F.lit(50)).alias("at_most"), F.greatest("pop", F.lit(50)).alias("at_least"),
        )
    )
)
register("p11_names", "SELECT id, 'step' || id AS step, name || ',' || county::VARCHAR AS joined, '.JSON' AS suffix FROM nodes", NATION)(
    nation(lambda g, p: g.nodes.select("id", ensemble.map_name("id").alias("step"), F.concat_ws(",", "name", "county").alias("joined"), X.suffix(F.concat("name", F.lit(".json"))).alias("suffix")))
)
register("p12_set_all", "SELECT plan_id, 0 AS total, count(*) AS n FROM plans GROUP BY 1", CUSTOMER)(
    customer(lambda g, p: N.node_vector(p).withColumn("z", X.set_all("districts", 0)).select("plan_id", F.aggregate("z", F.lit(0), lambda s, x: s + x).alias("total"), F.size("z").cast("long").alias("n")))
)
register(
    "j3_all_fine_neighbors",
    "SELECT DISTINCT 1 AS level, a.region::VARCHAR AS node, b.region::VARCHAR AS nbr, b.region::VARCHAR || '/' || b.nation::VARCHAR AS fine FROM both_ways JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.region <> b.region UNION SELECT DISTINCT 2, a.region::VARCHAR || '/' || a.nation::VARCHAR, b.region::VARCHAR || '/' || b.nation::VARCHAR, b.region::VARCHAR || '/' || b.nation::VARCHAR || '/' || b.id::VARCHAR FROM both_ways JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.nation <> b.nation",
    CUSTOMER, BOTH,
)(customer(lambda g, p: _joined(H.all_fine_neighbors(g.edges, _pathed(g), 3), "node", "nbr", "fine").select("level", "node", "nbr", "fine")))
COMPONENT = "label AS (SELECT plan_id, district, a AS node, min(b) AS component FROM reach GROUP BY 1, 2, 3)"
register("a7_component_sum", "SELECT plan_id, district, component, sum(pop)::BIGINT AS pop FROM label JOIN nodes ON id = node GROUP BY 1, 2, 3", NATION, REACH, COMPONENT, recursive=True)(
    nation(lambda g, p: R.component_labels(g.edges, p).join(g.nodes.select(F.col("id").alias("node"), "pop"), "node").groupBy("plan_id", "district", "component").agg(F.sum("pop").alias("pop")))
)
register("g1_components_by_rounds", "SELECT plan_id, district, node, component FROM (SELECT plan_id, district, a AS node, min(b) AS component FROM reach GROUP BY 1, 2, 3)", CUSTOMER, REACH, recursive=True)(
    customer(lambda g, p: R.component_labels_by_rounds(g.edges, written(p, "plans")))
)
register("g11_component_sizes", "SELECT plan_id, district, component, count(*) AS nodes FROM label GROUP BY 1, 2, 3", NATION, REACH, COMPONENT, recursive=True)(
    nation(lambda g, p: R.component_labels(g.edges, p).groupBy("plan_id", "district", "component").agg(F.count("*").alias("nodes")))
)
# plan 2 has districts in parts, which have no tree; one with an edge less than nodes has one. Plan 3 is the whole lattice, which has what e1's
# formula says; plan 4 two ladders of five rungs and a column
FORESTS = """parts AS (SELECT plan_id, district, count(DISTINCT component) AS parts, count(*) AS n FROM label GROUP BY 1, 2),
links AS (SELECT plan_id, district, count(*) AS m FROM inner_e GROUP BY 1, 2),
forests AS (SELECT plan_id, sum(CASE WHEN parts > 1 THEN '-inf'::DOUBLE WHEN coalesce(m, 0) = n - 1 THEN 0.0::DOUBLE END) AS log_forests FROM parts LEFT JOIN links USING (plan_id, district) GROUP BY 1 HAVING bool_and(parts > 1 OR coalesce(m, 0) = n - 1)
  UNION ALL SELECT 4, 2 * ln((pow(2 + sqrt(3), 5) - pow(2 - sqrt(3), 5)) / (2 * sqrt(3)))
  UNION ALL SELECT 3, sum(CASE WHEN i + j > 0 THEN ln(4 - 2 * cos(pi() * i / 5) - 2 * cos(pi() * j / 5)) ELSE 0 END) - ln(25) FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j))"""


def _ladders(g):
    """Plan 4: columns 0 and 1, 2 and 3, and 4."""
    return g.nodes.select(F.lit(4).alias("plan_id"), F.col("id").alias("node"), (F.floor(F.col("x") / 2) + 1).cast("int").alias("district"))


def _weighted_ladders(g):
    """Rails of weight 0.01 times the district's number, rungs of 0.02: light enough for log counts under -30."""
    ends = g.nodes.select(F.col("id").alias("src"), F.col("x").alias("sx")), g.nodes.select(F.col("id").alias("dst"), F.col("x").alias("dx"))
    e = g.edges.join(ends[0], "src").join(ends[1], "dst")
    weight = F.when(F.col("sx") == F.col("dx"), 0.01 * (F.floor(F.col("sx") / 2) + 1)).otherwise(0.02)
    return e.withColumn("connections", weight).select("src", "dst", "connections")


# trees of a ladder by its rungs: t spanning trees, f forests of two parts that hold one of the last two nodes each
register(
    "e1_weighted_ladders",
    "SELECT 4 AS plan_id, d AS district, round(ln(t), 6) AS log_trees FROM rung WHERE n = 5 UNION ALL SELECT 4, 3, round(4 * ln(0.03), 6)",
    "rung AS (SELECT d, 1 AS n, 0.02::DOUBLE AS t, 1.0::DOUBLE AS f, d * 0.01::DOUBLE AS a, 0.02::DOUBLE AS b FROM (SELECT unnest([1, 2]) AS d) UNION ALL SELECT d, n + 1, t * (a * a + 2 * a * b) + f * a * a * b, 2 * a * t + a * a * f, a, b FROM rung WHERE n < 5)",
    recursive=True,
)(nation(lambda g, p: R.log_spanning_trees(_weighted_ladders(g), _ladders(g)).withColumn("log_trees", F.round("log_trees", 6))))


def _tree_counts(g, p):
    whole = g.nodes.select(F.lit(3).alias("plan_id"), F.col("id").alias("node"), F.lit(1).alias("district"))
    return R.log_spanning_trees(g.edges, p.unionByName(whole).unionByName(_ladders(g)))


register("e2_log_spanning_forests", "SELECT plan_id, round(log_forests, 6) AS log_forests FROM forests", NATION, REACH, COMPONENT, FORESTS, recursive=True)(
    nation(lambda g, p: R.log_spanning_forests(_tree_counts(g, p)).withColumn("log_forests", F.round("log_forests", 6) + 0.0))
)
register(
    "e22_tree_count_ratio",
    "SELECT o.plan_id AS old_plan, n.plan_id AS new_plan, round(n.log_forests - o.log_forests, 6) AS log_ratio FROM forests o JOIN forests n ON o.plan_id <> n.plan_id",
    NATION, REACH, COMPONENT, FORESTS, recursive=True,
)(
    nation(
        lambda g, p: R.tree_count_ratio(
            _tree_counts(g, p), g.nodes.sparkSession.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "old_plan int, new_plan int")
        ).withColumn("log_ratio", F.round("log_ratio", 6) + 0.0)
    )
)
register("a11_weighted_votes", "SELECT plan_id, election, sum(votes * weight) AS weighted FROM vsums JOIN weights USING (election) WHERE stage = 1 AND candidate = 'F' GROUP BY 1, 2", NATION, VOTES)(
    voting(lambda s, w: s.filter("stage = 1 AND candidate = 'F'").join(w, "election").groupBy("plan_id", "election").agg(F.sum(F.col("votes") * F.col("weight")).alias("weighted")))
)
register("g3_subgraph", "SELECT src, dst, length, connections FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.region = 1 AND b.region = 1", CUSTOMER)(
    customer(lambda g, p: H.subgraph(g.nodes, g.edges, g.nodes.filter("region = 1").select("id"))[1].select("src", "dst", "length", "connections"))
)


def _local(spark, sf_dir, lattice=S.nation_lattice):
    from parcela.plans.forest import LocalGraph

    g = lattice(spark, sf_dir)
    return g, LocalGraph.from_tables(g.nodes.toPandas(), g.edges.toPandas(), g.spec)


def seeded(f, schema: str, check, tolerance: float = 0.25):
    """Rows of f(rng, graph, bounds) on the nation lattice for eight seeds, one task each, as a table (seed, ...) that ``check(g, rows, bounds)`` sums up.

    The SQL has what is true of any right tree or plan; that these are is found from their rows, by joins with the graph.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, graph = _local(spark, sf_dir)
        bounds = C.Population.around(float(graph.pop.sum()), 5, tolerance)
        shared = spark.sparkContext.broadcast(graph)
        names = [x.split()[0] for x in schema.split(", ")]

        def one(pdf):
            import pandas as pd

            seed = int(pdf.seed.iloc[0])
            return pd.DataFrame(f(np.random.default_rng(seed), shared.value, bounds), columns=names).assign(seed=seed)[["seed", *names]]

        rows = spark.range(8).withColumnRenamed("id", "seed").groupBy("seed").applyInPandas(one, f"seed long, {schema}")
        return check(g, written(rows, "seeded"), bounds)

    return run


def _tree(sample):
    def f(rng, g, bounds):
        from parcela.plans import forest

        tree = sorted(getattr(forest, sample)(g, list(range(len(g.ids))), rng))
        return [(int(g.ids[g.u[e]]), int(g.ids[g.v[e]])) for e in tree]

    return f


def _spanning(g, trees, bounds):
    """seed, edges (of the graph), reached (nodes, from the first), pop (theirs)."""
    edges = trees.join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi").groupBy("seed").agg(F.count("*").alias("edges"))
    seen = R.distances(trees.withColumnRenamed("seed", "tree_id"), 0).join(g.nodes.select(F.col("id").alias("node"), "pop"), "node")
    seen = seen.groupBy(F.col("tree_id").alias("seed")).agg(F.count_distinct("node").alias("reached"), F.sum("pop").alias("pop"))
    return edges.join(seen, "seed")


SPANNING = "SELECT seed::BIGINT AS seed, (SELECT count(*) - 1 FROM nodes)::BIGINT AS edges, (SELECT count(*) FROM nodes)::BIGINT AS reached, (SELECT sum(pop) FROM nodes)::BIGINT AS pop FROM (SELECT unnest(range(8)) AS seed)"
for _name, _sample in (("g5_wilson_tree", "wilson_tree"), ("g6_kruskal_tree", "kruskal_tree"), ("g7_exchange_tree", "exchange_tree")):
    register(_name, SPANNING, NATION)(seeded(_tree(_sample), "u long, v long", _spanning))


def _sound(g, plans, low, high, population="pop", labels=R.component_labels):
    """plan_id, districts, pop, balanced, parts (connected ones of all districts), nodes: found from rows (plan_id, node, district)."""
    pops = O.district_sums(g.nodes, plans, population).groupBy("plan_id").agg(
        F.count("*").alias("districts"), F.sum(population).alias("pop"), F.bool_and(F.col(population).between(low, high)).alias("balanced")
    )
    parts = labels(g.edges, plans).groupBy("plan_id").agg(F.count_distinct("district", "component").alias("parts"), F.count("*").alias("nodes"))
    return pops.join(parts, "plan_id")


def _plan(rng, g, bounds):
    from parcela.plans.forest import random_plan

    return list(zip(g.ids.tolist(), random_plan(g, 5, bounds.low, bounds.high, rng).tolist(), strict=True))


SOUND = "SELECT seed::BIGINT AS seed, {d}::BIGINT AS districts, (SELECT sum(pop) FROM nodes)::BIGINT AS pop, true AS balanced, {d}::BIGINT AS parts, (SELECT count(*) FROM nodes)::BIGINT AS nodes{more} FROM (SELECT unnest(range({seeds})) AS seed)"
register("m3_random_plans", SOUND.format(d=5, seeds=8, more=""), NATION)(
    seeded(_plan, "node long, district int", lambda g, rows, b: _sound(g, rows.withColumnRenamed("seed", "plan_id"), b.low, b.high).withColumnRenamed("plan_id", "seed"))
)


def _fixed(rng, g, bounds):
    from parcela.plans.forest import random_plan, random_plan_with_fixed

    first = random_plan(g, 5, bounds.low, bounds.high, rng)
    plan = random_plan_with_fixed(g, np.where(first == 1, 1, 0), 5, bounds.low, bounds.high, rng)
    return list(zip(g.ids.tolist(), plan.tolist(), first.tolist(), strict=True))


def _kept(g, rows, b):
    """A sound plan, and how many nodes changed between the district held fixed and the others."""
    moved = rows.groupBy("seed").agg(F.sum(((F.col("first") == 1) != (F.col("district") == 1)).cast("long")).alias("moved"))
    return _sound(g, rows.select(F.col("seed").alias("plan_id"), "node", "district"), b.low, b.high).withColumnRenamed("plan_id", "seed").join(moved, "seed")


register("m5_random_plans_with_fixed", SOUND.format(d=5, seeds=8, more=", 0::BIGINT AS moved"), NATION)(seeded(_fixed, "node long, district int, first int", _kept))


def _clusters(rng, g, bounds):
    """The lattice's lower two rows as one cluster of two districts, the rest as one of three."""
    from parcela.plans.forest import random_plan_by_cluster

    cluster = (np.arange(len(g.ids)) >= 10).astype(int)
    return list(zip(g.ids.tolist(), random_plan_by_cluster(g, cluster, {0: 2, 1: 3}, 0.3 * bounds.low, 2 * bounds.high, rng).tolist(), cluster.tolist(), strict=True))


def _by_cluster(g, rows, b):
    spread = rows.groupBy("seed", "district").agg(F.count_distinct("cluster").alias("k"), F.min("cluster").alias("c")).groupBy("seed").agg(F.max("k").alias("clusters"), F.sum((F.col("c") == 0).cast("long")).alias("lower"))
    return _sound(g, rows.select(F.col("seed").alias("plan_id"), "node", "district"), 0.3 * b.low, 2 * b.high).withColumnRenamed("plan_id", "seed").join(spread, "seed")


register("m4_random_plans_by_cluster", SOUND.format(d=5, seeds=8, more=", 1::BIGINT AS clusters, 2::BIGINT AS lower"), NATION)(seeded(_clusters, "node long, district int, cluster int", _by_cluster))


def _multiscale(rng, g, bounds):
    from parcela.plans.forest import hierarchical_tree

    row = np.arange(len(g.ids)) // 5
    return [(int(g.ids[g.u[e]]), int(g.ids[g.v[e]])) for e in sorted(hierarchical_tree(g, list(range(len(g.ids))), rng, [row]))]


def _between(g, trees, b):
    """A spanning tree, and how many of its edges lie between rows of the lattice."""
    y = F.floor(F.col("u") / 5) != F.floor(F.col("v") / 5)
    return _spanning(g, trees, b).join(trees.groupBy("seed").agg(F.sum(y.cast("long")).alias("between_units")), "seed")


register("m7_multiscale_trees", SPANNING.replace(" FROM (SELECT unnest", ", 4::BIGINT AS between_units FROM (SELECT unnest"), NATION)(seeded(_multiscale, "u long, v long", _between))

# ---- plans of several levels on the customer lattice: blocks of 8 x 8 customers, of 4 x 4, and customers


def _blocks(g):
    block = lambda k: F.concat_ws(",", F.floor(F.col("x") / k), F.floor(F.col("y") / k))
    return Graph(written(g.nodes.withColumn("block", block(8)).withColumn("part", block(4)), "blocks"), written(g.edges, "edges"), g.spec)


def _levels(g):
    """The lattice for tasks, and the unit of every node on both levels."""
    from parcela.plans import multiscale
    from parcela.plans.forest import LocalGraph

    nodes = g.nodes.toPandas().sort_values("id", ignore_index=True)  # one graph, held whole by every chain as well
    return LocalGraph.from_tables(nodes, g.edges.toPandas(), g.spec), [multiscale.codes(nodes.block), multiscale.codes(nodes.part)]


#: Customers up to which every task holds the lattice for plans of several levels.
LOCAL_NODES = 20_000


def _built(spark, sf_dir, rules=lambda units, ideal: ()):
    from parcela.plans import multiscale

    g = _blocks(S.customer_lattice(spark, sf_dir))
    n, total = g.nodes.agg(F.count("*"), F.sum("pop").cast("double")).first()
    b = C.Population.around(total, 4, 0.25)
    seeds = spark.range(6).withColumnRenamed("id", "seed").repartition(6)
    if n <= LOCAL_NODES:
        local, units = _levels(g)
        rows = multiscale.random_plans(seeds, local, units, 4, b.low, b.high, rules(units, total / 4))
    else:
        rows = multiscale.random_plans_by_units(seeds, g, ["block", "part"], 4, b.low, b.high, lambda units: rules(units, total / 4))
    return g, written(rows.withColumnRenamed("seed", "plan_id"), "multiscale"), b, total / 4, R.component_labels if n <= LOCAL_NODES else R.component_labels_by_rounds


@register("m7_multiscale_plans", SOUND.format(d=4, seeds=6, more=", true AS whole_blocks, true AS whole_parts, true AS drawn"), CUSTOMER)
def m7(spark, sf_dir):
    """Sound plans of four districts in which three units of a level are cut at most, with a probability of their cuts."""
    g, rows, b, _, labels = _built(spark, sf_dir)
    cut = lambda unit, name: (
        rows.join(g.nodes.select(F.col("id").alias("node"), unit), "node").groupBy("plan_id", unit).agg(F.count_distinct("district").alias("k"))
        .groupBy("plan_id").agg((F.sum((F.col("k") > 1).cast("int")) <= 3).alias(name))
    )
    drawn = rows.groupBy("plan_id").agg((F.min("log_probability") == F.max("log_probability")).alias("same"), F.max("log_probability").alias("p"))
    out = _sound(g, rows.select("plan_id", "node", "district"), b.low, b.high, labels=labels).join(cut("block", "whole_blocks"), "plan_id").join(cut("part", "whole_parts"), "plan_id")
    return out.join(drawn, "plan_id").select(F.col("plan_id").alias("seed"), "districts", "pop", "balanced", "parts", "nodes", "whole_blocks", "whole_parts", (F.col("same") & (F.col("p") <= 0)).alias("drawn"))


@register("m3_constrained_plans", SOUND.format(d=4, seeds=6, more=", true AS excess, true AS traversals"), CUSTOMER)
def m3_constrained(spark, sf_dir):
    """Plans built under constraints: blocks meet few districts, and what a district uses of a block is connected; held against the constraints on finished plans."""
    from parcela.plans import multiscale

    g, rows, b, ideal, labels = _built(spark, sf_dir, lambda units, ideal: (multiscale.allowed_excess(units[0], ideal, 0), multiscale.contiguous_traversals(units[0])))
    plans = rows.select("plan_id", "node", "district")
    excess = C.AllowedExcess("block", ideal, 0).check(g.nodes, plans).withColumnRenamed("ok", "excess")
    whole = C.ContiguousTraversals("block").check(g.nodes, plans, g.edges).withColumnRenamed("ok", "traversals")
    return _sound(g, plans, b.low, b.high, labels=labels).join(excess, "plan_id").join(whole, "plan_id").withColumnRenamed("plan_id", "seed")


# ---- cuts of trees: two combs on the customer lattice

CCOMBS = COMBS + """,
side AS (SELECT tree_id, u AS node, v AS nbr, v AS member, u AS prev FROM arcs UNION ALL SELECT side.tree_id, node, nbr, arcs.v, side.member FROM side JOIN arcs ON arcs.tree_id = side.tree_id AND arcs.u = side.member AND arcs.v <> side.prev),
hung AS (SELECT tree_id, node, nbr, sum(pop)::DOUBLE AS pop FROM side JOIN nodes ON id = member GROUP BY 1, 2, 3),
bound AS (SELECT t::DOUBLE AS t, ceil(0.75 * (t / 5)) AS lo, floor(1.25 * (t / 5)) AS hi FROM (SELECT sum(pop) AS t FROM nodes)),
cuttable AS (SELECT tree_id, node AS u, nbr AS v, pop, t - pop AS other FROM hung, bound WHERE node < nbr AND ((pop BETWEEN lo AND hi AND t - pop BETWEEN 4 * lo AND 4 * hi) OR (pop BETWEEN 4 * lo AND 4 * hi AND t - pop BETWEEN lo AND hi))),
nb AS (SELECT tree_id, node, pop, row_number() OVER (PARTITION BY tree_id, node ORDER BY nbr) AS k, count(*) OVER (PARTITION BY tree_id, node) AS n, max(pop) OVER (PARTITION BY tree_id, node) AS most FROM hung),
sub AS (SELECT DISTINCT tree_id, node, 0::BIGINT AS k, 0.0::DOUBLE AS s FROM nb UNION ALL SELECT sub.tree_id, sub.node, nb.k, sub.s + CASE WHEN take THEN nb.pop ELSE 0 END FROM sub JOIN nb ON nb.tree_id = sub.tree_id AND nb.node = sub.node AND nb.k = sub.k + 1, (VALUES (false), (true)) c(take))"""


def combs_of_customers(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from parcela.operators import cuts
        from parcela.plans.multiscale import Balance

        g = S.customer_lattice(spark, sf_dir)
        b = C.Population.around(float(g.nodes.agg(F.sum("pop")).first()[0] or 0), 5, 0.25)
        return f(cuts, written(cuts.hanging(S.comb_trees(g), g.nodes), "hanging"), Balance(b.low, b.high, (1, 4)))

    return run


register("m6_hanging_population", "SELECT tree_id, node, nbr, own.pop::DOUBLE AS own, hung.pop, t AS total FROM hung JOIN nodes own ON own.id = node, bound", CUSTOMER, CCOMBS, recursive=True)(combs_of_customers(lambda K, h, b: h))
register("m6_cuttable_edges", "SELECT tree_id, u, v, pop FROM cuttable", CUSTOMER, CCOMBS, recursive=True)(combs_of_customers(lambda K, h, b: K.cuttable_edges(h, b)))
register(
    "m6_cuttable_nodes",
    """SELECT tree_id, node, own, side, t - own - side AS rest FROM (
  SELECT DISTINCT sub.tree_id, sub.node, own.pop::DOUBLE AS own, sub.s AS side, t, lo, hi FROM sub JOIN nb ON nb.tree_id = sub.tree_id AND nb.node = sub.node AND nb.k = sub.k AND nb.k = nb.n JOIN nodes own ON own.id = sub.node, bound WHERE most <= 4 * hi)
WHERE (lo <= side + own AND 4 * lo <= t - side AND side < hi AND t - own - side < 4 * hi) OR (4 * lo <= side + own AND lo <= t - side AND side < 4 * hi AND t - own - side < hi)""",
    CUSTOMER, CCOMBS, recursive=True,
)(combs_of_customers(lambda K, h, b: K.cuttable_nodes(h, b)))
register("m8_cut_probabilities", "SELECT tree_id, u, v, pop, -ln(count(*) OVER (PARTITION BY tree_id)) AS log_probability FROM cuttable", CUSTOMER, CCOMBS, recursive=True)(
    combs_of_customers(lambda K, h, b: K.cut_probabilities(K.cuttable_edges(h, b)))
)
# two sides that don't overlap: neither holds the other's first node
register(
    "j14_edge_pairs",
    """SELECT a.tree_id, least(a.node, a.nbr) AS u1, greatest(a.node, a.nbr) AS v1, least(b.node, b.nbr) AS u2, greatest(b.node, b.nbr) AS v2, a.pop AS first, b.pop AS second, t - a.pop - b.pop AS third
FROM fit a JOIN fit b ON a.tree_id = b.tree_id AND (least(a.node, a.nbr) < least(b.node, b.nbr) OR (least(a.node, a.nbr) = least(b.node, b.nbr) AND greatest(a.node, a.nbr) < greatest(b.node, b.nbr))), third
WHERE t - a.pop - b.pop BETWEEN lo AND hi
  AND NOT EXISTS (SELECT 1 FROM side s WHERE s.tree_id = a.tree_id AND s.node = a.node AND s.nbr = a.nbr AND s.member = b.nbr)
  AND NOT EXISTS (SELECT 1 FROM side s WHERE s.tree_id = b.tree_id AND s.node = b.node AND s.nbr = b.nbr AND s.member = a.nbr)""",
    CUSTOMER, CCOMBS, "third AS (SELECT t, ceil(0.5 * (t / 3)) AS lo, floor(1.5 * (t / 3)) AS hi FROM bound), fit AS (SELECT tree_id, node, nbr, pop FROM hung, third WHERE pop BETWEEN lo AND hi)", recursive=True,
)(lambda spark, sf: _edge_pairs(spark, sf))


def _edge_pairs(spark, sf_dir):
    from parcela.operators import cuts

    g = S.customer_lattice(spark, sf_dir)
    b = C.Population.around(float(g.nodes.agg(F.sum("pop")).first()[0] or 0), 3, 0.5)
    return cuts.edge_pairs(written(cuts.sides(S.comb_trees(g), g.nodes), "sides"), b.low, b.high)


register(
    "c2_unfinished_plans",
    """SELECT p.plan_id, bool_and(target <= 0 OR coalesce(packed, 0) >= target OR (n < 5 AND coalesce(packed, 0) + floor((size - coalesce(claimed, 0)) / ideal) >= target)) AS ok
FROM (SELECT plan_id, count(DISTINCT district) AS n FROM building GROUP BY 1) p, (SELECT county, sum(pop) AS size, floor(sum(pop) / any_value(ideal)) - 1 AS target, any_value(ideal) AS ideal FROM nodes, (SELECT sum(pop) / 10.0 AS ideal FROM nodes) GROUP BY 1) s
LEFT JOIN (SELECT plan_id, county, count(*) AS packed FROM (SELECT plan_id, district, min(county) AS county FROM building JOIN nodes ON id = node GROUP BY 1, 2 HAVING count(DISTINCT county) = 1) GROUP BY 1, 2) w ON w.plan_id = p.plan_id AND w.county = s.county
LEFT JOIN (SELECT plan_id, county, sum(pop) AS claimed FROM building JOIN nodes ON id = node GROUP BY 1, 2) c ON c.plan_id = p.plan_id AND c.county = s.county GROUP BY 1""",
    NATION, "building AS (SELECT plan_id * 10 + k AS plan_id, node, district FROM plans, (SELECT unnest(range(1, 6)) AS k) WHERE district <= k)",
)(
    nation(
        lambda g, p: C.PackNodes("county", (g.nodes.agg(F.sum("pop")).first()[0] or 0) / 10.0, 1, districts=5).check(
            g.nodes, p.withColumn("k", F.explode(F.sequence(F.col("district"), F.lit(5)))).select((F.col("plan_id") * 10 + F.col("k")).alias("plan_id"), "node", "district")
        )
    )
)


@register("m10_m11_chain_invariants", "SELECT chain_id::BIGINT AS chain_id, step::BIGINT AS step, 5::BIGINT AS districts, (SELECT sum(pop) FROM nodes)::BIGINT AS pop, true AS balanced, 5::BIGINT AS parts, 25::BIGINT AS nodes, 20::BIGINT AS tree_edges, 20::BIGINT AS merges FROM (SELECT unnest(range(4)) AS chain_id), (SELECT unnest([1, 50, 100, 150, 200]) AS step)", NATION)
def m10(spark, sf_dir):
    """Every output of every chain: a sound plan, and a forest of 25 - 5 edges of the graph inside districts that spans them (each district's tree reaches all its nodes)."""
    from parcela.plans.chain import as_plans, run_chains

    g, graph = _local(spark, sf_dir)
    bounds = C.Population.around(float(graph.pop.sum()), 5, 0.2)
    config = run_config.RunConfig(two_tree_steps=20, output_freq=5, two_tree_frac=0.1, chains=4)
    out = written(run_chains(run_config.chains(spark, config), graph, 5, bounds.low, bounds.high, config.every), "chains")
    plans = as_plans(out, graph)
    trees = out.select(F.struct("chain_id", "step").alias("plan_id"), F.explode("tree").alias("e")).select("plan_id", F.col("e.u").alias("src"), F.col("e.v").alias("dst"))
    a, b = (plans.select("plan_id", F.col("node").alias(c), F.col("district").alias(f"d_{c}")) for c in ("src", "dst"))
    inside = trees.join(g.edges.select("src", "dst"), ["src", "dst"], "left_semi").join(a, ["plan_id", "src"]).join(b, ["plan_id", "dst"]).filter("d_src = d_dst")
    edges = inside.groupBy("plan_id").agg(F.count("*").alias("tree_edges"))
    # from the least node of a district, its tree reaches all others: as many as nodes less districts, over all trees
    ids = inside.select(F.concat_ws("/", "plan_id.chain_id", "plan_id.step", "d_src").alias("tree_id"), "plan_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    reached = R.tree_reach(ids.select("tree_id", "u", "v")).join(ids.select("tree_id", "plan_id").distinct(), "tree_id").groupBy("plan_id").agg(F.sum(F.col("reached") - 1).alias("merges"))
    out = _sound(g, plans, bounds.low, bounds.high).join(edges, "plan_id").join(reached, "plan_id")
    return out.select("plan_id.*", "districts", "pop", "balanced", "parts", "nodes", "tree_edges", "merges")


@register("c9_chain_plans", "SELECT chain_id::BIGINT AS chain_id, step::BIGINT AS step, true AS ok, CASE WHEN step = 1 THEN 0.0::DOUBLE END AS moved FROM (SELECT unnest(range(3)) AS chain_id), (SELECT unnest([1, 60, 120]) AS step)")
def c9_chain(spark, sf_dir):
    """Constraints over a chain's plans, whose ids are structs: each in bounds, in one part a district; each chain's first plan hasn't moved from itself."""
    from parcela.plans.chain import as_plans, run_chains

    g, graph = _local(spark, sf_dir)
    bounds = C.Population.around(float(graph.pop.sum()), 5, 0.2)
    config = run_config.RunConfig(two_tree_steps=60, output_freq=30, two_tree_frac=0.5, chains=3)
    mix = {"two_tree": config.two_tree_frac, "one_tree": 1 - config.two_tree_frac}
    plans = written(as_plans(run_chains(run_config.chains(spark, config), graph, 5, bounds.low, bounds.high, config.every, mix), graph), "plans")
    nodes = written(g.nodes.withColumn("all", F.lit("all")), "nodes")
    every, moved = C.Constraints(), None
    for c in (bounds, C.ContiguousTraversals("all"), C.MaxHamming(1.0)):
        every.add(c)
    for chain in range(config.chains):
        mine = plans.filter(F.col("plan_id.chain_id") == chain)
        first = mine.filter("plan_id.step = 1").select("node", "district")
        d = C.MaxHamming(1.0).distances(nodes, first, mine).withColumn("moved", F.when(F.col("plan_id.step") == 1, F.col("distance")))
        part = C.satisfied(every, nodes, mine, g.edges, first).join(d, "plan_id").select("plan_id.*", "ok", "moved")
        moved = part if moved is None else moved.unionByName(part)
    return moved


def _vra(g, p, spark, sf_dir):
    from parcela.functions import registry

    v = S.votes(spark, sf_dir)
    weights = v.select("election").distinct().withColumn("weight", F.when(F.col("election").startswith("1"), 2.0).otherwise(1.0))
    graph = Graph(g.nodes.withColumn("m", F.when(F.col("county") < 2, F.col("pop")).otherwise(0)), g.edges, g.spec)
    m = registry.Measure().push("two", registry.performance(v, weights, "F", 2), 0.5).push("share", registry.performance_to_target(v, weights, "F", "m", "pop", 5), 0.25)
    return m.push("margin", registry.partisan_margins(v.filter("stage = 1"), "1-URGENT", "F", "O"), 0.01).log_energy(graph, p)


register(
    "e12_vra_measure",
    """SELECT plan_id, 0.5 * two + 0.25 * share + 0.01 * margin AS log_energy FROM
  (SELECT plan_id, sum(CASE WHEN r <= 2 THEN margin * weight ELSE 0 END) AS two, sum(CASE WHEN r <= (SELECT floor(sum(CASE WHEN county < 2 THEN pop ELSE 0 END) / sum(pop) * 5) FROM nodes) THEN margin * weight ELSE 0 END) AS share FROM
    (SELECT plan_id, election, margin, row_number() OVER (PARTITION BY plan_id, election ORDER BY margin, district) AS r FROM (SELECT plan_id, election, district, sum(margin) AS margin FROM margins GROUP BY ALL)) JOIN weights USING (election) GROUP BY 1)
  JOIN (SELECT plan_id, sum(margin) AS margin FROM pm WHERE election = '1-URGENT' GROUP BY 1) USING (plan_id)""",
    NATION, VOTES, PART,
)(lambda spark, sf: (lambda g: _vra(g, S.nation_plans(g.nodes), spark, sf))(S.nation_lattice(spark, sf)))


@register("m2_plan_from_node_sets", "SELECT plan_id, node, district FROM plans", NATION)
def m2(spark, sf_dir):
    from parcela.plans.tables import plan_from_sets

    g = S.nation_lattice(spark, sf_dir)
    return plan_from_sets(N.district_sets(S.nation_plans(g.nodes), _pathed(g), 2), _pathed(g))


@register("e12_measure_registry", "SELECT plan_id, 0.3 * sum(score) + 0.001 * (SELECT sum(pop) FROM nodes) AS log_energy FROM iso GROUP BY 1", NATION, ISO)
def e12(spark, sf_dir):
    from parcela.functions import registry

    g = S.nation_lattice(spark, sf_dir)
    m = registry.Measure().push("iso", registry.isoperimetric(), 0.3).push("pop", registry.district_total("pop"), 0.001).push("off", registry.district_total("area"), 0)
    return m.log_energy(g, S.nation_plans(g.nodes))


_OUST = SQL["e16_ousted_population"]
register("e18_community_ousted_population", _OUST.replace("county", "community").replace("n_regionkey AS community", "n_regionkey AS county, (n_nationkey % 5 + n_nationkey // 5) % 3 AS community").replace("GROUP BY n_nationkey, n_regionkey)", "GROUP BY n_nationkey, n_regionkey)"))(
    nation(lambda g, p: O.ousted_population(g.nodes.withColumn("community", (F.col("x") + F.col("y")) % 3), p, "community", 150.0))
)
