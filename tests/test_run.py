"""From a graph file and parameters to an ensemble file; chains' own diagnostics; plans as arrays."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import arrays as A
from parcela.operators import constraints as C
from parcela.operators import diagnostics as G
from parcela.operators import observables as O
from parcela.plans import chain
from parcela.plans import run as runner
from parcela.sources import ensemble, json_graph, run_config
from parcela.spec import Graph, GraphSpec

from . import grid


def graph_file(tmp_path, **more):
    """The 4 x 4 grid, whose columns have names of their own."""
    nodes = [{"id": i, "name": f"n{i}", "county": str(i % 4 // 2 + 2 * (i // 8)), "TOTPOP": 1, "AREA": 1.0, "edge_of_state": float(grid.BORDER[i]), "VAP": 1, "BVAP": int(i < 4)} for i in range(16)]
    adjacency = [[] for _ in range(16)]
    for u, v in grid.EDGES:
        adjacency[u].append({"id": v, "shared": 1.0, "road": f"{u}-{v}"})
        adjacency[v].append({"id": u, "shared": 7.0, "road": "from above"})
    path = tmp_path / "grid.json"
    path.write_text(json.dumps({"directed": False, "multigraph": False, "graph": [], "nodes": nodes, "adjacency": adjacency} | more))
    return str(path)


SPEC = GraphSpec("TOTPOP", ("county", "name"), "AREA", "edge_of_state", "connections", "shared")


def config(tmp_path, name, **more):
    names = {"population": "TOTPOP", "area": "AREA", "node_border": "edge_of_state", "edge_perimeter": "shared", "levels": ["county", "name"]}
    base = {"graph": graph_file(tmp_path), "districts": 4, "tolerance": 0.0, "two_tree_steps": 20, "output_freq": 5, "two_tree_frac": 0.5, "chains": 2, "output": str(tmp_path / name)}
    return run_config.RunConfig(**(names | base | more))


def test_any_attribute_of_a_graph_file(spark, tmp_path):
    g = json_graph.load_graph(spark, graph_file(tmp_path), SPEC)
    assert {"TOTPOP", "VAP", "BVAP", "name", "edge_of_state"} <= set(g.nodes.columns) and g.nodes.agg(F.sum("BVAP")).first()[0] == 4
    # the lower end's listing holds
    assert {(r.src, r.dst): (r.shared, r.road, r.connections) for r in g.edges.collect()} == {(u, v): (1.0, f"{u}-{v}", 1.0) for u, v in grid.EDGES}
    with pytest.raises(ValueError, match="pop"):
        json_graph.load_graph(spark, graph_file(tmp_path))
    assert C.Population.around(16, 4, 0, population="TOTPOP").check(g.nodes, grid.frames(spark)[2]).filter("ok").count() == 117


def test_a_run_from_parameters_to_an_ensemble(spark, tmp_path):
    c = config(tmp_path, "whole")
    maps = runner.run(spark, c, chunk_outputs=2).collect()
    assert len(maps) == 2 * (1 + c.steps // c.every)
    header = ensemble.read_header(spark, c.output)
    assert header.extra["two_tree_frac"] == 0.5 and header.population_low == header.population_high == 4
    name = {f"n{i}": i for i in range(16)}
    log = runner.proposals(spark, c.output)
    by_chain = Counter(r.chain_id for r in log.collect())
    seen = Counter()
    for m in maps:
        plan = np.zeros(16, int)
        for k, d in m.districting.items():
            plan[name[k]] = d
        value = lambda k, m=m: json.loads(m.data[k]).get("value")
        assert sorted(Counter(plan.tolist()).values()) == [4, 4, 4, 4] and value("cut_edges") == grid.cut_edges(plan)
        lengths = value("(two_tree,cycle_length)")
        assert len(lengths) == len(value("(two_tree,pairs)")) == len(value("(two_tree,delta_pop)"))
        seen[value("chain_id")] += len(lengths)
    assert seen == by_chain and len(by_chain) == 2
    # broken off after its first chunk, a run goes on to the same result
    part = config(tmp_path, "whole2")
    short = run_config.RunConfig(**{k: getattr(part, k) for k in part.__dataclass_fields__} | {"two_tree_steps": 10})
    runner.run(spark, short, chunk_outputs=2)
    again = runner.run(spark, part, chunk_outputs=2).collect()
    as_set = lambda rows: Counter((m.name, m.data["chain_id"], tuple(sorted(m.districting.items()))) for m in rows)
    assert as_set(again) == as_set(maps)


def test_diagnostics_over_the_log_of_a_chain(spark, tmp_path):
    g = json_graph.load_graph(spark, graph_file(tmp_path), SPEC)
    local = runner.local_graph(g)
    chains = spark.createDataFrame([(i, 50 + i, 200) for i in range(2)], "chain_id long, seed long, steps long")
    out = chain.run_chains(chains, local, 4, 4, 4, 50, {"two_tree": 0.5, "one_tree": 0.5}).cache()
    log = chain.proposal_log(out).cache()
    want = {(r.chain_id, r.step // 50 - 1): (r.proposals, r.accepted) for r in out.collect() if r.proposals}
    got = {(r.chain_id, r.window): r for r in G.chain_diagnostics(log, 50).collect()}
    assert {k: (r.proposals, r.accepted) for k, r in got.items()} == want
    for r in log.collect():
        assert r.pairs >= 1 and 2 <= r.unique_edges <= max(2, r.cycle_length) and 0 <= r.avg_swappable <= r.max_swappable <= 0.5
        assert r.delta_pop <= 0.5 and (r.delta_nodes > 0) == (r.delta_pop > 0)  # the side keeps the label with which it shares more
    ratios = {r.window: r for r in G.acceptance_ratios(log.filter("chain_id = 0").withColumn("value", F.col("ratio")), 1000).collect()}
    assert abs(ratios[0].acceptance - np.mean([min(1, r.ratio) for r in log.filter("chain_id = 0").collect()])) < 1e-12
    assert G.gathered(log.filter("chain_id = 0").withColumn("value", F.col("cycle_length")), 1000).first()["values"] == [r.cycle_length for r in log.filter("chain_id = 0").orderBy("step").collect()]


def test_energies_of_the_users_own_steer_the_chain(spark, tmp_path):
    """Few cut edges, by an energy that a chain takes by name; and a share of a node column."""
    g = runner.local_graph(json_graph.load_graph(spark, graph_file(tmp_path), SPEC))
    chains = spark.createDataFrame([(i, 80 + i, 1500) for i in range(2)], "chain_id long, seed long, steps long")
    run = lambda w, e=None: chain.run_chains(chains, g, 4, 4, 4, 25, {"two_tree": 0.5, "one_tree": 0.5}, {"log_forests": 1.0} | w, e).filter("step > 300").select("districts").collect()
    mean = lambda rows: np.mean([grid.cut_edges(r.districts) for r in rows])
    assert mean(run({"cut_weight": 2.0})) < mean(run({})) - 1
    assert mean(run({"mine": 2.0}, {"mine": chain.isoperimetric_power(0.5)})) < mean(run({})) - 0.5
    whole = lambda rows: np.mean([any((np.array(r.districts) == d)[:4].sum() == 4 for d in range(1, 5)) for r in rows])
    assert whole(run({"gap": 20.0}, {"gap": chain.share_gap("BVAP", "VAP", 1.0)})) >= whole(run({}))
    with pytest.raises(ValueError, match="no energy"):
        chain.Measure({"unknown": 1.0})


def test_plans_as_arrays_agree_with_rows(spark):
    nodes, edges, plans = grid.frames(spark)
    nodes = nodes.withColumn("w", F.col("id") * F.col("id"))
    edges = edges.withColumn("connections", (F.col("src") % 3).cast("double"))
    g = A.GraphArrays.of(Graph(nodes, edges))
    p = A.as_arrays(plans, g)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(A.as_rows(p, g)) == rows(plans.select("plan_id", "node", "district"))
    for column in ("connections", "length", None):
        assert rows(A.cut_edges(p, g, column)) == rows(O.cut_edges(edges, plans, column))
    assert rows(A.cross_edges(p, g)) == rows(O.cross_edges(edges, plans).select("plan_id", "d1", "d2", "src", "dst"))
    assert rows(A.district_sums(p, g, "w")) == rows(O.district_sums(nodes, plans, "w")) and rows(A.node_counts(p, g)) == rows(O.node_counts(plans))
    assert rows(A.isoperimetric(p, g)) == rows(O.isoperimetric(nodes, edges, plans))
    assert rows(A.log_linking_edges(p, g)) == rows(O.log_linking_edges(edges, plans))
    assert A.cut_edges(p.limit(0), g).count() == 0
    plan = A.cut_edges(p, g)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_arrays_of_plans_that_hold_a_part_of_the_nodes(spark):
    """As the joins: absent nodes are in no district; districts of any number; a null array is no plan."""
    nodes, edges, plans = grid.frames(spark)
    nodes = nodes.withColumn("w", (F.col("id") + 1) * 10)
    plans = plans.filter("plan_id < 40 AND (node + plan_id) % 5 <> 0 AND NOT (plan_id = 7 AND node > 3)").withColumn("district", F.col("district") - 2)
    plans = plans.withColumn("plan_id", F.concat(F.lit("step"), "plan_id"))
    g = A.GraphArrays.of(Graph(nodes, edges))
    p = A.as_arrays(plans, g)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(A.as_rows(p, g)) == rows(plans.select("plan_id", "node", "district"))
    assert rows(A.cut_edges(p, g)) == rows(O.cut_edges(edges, plans)) and rows(A.cut_edges(p, g, None)) == rows(O.cut_edges(edges, plans, None))
    assert rows(A.cross_edges(p, g)) == rows(O.cross_edges(edges, plans).select("plan_id", "d1", "d2", "src", "dst"))
    assert rows(A.district_sums(p, g, "w")) == rows(O.district_sums(nodes, plans, "w")) and rows(A.node_counts(p, g)) == rows(O.node_counts(plans))
    assert rows(A.isoperimetric(p, g)) == rows(O.isoperimetric(nodes, edges, plans)) and rows(A.log_linking_edges(p, g)) == rows(O.log_linking_edges(edges, plans))
    none = spark.createDataFrame([("a", None), ("b", [1] * 16)], "plan_id string, districts array<int>")
    assert rows(A.node_counts(none, g)) == [("b", 1, 16)]
    with pytest.raises(Exception, match="3 places"):
        A.cut_edges(spark.createDataFrame([("a", [1, 2, 3])], "plan_id string, districts array<int>"), g).collect()
    with pytest.raises(Exception, match="graph lacks"):
        A.as_arrays(spark.createDataFrame([("a", 99, 1)], "plan_id string, node long, district int"), g).collect()


def test_a_run_refuses_the_state_of_another(spark, tmp_path):
    c = config(tmp_path, "mine", two_tree_steps=10)
    before = runner.run(spark, c, chunk_outputs=1).collect()
    of = lambda **more: run_config.RunConfig(**{k: getattr(c, k) for k in c.__dataclass_fields__} | more)
    for other in ({"gamma": 1.0}, {"iso_weight": 5.0}, {"thread_id": 3}, {"tolerance": 0.25}, {"chains": 3}, {"output_freq": 2}, {"two_tree_steps": 5}):
        with pytest.raises(ValueError, match="another run.*" + next(iter(other))):
            runner.run(spark, of(**other), chunk_outputs=1)
    with pytest.raises(ValueError, match="chunk was"):
        runner.run(spark, c, chunk_outputs=2)
    with pytest.raises(ValueError, match="energies"):
        runner.run(spark, c, chunk_outputs=1, weights={"cut_weight": 1.0})
    assert ensemble.read_header(spark, c.output).extra["gamma"] == 0.0  # a refused run leaves the header
    as_set = lambda rows: Counter((m.name, m.data["chain_id"], tuple(sorted(m.districting.items()))) for m in rows)
    assert as_set(runner.run(spark, c, chunk_outputs=1).collect()) == as_set(before)
    more = runner.run(spark, of(two_tree_steps=15), chunk_outputs=1).collect()
    assert len(more) == len(before) + 2 and as_set(before) <= as_set(more)


def test_constraints_over_the_plans_of_a_chain(spark, tmp_path):
    """Plan ids that are structs, or names, give what numbers give."""
    g = json_graph.load_graph(spark, graph_file(tmp_path), SPEC)
    local = runner.local_graph(g)
    out = chain.run_chains(spark.createDataFrame([(i, 60 + i, 60) for i in range(2)], "chain_id long, seed long, steps long"), local, 4, 4, 4, 20).cache()
    plans = chain.as_plans(out, local)
    first = plans.filter("plan_id.chain_id = 0 AND plan_id.step = 1").select("node", "district")
    every = C.Constraints()
    for k in (C.Population.around(16, 4, 0, population="TOTPOP"), C.MaxCoarseSplits("county", 12), C.ContiguousTraversals("county"), C.MaxHamming(0.4, population="TOTPOP")):
        every.add(k)
    number = plans.select((F.col("plan_id.chain_id") * 1000 + F.col("plan_id.step")).alias("plan_id"), "node", "district")
    name = number.withColumn("plan_id", F.concat(F.lit("step"), "plan_id"))
    want = {r.plan_id: r.ok for r in C.satisfied(every, g.nodes, number, g.edges, first).collect()}
    assert {r.plan_id.chain_id * 1000 + r.plan_id.step: r.ok for r in C.satisfied(every, g.nodes, plans, g.edges, first).collect()} == want
    assert {int(r.plan_id[4:]): r.ok for r in C.satisfied(every, g.nodes, name, g.edges, first).collect()} == want
    assert want[1] and len(want) == 2 * 4
    moved = C.MaxHamming(0.4, population="TOTPOP").distances(g.nodes, first, plans)
    assert {(r.plan_id.chain_id, r.plan_id.step): r.distance for r in moved.collect()}[0, 1] == 0.0


def test_a_one_tree_move_ends_where_every_district_is_a_node(spark, tmp_path):
    g = runner.local_graph(json_graph.load_graph(spark, graph_file(tmp_path), SPEC))
    alone = np.arange(1, 17)
    out = list(chain.run_chain(g, alone, 1, 1, 20, 10, 5, {"two_tree": 0.0, "one_tree": 1.0}, {}))
    assert [x[0] for x in out] == [1, 10, 20] and (out[-1][1].assign == alone).all()


def test_few_plans_over_a_graph_above_their_bound_go_by_rows(spark, monkeypatch):
    """No task holds the graph then, and the sums are the same."""
    from parcela import queries

    run = lambda: {tuple(r) for r in queries.QUERIES["a6_district_population"](spark, "/root/testdata/sf0.001").select("plan_id", "district", "pop").collect()}
    want = run()
    monkeypatch.setattr(queries, "FEW_PLANS_EDGES", 100)
    monkeypatch.setattr(A, "district_sums", lambda *a: pytest.fail("the graph went to tasks"))
    assert run() == want and len(want) == 44
