import json

import pytest
from pyspark.sql import functions as F

from parcela.operators import hierarchy as H
from parcela.sources import ensemble, json_graph, run_config
from parcela.spec import Graph, GraphSpec


def document(tmp_path, name="g.json"):
    nodes = [{"id": i, "county": "ab"[i // 2], "pct": str(i), "pop": i + 1, "area": 1.0, "border_length": 2.0} for i in range(4)]
    adjacency = [[{"id": 1, "length": 1.5}, {"id": 2, "length": 2.0, "connections": 3.0}], [{"id": 0, "length": 1.5}], [{"id": 0, "length": 2.0, "connections": 3.0}, {"id": 3, "length": 1.0, "connections": 0.0}], []]
    path = tmp_path / name
    path.write_text(json.dumps({"directed": False, "multigraph": False, "graph": [], "nodes": nodes, "adjacency": adjacency}, indent=1))
    return str(path)


def test_json_graph(spark, tmp_path):
    g = json_graph.load_graph(spark, document(tmp_path), GraphSpec(keep=frozenset({"county", "pop"})))
    assert g.nodes.columns == ["id", "county", "pop"] and g.nodes.agg(F.sum("pop")).first()[0] == 10
    # (2, 3) is listed from one side only; a missing weight is 1
    assert sorted(map(tuple, g.edges.select("src", "dst", "length", "connections").collect())) == [(0, 1, 1.5, 1.0), (0, 2, 2.0, 3.0), (2, 3, 1.0, 0.0)]
    with pytest.raises(ValueError):
        json_graph.load_graph(spark, document(tmp_path, "g.shp"))


def test_modify_edge_weights(spark, tmp_path):
    g = json_graph.load_graph(spark, document(tmp_path))
    h = json_graph.modify_edge_weights(g, lambda u, v, e: u("pop") * v("pop") + e("length"))
    assert {(r.src, r.dst): r.connections for r in h.edges.collect()} == {(0, 1): 3.5, (0, 2): 5.0, (2, 3): 13.0}
    assert h.edges.columns == g.edges.columns


def test_quotient_merges_maps_and_refuses_unequal_strings(spark):
    nodes = spark.createDataFrame([(0, "a", {"x": 1, "y": 2}), (1, "a", {"y": 5}), (2, "b", None)], "id long, county string, votes map<string,long>")
    merged = {r.path[0]: r.votes for r in H.quotient_nodes(H.with_path(nodes, ["county"]), 1).collect()}
    assert merged == {"a": {"x": 1, "y": 7}, "b": None}
    edges = spark.createDataFrame([(0, 2, 1.0, "road"), (1, 2, 1.0, "river")], "src long, dst long, w double, kind string")
    with pytest.raises(Exception, match="differs"):
        H.quotient_edges(edges, H.with_path(nodes, ["county"]), 1).collect()


def test_node_in_two_clusters_is_refused(spark):
    nodes = spark.createDataFrame([(0, "a")], "id long, county string")
    with pytest.raises(Exception, match="two clusters"):
        H.cluster_of(nodes, [[{"county": "a"}], [{"id": 0}]]).collect()


def test_ensemble_round_trip(spark, tmp_path):
    plans = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 1, 1)], "plan_id int, node long, district int")
    maps = ensemble.node_map(plans).withColumn("step", F.col("plan_id") * 10)
    score = plans.groupBy("plan_id").agg(F.sum(F.col("node") * F.col("district")).alias("s"))
    w = ensemble.Writer(spark, str(tmp_path / "a"), ensemble.Header(2, 1, 1, ["cut"], [1.0], extra={"gamma": 0.5})).push_report("score", score, "s")
    w.output(maps.filter("plan_id = 1"))
    w.output(maps.filter("plan_id = 2"))
    w.close()
    assert ensemble.read_header(spark, str(tmp_path / "a")).extra == {"gamma": 0.5}
    back = {r.name: (r.districting, json.loads(r.data["score"])["value"]) for r in ensemble.read_maps(spark, str(tmp_path / "a")).collect()}
    assert back == {"step10": ({"0": 1, "1": 2}, 2), "step20": ({"0": 2, "1": 1}, 1)}
    assert list((tmp_path / "a" / "maps").glob("*.json.gz"))


def test_run_config(tmp_path):
    toml = tmp_path / "p.toml"
    toml.write_text('[run]\ntwo_tree_steps = 1e4\noutput_freq = 100\ndistricts = 5\n[output]\noutput = "x"\nunknown = 1\n')
    c = run_config.load(["--config", str(toml), "--districts", "7", "--thread_id", "2"])
    assert (c.steps, c.every, c.districts, c.output, c.seed()) == (100_000, 1000, 7, "x", 454190 + 2 * 15123)


def test_chain_table(spark):
    rows = run_config.chains(spark, run_config.RunConfig(chains=2, two_tree_steps=20, output_freq=5)).collect()
    assert [(r.chain_id, r.seed, r.steps, r.every) for r in rows] == [(0, 454190, 200, 50), (1, 469313, 200, 50)]


def test_graph_keeps_its_spec():
    assert Graph(None, None).spec.edge_weight == "connections"
