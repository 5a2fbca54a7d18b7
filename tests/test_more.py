import numpy as np
from pyspark.sql import functions as F

from parcela.functions import expressions as E
from parcela.functions.registry import Measure, district_total, isoperimetric, log_forests
from parcela.operators import hierarchy as H
from parcela.operators import trees as R
from parcela.plans.forest import balanced_edges, hierarchical_tree, random_plan, three_way_cuts, wilson_tree
from parcela.spec import Graph

from . import grid
from .test_grid import local


def test_hierarchical_trees_keep_units_together():
    g, rng = local(), np.random.default_rng(0)
    county = np.array([x // 2 + 2 * (y // 2) for x, y in grid.XY])
    half = county % 2
    for _ in range(50):
        tree = hierarchical_tree(g, list(range(16)), rng, [half, county])
        assert len(tree) == 15
        assert sum(county[g.u[e]] != county[g.v[e]] for e in tree) == 3 and sum(half[g.u[e]] != half[g.v[e]] for e in tree) == 1
    plan = random_plan(g, 4, 4, 4, rng, sample=lambda g, nodes, rng: hierarchical_tree(g, nodes, rng, [county]))
    assert sorted(np.bincount(plan)[1:]) == [4, 4, 4, 4]


def brute_parts(g, tree, cut):
    up = list(range(16))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in tree - set(cut):
        up[find(int(g.u[e]))] = find(int(g.v[e]))
    return sorted(np.unique([find(x) for x in range(16)], return_counts=True)[1].tolist())


def test_cuts_against_brute_force():
    g, rng = local(), np.random.default_rng(3)
    for _ in range(10):
        tree = wilson_tree(g, list(range(16)), rng)
        two = {e for e, _ in balanced_edges(g, tree, 4, 4, 4)}
        assert two == {e for e in tree if all(x % 4 == 0 for x in brute_parts(g, tree, [e]))}
        edges = sorted(tree)
        three = {frozenset(x) for x in three_way_cuts(g, tree, 4, 7)}
        assert three == {frozenset((a, b)) for i, a in enumerate(edges) for b in edges[:i] if all(4 <= x <= 7 for x in brute_parts(g, tree, [a, b]))}


def test_measure_is_the_weighted_sum(spark):
    nodes, edges, plans = grid.frames(spark)
    m = Measure().push("trees", log_forests, 0.5).push("iso", isoperimetric(), 0.02).push("none", district_total("pop"), 0.0)
    assert set(m.energies) == {"trees", "iso"}
    few = plans.filter("plan_id < 9")
    got = {r.plan_id: r.log_energy for r in m.log_energy(Graph(nodes, edges), few).collect()}
    from parcela.plans.chain import isoperimetric as one

    for i, p in enumerate(grid.all_plans()[:9]):
        want = 0.5 * grid.log_forests(p) + 0.02 * sum(one(local(), np.array(p), d) for d in (1, 2, 3, 4))
        assert abs(got[i] - want) < 1e-9


def test_expressions(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], "x/y.Json"), (2, ["z"], "none")], "k int, a array<string>, p string")
    r = df.select(E.set_all("a", 0).alias("z"), E.random_pair(F.col("a"), 3, "k").alias("pair"), E.suffix(F.col("p")).alias("s")).collect()
    assert list(r[0].z) == [0, 0, 0] and r[0].pair.first != r[0].pair.second and r[1].pair is None and [x.s for x in r] == [".JSON", ""]
    t = spark.range(100).withColumn("g", F.col("id") % 4)
    a, b = (sorted(x.id for x in E.random_element(d, ["g"], "id", 5, 2).collect()) for d in (t, t.repartition(7)))
    assert a == b and len(a) == 8


def test_subgraph_and_fine_neighbours(spark):
    nodes, edges, plans = grid.frames(spark)
    nodes = H.with_path(nodes, ["county", "name"])
    n, e = H.subgraph(nodes, edges, nodes.filter("county = '0'").select("id"))
    assert n.count() == 4 and e.count() == 4
    fine = H.all_fine_neighbors(edges, nodes, 2)
    assert fine.count() == 2 * 8 and {r.level for r in fine.collect()} == {1}


def test_big_tree_operators_agree_with_plain_code(spark):
    rng = np.random.default_rng(1)
    rows = [(t, int(rng.integers(v)), v) for t in range(5) for v in range(1, 60)]
    trees = spark.createDataFrame(rows, "tree_id int, u long, v long")
    d = {r.tree_id: r.diameter for r in R.diameters(trees).collect()}
    c = {(r.tree_id, r.node) for r in R.centres_and_leaves(trees).filter("is_centre").collect()}
    for t in range(5):
        near = R._adjacency(*zip(*[(u, v) for x, u, v in rows if x == t], strict=True))
        ecc = {x: max(R.hops(near, x).values()) for x in near}
        assert d[t] == max(ecc.values()) and {(t, x) for x, e in ecc.items() if e == min(ecc.values())} == {x for x in c if x[0] == t}


def test_connected_districts_have_a_tree_count_however_small_the_weights():
    path = np.arange(39), np.arange(1, 40)
    assert abs(R.log_tree_count(*path, np.full(39, 0.2), np.arange(40)) - 39 * np.log(0.2)) < 1e-9
    xy = np.arange(100).reshape(10, 10)
    u, v = np.concatenate([xy[:, :-1].ravel(), xy[:-1].ravel()]), np.concatenate([xy[:, 1:].ravel(), xy[1:].ravel()])
    unit = R.log_tree_count(u, v, np.ones(len(u)), np.arange(100))
    assert abs(R.log_tree_count(u, v, np.full(len(u), 0.2), np.arange(100)) - unit - 99 * np.log(0.2)) < 1e-8
    # in parts, also where an edge of weight 0 or heavy edges would join them by rounding
    assert R.log_tree_count(np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([1e9, 0.0, 1e9]), np.arange(4)) == -np.inf
    cut = np.flatnonzero(~((u % 10 == 4) & (v == u + 1)))
    assert R.log_tree_count(u[cut], v[cut], np.full(len(cut), 3.7), np.arange(100)) == -np.inf


def test_log_spanning_trees_of_light_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.2) for i in range(39)], "src long, dst long, connections double")
    plans = spark.createDataFrame([(0, i, 1) for i in range(40)], "plan_id int, node long, district int")
    assert abs(R.log_spanning_trees(edges, plans).first().log_trees - 39 * np.log(0.2)) < 1e-9
