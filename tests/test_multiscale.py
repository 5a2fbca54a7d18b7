"""Plans of several levels, rules on plans that are being built, and cuts of trees, against enumerations."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import cuts
from parcela.operators import trees as R
from parcela.plans import multiscale as M
from parcela.plans.forest import LocalGraph, kruskal_tree
from parcela.sources import shared

from . import grid


def local(n, edges, pop=None, w=None):
    u, v = (np.array([e[k] for e in edges], int) for k in (0, 1))
    one = np.ones(len(edges))
    return LocalGraph(np.arange(n), np.ones(n) if pop is None else np.asarray(pop, float), u, v, one if w is None else np.asarray(w, float), one, np.ones(n), np.zeros(n))


#: Two rows of six: three counties of two columns, a subcounty a column.
SIX = [(x, y) for y in range(2) for x in range(6)]
SIX_EDGES = [(i, j) for i in range(12) for j in range(i + 1, 12) if abs(SIX[i][0] - SIX[j][0]) + abs(SIX[i][1] - SIX[j][1]) == 1]
COUNTY, SUB = np.array([x // 2 for x, _ in SIX]), np.array([x for x, _ in SIX])


def canonical(assign) -> tuple:
    names: dict = {}
    return tuple(names.setdefault(int(d), len(names)) for d in assign)


def connected(nodes, edges) -> bool:
    nodes = set(nodes)
    todo, seen = [min(nodes)], set()
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b in edges if x in (a, b) and {a, b} <= nodes]
    return seen == nodes


def partitions(n, k, low, high, edges):
    """All partitions of 0..n-1 into k connected sets of ``low`` to ``high`` nodes."""
    sets = [frozenset(c) for size in range(low, high + 1) for c in combinations(range(n), size) if connected(c, edges)]

    def go(left, chosen):
        if not left or len(chosen) == k:
            if not left and len(chosen) == k:
                yield chosen
            return
        for s in sets:
            if min(left) in s and s <= left:
                yield from go(left - s, [*chosen, s])

    for chosen in go(frozenset(range(n)), []):
        assign = np.zeros(n, int)
        for d, s in enumerate(chosen, 1):
            assign[list(s)] = d
        yield assign


def split(assign, unit) -> int:
    return sum(len(set(assign[unit == u])) > 1 for u in set(unit.tolist()))


def by_cuts(assign, units, edges) -> bool:
    """Whether the districts can be cut off one at a time, each from a connected rest, splitting one unit of a level at most."""
    left = np.flatnonzero(assign >= 0)
    if len(set(assign[left])) == 1:
        return True
    for d in set(assign[left].tolist()):
        mine, rest = assign == d, np.where(assign == d, -1, assign)
        if connected(np.flatnonzero(rest >= 0), edges) and all(split(mine[left], u[left]) <= 1 for u in units) and by_cuts(rest, units, edges):
            return True
    return False


def test_splitting_sums_are_those_of_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        hanging, own = rng.integers(1, 9, int(rng.integers(0, 7))).astype(float).tolist(), float(rng.integers(1, 12))
        b = M.Balance(float(rng.integers(3, 8)), float(rng.integers(8, 14)), (1, int(rng.integers(1, 4))))
        total, want = sum(hanging), set()
        for k in range(len(hanging) + 1):
            for c in combinations(hanging, k):
                s = sum(c)
                for i, j in (b.sides, b.sides[::-1]):
                    if i * b.low <= s + own and j * b.low <= total - s + own and s < i * b.high and total - s < j * b.high:
                        want.add(s)
        if any(h > max(b.sides) * b.high for h in hanging):
            want = set()
        assert M.splitting_sums(own, hanging, b) == sorted(want)


@pytest.mark.parametrize(("k", "low", "high"), [(2, 6, 6), (2, 5, 7), (3, 4, 4), (3, 3, 5)])
def test_plans_of_three_levels_reached_are_those_of_an_enumeration(k, low, high):
    """Each cut splits one unit of a level at most; every such plan is reached, and no other."""
    g = local(12, SIX_EDGES)
    want = {canonical(a) for a in partitions(12, k, low, high, SIX_EDGES) if by_cuts(a, [COUNTY, SUB], SIX_EDGES)}
    assert all(split(np.array(a), u) <= k - 1 for a in want for u in (COUNTY, SUB))
    got = set()
    for seed in range(3000):
        b = M.build(g, [COUNTY, SUB], k, low, high, np.random.default_rng(seed))
        got.add(canonical(b.assign))
        assert len(b.cuts) == k - 1 and b.log_probability <= 0 and all(1 <= level <= 3 for _, level in b.cuts)
    assert got == want and want


class Still:
    """Draws always the first."""

    def random(self):
        return 0.0


def test_trees_opened_on_the_cut_path_lose_no_cut():
    """The cuts found are all those of the tree in which every unit is opened that leave both sides in bounds."""
    rng = np.random.default_rng(5)
    everything = M.Balance(0.0, math.inf)
    first = lambda g, nodes, _: kruskal_tree(g, nodes, np.random.default_rng(len(nodes)))  # noqa: E731  the same tree for the same graph
    opened, cuttable = 0, 0
    for trial in range(150):
        w, h = int(rng.integers(4, 9)), int(rng.integers(3, 7))
        xy = [(x, y) for y in range(h) for x in range(w)]
        edges = [(i, j) for i in range(w * h) for j in (i + 1, i + w) if j < w * h and (j == i + w or xy[j][1] == xy[i][1])]
        g = local(w * h, edges, rng.integers(1, 5, w * h), rng.integers(1, 4, len(edges)))
        units = [np.array([x // 4 + 10 * (y // 4) for x, y in xy]), np.array([x // 2 + 10 * (y // 2) for x, y in xy])]
        k = int(rng.integers(1, 4))
        ideal = g.pop.sum() / (k + 1)
        b = M.Balance(0.8 * ideal, 1.2 * ideal, (1, k))
        nodes = np.arange(w * h)
        whole = M.cut_tree(g, nodes, units, everything, Still(), first)
        assert len(whole.cuts) == w * h - 1  # a spanning tree
        some = M.cut_tree(g, nodes, units, b, Still(), first)
        key = lambda c, g=g: (c.edge, c.level, frozenset(c.side.tolist()))
        total = g.pop.sum()
        assert {key(c) for c in some.cuts} == {key(c) for c in whole.cuts if b.fits(c.pop, total - c.pop)}, trial
        for c in some.cuts:
            assert c.pop == g.pop[c.side].sum() and len(set(c.side.tolist())) == len(c.side)
            assert connected(c.side, edges) and connected(set(nodes.tolist()) - set(c.side.tolist()), edges)
        opened += len(whole.opened) - len(some.opened)
        cuttable += len(some.cuts)
    assert opened > 500 and cuttable > 100


COUNTY4 = np.array([x // 2 + 2 * (y // 2) for x, y in grid.XY])


@pytest.mark.parametrize("rule", ["excess", "pack", "splits", "none"])
def test_each_of_the_117_plans_is_reached_or_refused(rule):
    """A rule tested after each cut refuses just the plans that it refuses when they are finished."""
    g = local(16, grid.EDGES)
    rules = {"excess": (M.allowed_excess(COUNTY4, 4, 1),), "pack": (M.pack_nodes(COUNTY4 // 2, 4, 1),), "splits": (M.max_coarse_splits(COUNTY4, 5),), "none": ()}[rule]
    want = {canonical(a) for a in grid.all_plans() if all(r(g, np.array(a), 4) for r in rules)}
    got = {canonical(M.build(g, [], 4, 4, 4, np.random.default_rng(seed), rules).assign) for seed in range(4000)}
    assert got == want and (len(want) == 117) == (rule == "none") and len(want) > 1


def test_rules_refuse_early():
    """A partial plan is refused only if no way of finishing it is allowed."""
    g = local(16, grid.EDGES)
    for rule in (M.allowed_excess(COUNTY4, 4, 0), M.allowed_excess(COUNTY4, 4, 1), M.pack_nodes(COUNTY4 // 2, 4), M.max_coarse_splits(COUNTY4, 3)):
        refused = 0
        for a in map(np.array, grid.all_plans()):
            for done in ([1], [1, 2], [2, 4], [1, 2, 3]):
                partial = np.where(np.isin(a, done), a, 0)
                if not rule(g, partial, 4):
                    refused += 1
                    assert not rule(g, a, 4)
        assert refused


def test_traversals_of_what_is_done():
    """A district that uses a unit in two pieces is refused, as soon as it is there."""
    g = local(5, [(i, i + 1) for i in range(4)])
    rule = M.contiguous_traversals(np.array([0, 1, 0, 1, 1]))
    assert rule(g, np.array([0, 0, 1, 2, 2]), 2) and rule(g, np.zeros(5, int), 2) and not rule(g, np.array([1, 1, 1, 0, 0]), 2) and rule(g, np.array([1, 1, 0, 0, 0]), 2)


def test_a_rule_that_nothing_meets_and_districts_that_stay():
    g = local(16, grid.EDGES)
    with pytest.raises(RuntimeError, match="no plan"):
        M.build(g, [], 4, 4, 4, np.random.default_rng(0), (lambda *_: False,), 5, 50)
    fixed = np.where(COUNTY4 == 2, 1, 0)
    b = M.build(g, [COUNTY4], 4, 4, 4, np.random.default_rng(1), fixed=fixed)
    assert (b.assign[COUNTY4 == 2] == 1).all() and (b.assign[COUNTY4 != 2] > 1).all() and sorted(np.bincount(b.assign)[1:]) == [4, 4, 4, 4]


def test_probability_of_the_cuts(spark):
    """Of a tree's cuts they sum to one; a plan's is the product over its trees."""
    nodes, edges, _ = grid.frames(spark)
    rows = [(t, a, b) for t in range(12) for a, b in (grid.EDGES[e] for e in kruskal_tree(local(16, grid.EDGES), list(range(16)), np.random.default_rng(t)))]
    trees = spark.createDataFrame([(f"t{t}", a, b) for t, a, b in rows], "tree_id string, u long, v long")
    hung = cuts.hanging(trees, nodes).cache()
    b = M.Balance(3, 5, (1, 3))
    p = cuts.cut_probabilities(cuts.cuttable_edges(hung, b)).groupBy("tree_id").agg(F.sum(F.exp("log_probability")).alias("p"), F.count("*").alias("n")).collect()
    assert p and all(abs(r.p - 1) < 1e-12 for r in p)
    # the same edges as a search of one tree finds
    g = local(16, grid.EDGES)
    for r in p:
        mine = [(a, c) for t, a, c in rows if f"t{t}" == r.tree_id]
        found = M.cut_tree(local(16, mine), np.arange(16), [], b, np.random.default_rng(0))
        assert len(found.cuts) == r.n and abs(found.log_probability() + math.log(r.n)) < 1e-12
    assert g.edge
    with pytest.raises(Exception, match="not a tree"):
        cuts.hanging(edges.select(F.lit(0).alias("tree_id"), F.col("src").alias("u"), F.col("dst").alias("v")), nodes).collect()


def test_plans_of_seeds_do_not_depend_on_partitions(spark):
    g = local(12, SIX_EDGES)
    rows = lambda n: sorted(map(tuple, M.random_plans(spark.range(6).withColumnRenamed("id", "seed").repartition(n), g, [COUNTY, SUB], 3, 4, 4).collect()))
    assert rows(1) == rows(5) and len(rows(1)) == 72


def test_components_by_rounds_with_plan_ids_of_any_type(spark):
    nodes, edges, plans = grid.frames(spark)
    odd = plans.filter("plan_id < 9").withColumn("district", F.col("district") % 2 + F.col("node") % 2)  # in many parts
    for kind in (F.col("plan_id"), F.struct("plan_id", F.lit("x").alias("s"))):
        p = odd.withColumn("plan_id", kind)
        key = lambda r: (str(r.plan_id), r.district, r.node, r.component)
        assert sorted(map(key, R.component_labels_by_rounds(edges, p).collect())) == sorted(map(key, R.component_labels(edges, p).collect()))


def test_pairs_of_edges_over_many_trees(spark):
    """As a search of each tree by itself finds, for bounds of any width."""
    from parcela.plans.forest import three_way_cuts

    nodes, _, _ = grid.frames(spark)
    g = local(16, grid.EDGES)
    trees = {f"t{t}": kruskal_tree(g, list(range(16)), np.random.default_rng(t)) for t in range(25)}
    df = spark.createDataFrame([(t, *grid.EDGES[e]) for t, tree in trees.items() for e in tree], "tree_id string, u long, v long")
    parts = cuts.sides(df, nodes).cache()
    for low, high in ((5, 6), (4, 8), (1, 14), (16 / 3, 16 / 3)):
        want = {(t, *sorted((grid.EDGES[a], grid.EDGES[b]))) for t, tree in trees.items() for a, b in three_way_cuts(g, tree, low, high)}
        rows = cuts.edge_pairs(parts, low, high).collect()
        got = {(r.tree_id, (r.u1, r.v1), (r.u2, r.v2)) for r in rows}
        assert got == want and len(rows) == len(got) and all(r.first + r.second + r.third == 16 for r in rows)
    assert want == set() and len(trees) == 25


def test_components_by_rounds_broadcast_no_plans(spark, monkeypatch):
    """Rows of plans are few bytes as files, whatever their number: no join of a round may hold a side in the driver."""
    steps = []

    def kept(df, label):
        steps.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.written(df, label)

    monkeypatch.setattr(R, "written", kept)
    monkeypatch.setattr(R, "CHUNK", 4)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "src long, dst long, connections double")
    plans = shared.written(spark.range(21).selectExpr("1 AS plan_id", "id AS node", "cast(id / 7 AS int) AS district"), "plans")
    got = R.component_labels_by_rounds(edges, plans)
    assert {(r.node, r.component) for r in got.collect()} == {(i, i // 7 * 7) for i in range(21)}
    steps.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(steps) > 4 and not [s for s in steps if "Broadcast" in s]


def test_components_by_rounds_over_stretches_of_ids(spark, monkeypatch):
    """Labelled a few ids at a time first; ids far apart go without."""
    monkeypatch.setattr(R, "CHUNK", 3)
    nodes, edges, plans = grid.frames(spark)
    odd = plans.filter("plan_id < 9").withColumn("district", F.col("district") % 2 + F.col("node") % 2)
    want = {tuple(r) for r in R.component_labels(edges, odd).select("plan_id", "district", "node", "component").collect()}
    for k in (1, 1000):
        far = R.component_labels_by_rounds(edges.withColumns({"src": F.col("src") * k, "dst": F.col("dst") * k}), odd.withColumn("node", F.col("node") * k))
        assert {(r.plan_id, r.district, r.node // k, r.component // k) for r in far.collect()} == want


@pytest.mark.parametrize(("k", "low", "high"), [(2, 5, 7), (3, 3, 5)])
def test_plans_from_insides_of_opened_units_are_those_of_an_enumeration(k, low, high):
    """As ``random_plans_by_units`` draws them: counties as single nodes, insides by asking."""
    import pandas as pd

    want = {canonical(a) for a in partitions(12, k, low, high, SIX_EDGES) if by_cuts(a, [COUNTY, SUB], SIX_EDGES)}
    first = {c: int(np.flatnonzero(COUNTY == c)[0]) for c in range(3)}
    part = np.array([first[c] for c in COUNTY])
    coarse = pd.DataFrame({"piece": [first[c] for c in range(3)], "pop": 4.0, "unit": range(3), "nodes": 4})
    e = pd.DataFrame([(a, b, 1.0, part[a], part[b]) for a, b in SIX_EDGES], columns=["src", "dst", "w", "p", "q"])
    far = e[e.p != e.q]
    links = far.assign(lo=far[["p", "q"]].min(axis=1), hi=far[["p", "q"]].max(axis=1)).groupby(["lo", "hi"], as_index=False).w.sum().rename(columns={"lo": "p", "hi": "q"})
    nodes = pd.DataFrame({"id": range(12), "pop": 1.0, "piece": part, "units": [[str(s)] for s in SUB]})
    inside = {x: (nodes[nodes.piece == x], e[(e.p == x) | (e.q == x)]) for x in first.values()}
    got = set()
    for seed in range(600):
        s, fetched = M._Building(np.random.default_rng(seed), [(np.zeros(3, np.int32), {}, 0.0, 0)], [0]), {}
        while (asked := M._go_on(s, coarse, links, fetched, k, low, high, lambda units: (), 100, 10_000)) is not None:
            fetched = {x: inside[x] for x in asked}
        whole, split, log_p, n = s.stack[-1]
        plan = [split.get(x, whole[COUNTY[x]]) for x in range(12)]
        assert min(plan) > 0 and n == k - 1 and log_p <= 0
        got.add(canonical(plan))
    assert got <= want and len(got) > len(want) // 2


@pytest.mark.parametrize("name", ["m7_multiscale_plans"])
def test_plans_of_a_lattice_that_no_task_holds(spark, monkeypatch, name):
    from parcela import queries

    monkeypatch.setattr(queries, "LOCAL_NODES", 0)
    monkeypatch.setattr(queries, "_levels", lambda g: pytest.fail("the lattice went through the driver"))
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert len({r.seed for r in rows}) == len(rows) == 6
    assert all(r.districts == r.parts == 4 and r.nodes == 1500 and r.pop == 15000 and r.balanced and r.whole_blocks and r.whole_parts and r.drawn for r in rows)


def test_hanging_of_trees_in_pieces(spark, monkeypatch):
    """As of whole trees, whatever the stretches of ids; no task gets a whole tree."""
    nodes, _, _ = grid.frames(spark)
    g = local(16, grid.EDGES)
    df = spark.createDataFrame([(t, *grid.EDGES[e]) for t in range(6) for e in kruskal_tree(g, list(range(16)), np.random.default_rng(t))], "tree_id int, u long, v long")
    rows = lambda: sorted(map(tuple, cuts.hanging(df, nodes.withColumn("pop", F.col("id") + 1)).collect()))
    want, walk, sizes = rows(), cuts._walks, []
    monkeypatch.setattr(cuts, "CHUNK", 5)
    monkeypatch.setattr(cuts, "_walks", lambda ends: sizes.append(ends.groupBy("tree_id").count().agg(F.max("count")).first()[0]) or walk(ends))
    assert rows() == want and len(want) == 6 * 30 and len(sizes) == 2 and max(sizes) < 15
