"""Golden values on the 4 x 4 grid: every balanced plan is known."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import constraints as C
from parcela.operators import nodesets as N
from parcela.operators import observables as O
from parcela.operators import trees as R
from parcela.operators.hierarchy import with_path
from parcela.plans.chain import run_chain, run_chains
from parcela.plans.forest import LocalGraph, exchange_tree, kruskal_tree, random_plan, random_plan_by_cluster, random_plan_with_fixed, wilson_tree

from . import grid


def test_all_plans():
    plans = grid.all_plans()
    assert len(plans) == 117
    assert round(sum(math.exp(grid.log_forests(p)) for p in plans)) == 654
    forests = Counter()
    for p in plans:
        forests[grid.cut_edges(p)] += round(math.exp(grid.log_forests(p)))
    assert forests == {8: 256, 10: 224, 11: 96, 12: 78}


def test_cut_edges_and_forests_of_all_plans(spark):
    nodes, edges, plans = grid.frames(spark)
    cuts = {r.plan_id: r.cut_edges for r in O.cut_edges(edges, plans).collect()}
    assert cuts == {i: grid.cut_edges(p) for i, p in enumerate(grid.all_plans())}
    logs = {r.plan_id: r.log_forests for r in R.log_spanning_forests(R.log_spanning_trees(edges, plans)).collect()}
    assert all(abs(logs[i] - grid.log_forests(p)) < 1e-9 for i, p in enumerate(grid.all_plans()))
    iso = {r.plan_id: r.score for r in O.isoperimetric_score(O.isoperimetric(nodes, edges, plans)).collect()}
    quadrants = next(i for i, p in enumerate(grid.all_plans()) if grid.cut_edges(p) == 8)
    assert iso[quadrants] == 64


def test_every_plan_is_connected_and_balanced(spark):
    nodes, edges, plans = grid.frames(spark)
    assert R.connected(edges, plans).filter(~F.col("connected")).count() == 0
    assert C.Population(4, 4).check(nodes, plans).filter(~F.col("ok")).count() == 0
    assert C.Population(5, 9).check(nodes, plans).filter("ok").count() == 0
    assert C.Population.around(16, 4, 0.02) == C.Population(4, 4)


def test_constraints_on_quadrants(spark):
    nodes, edges, plans = grid.frames(spark)
    q = next(i for i, p in enumerate(grid.all_plans()) if grid.cut_edges(p) == 8)
    packed = C.PackNodes("county", 4.0).check(nodes, plans).filter("ok").collect()
    assert [r.plan_id for r in packed] == [q]
    assert {r.plan_id for r in C.MaxCoarseSplits("county", 0).check(nodes, plans).filter("ok").collect()} == {q}
    assert C.ContiguousTraversals("county").check(nodes, plans.filter(F.col("plan_id") == q), edges).first().ok
    far = C.MaxHamming(0.0).distances(nodes, plans.filter(F.col("plan_id") == q), plans)
    assert {r.plan_id for r in far.filter("distance = 0").collect()} == {q}
    both = C.Constraints().add(C.Population(4, 4)).add(C.MaxHamming(0.4))
    ok = C.satisfied(both, nodes, plans, initial=plans.filter(F.col("plan_id") == q)).filter("ok").count()
    assert ok == far.filter("distance <= 0.4").count()


def test_node_sets_round_trip(spark):
    nodes, _, plans = grid.frames(spark)
    nodes = with_path(nodes, ["county", "name"])
    few = plans.filter("plan_id < 20")
    sets = N.district_sets(few, nodes, 2)
    back = N.expand(sets, nodes).select("set_id.plan_id", F.col("id").alias("node"), "set_id.district")
    assert back.exceptAll(few).count() == 0 and few.exceptAll(back).count() == 0


def local(w=None) -> LocalGraph:
    u, v = map(np.array, zip(*grid.EDGES, strict=True))
    one = np.ones(16)
    return LocalGraph(np.arange(16), one, u, v, np.ones(24) if w is None else w, np.ones(24), one, np.array(grid.BORDER, float))


#: Edge weights of the weighted case by class.
OUTER = {(0, 1), (2, 3), (0, 4), (3, 7), (8, 12), (11, 15), (12, 13), (14, 15)}
MIDDLE = {(1, 2), (4, 8), (7, 11), (13, 14)}
INNER = {(5, 6), (6, 10), (9, 10), (5, 9)}
WEIGHTED = np.array([2.0 if e in OUTER else 2.5 if e in MIDDLE else 3.0 if e in INNER else 1.0 for e in grid.EDGES])


def expected(gamma: float, w=None, iso: float = 0.0) -> dict[int, float]:
    out = Counter()
    g = local(w)
    from parcela.plans.chain import isoperimetric

    for p in grid.all_plans():
        e = sum(isoperimetric(g, np.array(p), d) for d in (1, 2, 3, 4)) if iso else 0.0
        out[grid.cut_edges(p)] += math.exp((1 - gamma) * grid.log_forests(p, w) - iso * e)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


def test_golden_probabilities():
    unweighted = expected(0)
    assert abs(unweighted[8] - 0.391437) < 1e-5 and abs(unweighted[12] - 0.119266) < 1e-5
    weighted = expected(0, WEIGHTED)
    assert abs(weighted[8] - 0.020201) < 1e-5 and abs(weighted[11] - 0.564937) < 1e-5
    assert abs(expected(1)[12] - 0.666667) < 1e-5


@pytest.mark.parametrize("gamma,weighted,iso", [(0, False, 0), (1, False, 0), (0, True, 0), (1, True, 0), (0, False, 0.02)])
def test_chain_samples_the_target(gamma, weighted, iso):
    """Thinned samples of several seeds against the exact distribution."""
    w = WEIGHTED if weighted else None
    g, want, got = local(w), expected(gamma, w, iso), Counter()
    for seed in (1, 2, 3):
        start = random_plan(g, 4, 4, 4, np.random.default_rng(seed))
        for step, s, _, _ in run_chain(g, start, 4, 4, 50_000, 25, seed, {"two_tree": 0.5, "one_tree": 0.5}, {"log_forests": gamma, "isoperimetric": iso}):
            if step > 500:
                got[grid.cut_edges(s.assign)] += 1
    n = sum(got.values())
    assert set(got) == set(want)
    for k, p in want.items():
        # thinned draws still hang together: the effective sample is taken as a fifth
        assert abs(got[k] / n - p) < 4.5 * math.sqrt(p * (1 - p) / (n / 5)) + 1e-3, (k, got[k] / n, p)


def test_trees_are_spanning_and_uniform():
    g, rng = local(), np.random.default_rng(0)
    square = [0, 1, 4, 5]
    for sample in (wilson_tree, kruskal_tree, exchange_tree):
        assert len(sample(g, list(range(16)), rng)) == 15
    seen = Counter(frozenset(wilson_tree(g, square, rng)) for _ in range(2000))
    assert len(seen) == 4 and all(abs(n / 2000 - 0.25) < 0.05 for n in seen.values())
    with pytest.raises(ValueError):
        wilson_tree(g, [0, 15], rng)


def test_initial_plans():
    g, rng = local(), np.random.default_rng(1)
    p = random_plan(g, 4, 4, 4, rng)
    assert sorted(Counter(p.tolist()).values()) == [4, 4, 4, 4]
    fixed = np.where(np.arange(16) < 4, 1, 0)
    q = random_plan_with_fixed(g, fixed, 4, 4, 4, rng)
    assert (q[:4] == 1).all() and sorted(Counter(q.tolist()).values()) == [4, 4, 4, 4]
    c = random_plan_by_cluster(g, np.arange(16) // 8, {0: 2, 1: 2}, 4, 4, rng)
    assert set(c[:8]) == {1, 2} and set(c[8:]) == {3, 4}
    with pytest.raises(RuntimeError):
        random_plan(g, 4, 5, 5, rng, max_attempts=3)


def test_chains_are_reproducible_and_resume(spark):
    from parcela.plans.chain import as_plans, resume

    g = local()
    chains = spark.createDataFrame([(i, 100 + i, 60) for i in range(3)], "chain_id long, seed long, steps long")
    a = run_chains(chains, g, 4, 4, 4, 20).select("chain_id", "step", "districts").toPandas().sort_values(["chain_id", "step"])
    b = run_chains(chains.repartition(5), g, 4, 4, 4, 20).select("chain_id", "step", "districts").toPandas().sort_values(["chain_id", "step"])
    assert [list(x) for x in a.districts] == [list(x) for x in b.districts] and len(a) == 12
    whole = run_chains(chains, g, 4, 4, 4, 20)
    half = run_chains(chains.withColumn("steps", F.lit(40).cast("long")), g, 4, 4, 4, 20)
    last = half.filter("step = 40")
    rest = resume(last, g, 20, 4, 4, 20)
    want = {r.chain_id: list(r.districts) for r in whole.filter("step = 60").collect()}
    assert {r.chain_id: list(r.districts) for r in rest.collect()} == want
    nodes, edges, _ = grid.frames(spark)
    pops = O.district_sums(nodes, as_plans(whole, g), "pop")
    assert pops.filter("pop <> 4").count() == 0
