"""What a chain keeps from step to step, against what is computed anew."""

import numpy as np
import pytest

from parcela.plans import chain
from parcela.plans.forest import LocalGraph, RootedForest, random_plan, subtree_pops, tree_path, wilson_tree


def lattice(w, h, seed=0):
    xy = [(x, y) for y in range(h) for x in range(w)]
    edges = [(i, j) for i in range(w * h) for j in (i + 1, i + w) if j < w * h and (j == i + w or xy[j][1] == xy[i][1])]
    rng, n = np.random.default_rng(seed), w * h
    u, v = (np.array([e[k] for e in edges]) for k in (0, 1))
    return LocalGraph(np.arange(n), rng.integers(1, 4, n).astype(float), u, v, rng.integers(1, 4, len(u)).astype(float), np.ones(len(u)), np.ones(n), np.zeros(n))


@pytest.mark.parametrize(("w", "h", "d"), [(4, 4, 3), (9, 7, 5)])
def test_cross_edges_sums_and_sizes_follow_the_moves(w, h, d):
    g = lattice(w, h)
    ideal = g.pop.sum() / d
    low, high = 0.6 * ideal, 1.4 * ideal
    plan = random_plan(g, d, low, high, np.random.default_rng(1))
    accepted = 0
    for _, s, log, _ in chain.run_chain(g, plan, low, high, 400, 1, 5, {"two_tree": 0.6, "one_tree": 0.4}, {"cut_weight": 0.2}):
        assert s.cross == {k: e.tolist() for k, e in chain.crossing(g, s.assign).items()}
        assert s.sizes == {int(k): int(n) for k, n in zip(*np.unique(s.assign, return_counts=True), strict=True)}
        links = [set() for _ in g.ids]
        for e in s.tree:
            links[g.u[e]].add(int(g.v[e]))
            links[g.v[e]].add(int(g.u[e]))
        assert s.forest.links == links and len(s.tree) == len(g.ids) - d
        roots = [x for x in range(len(g.ids)) if s.forest.up[x] < 0]
        assert len(roots) == d
        for root in roots:
            mine = {e for e in s.tree if s.assign[g.u[e]] == s.assign[root]}
            order, parent, pops = subtree_pops(g, mine, root)
            assert all(s.forest.up[x] == parent[x] and s.forest.below[x] == pops[x] for x in order)
        accepted += sum(p.accepted for p in log)
    assert accepted > 50


def test_paths_and_what_hangs_off_them():
    g = lattice(8, 6)
    rng = np.random.default_rng(2)
    tree = wilson_tree(g, list(range(48)), rng)
    f = RootedForest(g, tree)
    for _ in range(200):
        a, b = (int(x) for x in rng.integers(0, 48, 2))
        path, top = f.path(a, b)
        assert path == tree_path(g, f.links.__getitem__, a, b) and all(f.up[x] not in path or i != top for i, x in enumerate(path))
        weights = f.hanging(path, top)
        parts = [f.members(path, [i]) for i in range(len(path))]
        assert sorted(x for p in parts for x in p) == list(range(48))
        assert weights == [g.pop[p].sum() for p in parts]
    e = next(iter(tree))
    f.cut(int(g.u[e]), int(g.v[e]))
    with pytest.raises(ValueError, match="two trees"):
        f.path(int(g.u[e]), int(g.v[e]))
