"""Markov chains over balanced spanning forests, one chain a group.

A state is a tree for each district. A two-tree move joins the trees of two
adjacent districts by two crossing edges into a cycle and cuts the cycle at two
other edges; a one-tree move exchanges an edge inside a tree. Two-tree moves are
accepted by Metropolis-Hastings under the energies of a measure.

Chains are independent: ``run_chains`` runs each as one group of a grouped map,
reproducible for its seed whatever the partitioning, and its last row is a
checkpoint from which ``resume`` goes on.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.operators.trees import log_tree_count

from .forest import LocalGraph, RootedForest, pick, random_plan, wilson_tree

Energy = Callable[[LocalGraph, np.ndarray, int], float]


def log_trees(g: LocalGraph, assign: np.ndarray, d: int) -> float:
    nodes = np.flatnonzero(assign == d)
    e = np.flatnonzero((assign[g.u] == d) & (assign[g.v] == d))
    return log_tree_count(g.u[e], g.v[e], g.w[e], nodes)


def isoperimetric(g: LocalGraph, assign: np.ndarray, d: int) -> float:
    mine = assign == d
    cut = mine[g.u] != mine[g.v]
    perimeter = g.border[mine].sum() + g.length[cut].sum()
    return float(perimeter**2 / g.area[mine].sum())


def isoperimetric_power(exponent: float) -> Energy:
    return lambda g, assign, d: isoperimetric(g, assign, d) ** exponent


def cut_weight(g: LocalGraph, assign: np.ndarray, d: int) -> float:
    """Half the weight of a district's cut edges, so that the districts' sum counts each once."""
    mine = assign == d
    return float(g.w[mine[g.u] != mine[g.v]].sum() / 2)


def share_gap(part: str, whole: str, target: float) -> Energy:
    """How far a district's share of one node column in another lies under the target."""

    def energy(g: LocalGraph, assign: np.ndarray, d: int) -> float:
        mine = assign == d
        total = g.columns[whole][mine].sum()
        return max(0.0, target - float(g.columns[part][mine].sum() / total)) if total else target

    return energy


ENERGIES: dict[str, Energy] = {"log_forests": log_trees, "isoperimetric": isoperimetric, "cut_weight": cut_weight}


@dataclass
class Measure:
    """Weighted energies that are sums over districts; weight 0 is left out. Values are kept until a district changes."""

    weights: dict[str, float] = field(default_factory=dict)
    energies: dict[str, Energy] = field(default_factory=dict)  # of the user, beside ENERGIES
    kept: dict[tuple[str, int], float] = field(default_factory=dict)

    def __post_init__(self):
        self.weights = {k: w for k, w in self.weights.items() if w}
        self.energies = ENERGIES | self.energies
        if unknown := sorted(set(self.weights) - set(self.energies)):
            raise ValueError(f"no energy is called {', '.join(unknown)}")

    def of(self, g: LocalGraph, assign: np.ndarray, districts: tuple[int, ...]) -> dict[tuple[str, int], float]:
        return {(k, d): self.energies[k](g, assign, d) for k in self.weights for d in districts}

    def total(self, values: dict[tuple[str, int], float]) -> float:
        return sum(self.weights[k] * v for (k, _), v in values.items())


@dataclass
class State:
    """A plan with its forest, and the edges between each pair of districts, kept in order as nodes move."""

    assign: np.ndarray
    tree: set[int]
    forest: RootedForest
    cross: dict[tuple[int, int], list[int]]
    sizes: dict[int, int]
    version: int = 0

    @classmethod
    def from_tree(cls, g: LocalGraph, assign: np.ndarray, tree: set[int]) -> State:
        cross = {k: e.tolist() for k, e in crossing(g, assign).items()}
        sizes = {int(d): int(n) for d, n in zip(*np.unique(assign, return_counts=True), strict=True)}
        return cls(assign.copy(), set(tree), RootedForest(g, tree), cross, sizes)

    @classmethod
    def from_plan(cls, g: LocalGraph, assign: np.ndarray, rng: np.random.Generator) -> State:
        tree: set[int] = set()
        for d in np.unique(assign):
            tree |= wilson_tree(g, np.flatnonzero(assign == d).tolist(), rng)
        return cls.from_tree(g, assign, tree)


def crossing(g: LocalGraph, assign: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Edges between each adjacent pair of districts, from all edges: what a state begins with."""
    a, b = assign[g.u], assign[g.v]
    e = np.flatnonzero(a != b)
    low, high = np.minimum(a[e], b[e]), np.maximum(a[e], b[e])
    key = low * (int(assign.max()) + 1) + high
    order = np.argsort(key, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(e) else []
    return {(int(low[p[0]]), int(high[p[0]])): e[p] for p in parts}


def moved_edges(g: LocalGraph, assign: np.ndarray, to: dict[int, int]) -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """Of each pair of districts: edges it gains and loses if nodes go ``to`` other districts. Looks at edges of these nodes only."""
    out: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for x, new in to.items():
        old = int(assign[x])
        for y, e in g.near[x]:
            was = int(assign[y])
            now = to.get(y, was)
            if y in to and y < x:  # looked at from y
                continue
            before, after = (min(old, was), max(old, was)), (min(new, now), max(new, now))
            if before != after:
                if before[0] != before[1]:
                    out.setdefault(before, ([], []))[1].append(e)
                if after[0] != after[1]:
                    out.setdefault(after, ([], []))[0].append(e)
    return out


def arcs_within(weights: np.ndarray, low: float, high: float, current: int) -> np.ndarray:
    """Arcs (a, b), from 1, b short of the end, with both sides in bounds, but for the standing cut (1, current); in order, a row each."""
    upto = np.concatenate([[0.0], np.cumsum(weights)])
    total, n = upto[-1], len(weights)
    least, most = max(low, total - high), min(high, total - low)
    start = np.arange(1, n + 1)
    first = np.maximum(start, np.searchsorted(upto, upto[:-1] + least - 1e-9))
    last = np.minimum(n - 1, np.searchsorted(upto, upto[:-1] + most + 1e-9, side="right") - 1)
    k = np.maximum(0, last - first + 1)
    a = np.repeat(start, k)
    b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)
    out = np.stack([a, b], axis=1)
    return out[(a != 1) | (b != current)]


@dataclass
class Proposal:
    kind: str
    step: int = 0
    ratio: float = 0.0
    cycle_length: int = 0
    pairs: int = 1
    unique_edges: int = 2
    max_swappable: float = 0.0
    avg_swappable: float = 0.0
    delta_pop: float = 0.0
    delta_nodes: float = 0.0
    accepted: bool = False
    update: Move | None = None


def swap_mass(weights: np.ndarray, n_u: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weight that changes side for each arc a..b."""
    upto, n = np.concatenate([[0.0], np.cumsum(weights)]), len(weights)
    inside = np.where(a <= n_u, upto[np.minimum(n_u, b)] - upto[a - 1], np.where(a > n_u + 1, upto[a - 1] - upto[n_u], 0.0))
    return inside + np.where(b < n, upto[n] - upto[np.maximum(n_u, b)], 0.0)


@dataclass
class Move:
    """What a proposal changes: nodes and their new districts, edges of pairs of districts, and of the forest."""

    pair: tuple[int, int]
    to: dict[int, int]
    cross: dict[tuple[int, int], tuple[list[int], list[int]]]
    add: set[int]
    drop: set[int]

    def assign(self, s: State) -> np.ndarray:
        out = s.assign.copy()
        out[list(self.to)] = list(self.to.values())
        return out


def two_tree(g: LocalGraph, s: State, low: float, high: float, rng: np.random.Generator) -> Proposal:
    p = Proposal("two_tree")
    if not s.cross:
        return p
    pairs = sorted(s.cross)
    d1, d2 = pairs[int(rng.integers(len(pairs)))]
    edges = s.cross[d1, d2]
    if len(edges) < 2:
        return p
    e1, e2 = (int(edges[i]) for i in rng.choice(len(edges), 2, replace=False))
    ends = [(int(g.u[e]), int(g.v[e])) for e in (e1, e2)]
    (u1, v1), (u2, v2) = [(a, b) if s.assign[a] == d1 else (b, a) for a, b in ends]
    (u_path, u_top), (v_path, v_top) = s.forest.path(u2, u1), s.forest.path(v1, v2)
    path, weights, n_u = u_path + v_path, np.array(s.forest.hanging(u_path, u_top) + s.forest.hanging(v_path, v_top)), len(u_path)
    n, total = len(path), float(weights.sum())
    p.cycle_length = n
    arcs = arcs_within(weights, low, high, n_u)
    p.pairs = len(arcs) + 1
    starts, stops = arcs[:, 0], arcs[:, 1]
    p.unique_edges = len(np.unique(np.concatenate([[1, n_u + 1], starts, stops % n + 1])))
    if not len(arcs):
        return p
    swaps = swap_mass(weights, n_u, starts, stops)
    swaps = np.minimum(swaps, total - swaps)
    p.max_swappable, p.avg_swappable = float(swaps.max() / total), float(swaps.sum() / ((len(arcs) + 1) * total))
    # cycle edge i lies before position i; edge 1 closes the cycle
    cycle = [e2, *(g.edge_of(x, y) for x, y in zip(path, path[1:], strict=False))]
    inverse = 1 / g.w[cycle]
    choice = inverse[starts - 1] * inverse[stops]
    k = pick(rng, choice)
    a, b = arcs[k].tolist()
    cuts = {cycle[a - 1], cycle[b]}
    # the side keeps the label with which it shares more people
    place = np.arange(1, n + 1)
    in_arc, first = (place >= a) & (place <= b), place <= n_u
    flip = 2 * weights[in_arc == first].sum() < total
    leaves = np.flatnonzero((in_arc == first) if flip else (in_arc != first)).tolist()
    mine, theirs = (s.forest.members(path, [i for i in leaves if (i < n_u) == side]) for side in (True, False))
    to = dict.fromkeys(mine, d2) | dict.fromkeys(theirs, d1)
    moved = moved_edges(g, s.assign, to)
    after = len(s.cross)
    for pair, (gained, lost) in moved.items():
        had = len(s.cross.get(pair, ()))
        after += (had + len(gained) - len(lost) > 0) - (had > 0)
    gained, lost = moved.get((d1, d2), ((), ()))
    size, new_size = len(edges), len(edges) + len(gained) - len(lost)
    mass, links_inv = float(choice.sum()), 1 / (g.w[e1] * g.w[e2])
    new_mass = mass + links_inv - choice[k]
    p.ratio = len(s.cross) / after * (size * (size - 1)) / (new_size * (new_size - 1)) * mass / new_mass
    p.delta_pop, p.delta_nodes = float(weights[leaves].sum() / total), len(to) / (s.sizes[d1] + s.sizes[d2])
    p.update = Move((d1, d2), to, moved, {e1, e2} - cuts, cuts - {e1, e2})
    return p


def apply(g: LocalGraph, s: State, move: Move) -> None:
    for e in move.drop:
        s.tree.remove(e)
        s.forest.cut(int(g.u[e]), int(g.v[e]))
    for e in move.add:
        s.tree.add(e)
        s.forest.link(int(g.u[e]), int(g.v[e]))
    for pair, (gained, lost) in move.cross.items():
        held = s.cross.setdefault(pair, [])
        for e in lost:
            del held[bisect_left(held, e)]
        for e in gained:
            insort(held, e)
        if not held:
            del s.cross[pair]
    for x, d in move.to.items():
        s.sizes[int(s.assign[x])] -= 1
        s.sizes[d] += 1
        s.assign[x] = d
    s.version += 1


def one_tree(g: LocalGraph, s: State, rng: np.random.Generator) -> None:
    """A uniform edge inside any tree, exchanged against one of the cycle it closes, itself included, with weight 1/w. Nothing where every district is one node."""
    while s.tree:
        e = int(rng.integers(len(g.u)))
        if s.assign[g.u[e]] == s.assign[g.v[e]]:
            break
    else:
        return
    if e in s.tree:
        return
    a, b = int(g.u[e]), int(g.v[e])
    path, _ = s.forest.path(a, b)
    cycle = [g.edge_of(x, y) for x, y in zip(path, path[1:], strict=False)] + [e]
    out = cycle[pick(rng, 1 / g.w[cycle])]
    if out == e:
        return
    s.tree.remove(out)
    s.tree.add(e)
    x, y = int(g.u[out]), int(g.v[out])
    child = x if s.forest.up[x] == y else y
    s.forest.cut(x, y)
    s.forest.link(*((a, b) if s.forest.root(a) == child else (b, a)))  # what came loose hangs on the rest


def check_mix(mix: dict[str, float]) -> None:
    if abs(sum(mix.values()) - 1) > 1e-9 or min(mix.values()) < 0:
        raise ValueError("proposal weights must be 0 or more and sum to 1")


def run_chain(
    g: LocalGraph, assign: np.ndarray, low: float, high: float, steps: int, every: int, seed: int, mix: dict[str, float], weights: dict[str, float],
    first: int = 1, tree: set[int] | None = None, rng_state: dict | None = None, energies: dict[str, Energy] | None = None,
):
    """Yields (step, state, proposals since the last output, rng) before the first step and after every ``every`` steps."""
    check_mix(mix)
    rng = np.random.Generator(np.random.PCG64(seed))
    s = State.from_tree(g, assign, tree) if tree is not None else State.from_plan(g, assign, rng)
    if rng_state is not None:
        rng.bit_generator.state = rng_state
    measure = Measure(weights, energies or {})
    measure.kept = measure.of(g, s.assign, tuple(int(d) for d in np.unique(s.assign)))
    kinds, shares = list(mix), np.array(list(mix.values()))
    log: list[Proposal] = []
    if tree is None:
        yield first, s, log, rng
    for step in range(first, first + steps):
        if kinds[pick(rng, shares)] == "one_tree":
            one_tree(g, s, rng)
        else:
            p = two_tree(g, s, low, high, rng)
            p.step = step
            log.append(p)
            if p.update is not None:
                new = measure.of(g, p.update.assign(s), p.update.pair) if measure.weights else {}
                p.ratio *= math.exp(min(700.0, measure.total({k: measure.kept[k] for k in new}) - measure.total(new)))
                if rng.random() < p.ratio:
                    apply(g, s, p.update)
                    measure.kept |= new
                    p.accepted = True
                p.update = None
        if step % every == 0:
            yield step, s, log, rng
            log = []


#: What a chain keeps of each proposal of two trees.
LOG = "step long, proposal string, ratio double, cycle_length int, pairs int, unique_edges int, max_swappable double, avg_swappable double, delta_pop double, delta_nodes double, accepted boolean"
LOG_FIELDS = [x.split()[0] for x in LOG.split(", ")]
#: One row an output: the map, the forest, and the proposals since the last one.
OUTPUT = f"chain_id long, step long, version long, districts array<int>, tree array<struct<u:long,v:long>>, log array<struct<{LOG}>>, accepted int, proposals int, rng string"


def _row(g: LocalGraph, chain_id: int, step: int, s: State, log: list[Proposal], rng) -> tuple:
    import json

    tree = [{"u": int(g.ids[g.u[e]]), "v": int(g.ids[g.v[e]])} for e in sorted(s.tree)]
    proposals = [{"proposal": p.kind} | {f: getattr(p, f) for f in LOG_FIELDS if f != "proposal"} for p in log]
    return (chain_id, step, s.version, s.assign.tolist(), tree, proposals, sum(p.accepted for p in log), len(log), json.dumps(rng.bit_generator.state))


def _rows(rows: list[tuple], version: int = 0) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["chain_id", "step", "version", "districts", "tree", "log", "accepted", "proposals", "rng"])
    out["version"] += version
    return out


def run_chains(
    chains: DataFrame, g: LocalGraph, districts: int, low: float, high: float, every: int, mix: dict[str, float] | None = None, weights: dict[str, float] | None = None,
    energies: dict[str, Energy] | None = None,
) -> DataFrame:
    """OUTPUT rows of chains(chain_id, seed, steps). The graph is one object, shared by broadcast; its size doesn't grow with the chains.

    ``energies``: functions (graph, district of each node, district) of the
    user's own, by the names that ``weights`` gives them. The outputs of a group
    are held until its steps are done: ``plans.run`` goes on in chunks.
    """
    mix, weights = mix or {"two_tree": 0.1, "one_tree": 0.9}, weights or {}
    shared = chains.sparkSession.sparkContext.broadcast(g)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, graph = pdf.iloc[0], shared.value
        rng = np.random.Generator(np.random.PCG64([int(c.seed), 1]))
        start = random_plan(graph, districts, low, high, rng)
        return _rows([_row(graph, int(c.chain_id), *x) for x in run_chain(graph, start, low, high, int(c.steps), every, int(c.seed), mix, weights, energies=energies)])

    return chains.groupBy("chain_id").applyInPandas(run, OUTPUT)


def resume(
    last: DataFrame, g: LocalGraph, steps: int, low: float, high: float, every: int, mix: dict[str, float] | None = None, weights: dict[str, float] | None = None,
    energies: dict[str, Energy] | None = None,
) -> DataFrame:
    """OUTPUT rows of further steps after the last row of each chain."""
    mix, weights = mix or {"two_tree": 0.1, "one_tree": 0.9}, weights or {}
    shared = last.sparkSession.sparkContext.broadcast(g)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        c, graph = pdf.sort_values("step").iloc[-1], shared.value
        at = {x: i for i, x in enumerate(graph.ids.tolist())}
        tree = {graph.edge_of(at[e["u"]], at[e["v"]]) for e in c.tree}
        it = run_chain(graph, np.array(c.districts), low, high, steps, every, 0, mix, weights, int(c.step) + 1, tree, json.loads(c.rng), energies)
        return _rows([_row(graph, int(c.chain_id), *x) for x in it], int(c.version))

    return last.groupBy("chain_id").applyInPandas(run, OUTPUT)


def proposal_log(output: DataFrame) -> DataFrame:
    """chain_id and LOG: a row for each proposal of two trees of OUTPUT rows, for the diagnostics."""
    return output.select("chain_id", F.explode("log").alias("p")).select("chain_id", "p.*")


def as_plans(output: DataFrame, g: LocalGraph) -> DataFrame:
    """plan_id (struct of chain and step), node, district: for the set-oriented observables."""
    ids = output.sparkSession.createDataFrame(pd.DataFrame({"pos": np.arange(len(g.ids)), "node": g.ids}), "pos int, node long")  # as long as the graph
    rows = output.select(F.struct("chain_id", "step").alias("plan_id"), F.posexplode("districts").alias("pos", "district"))
    return rows.join(F.broadcast(ids), "pos").select("plan_id", "node", "district")
