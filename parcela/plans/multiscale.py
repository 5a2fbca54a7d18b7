"""Plans over several levels: trees that start on the coarsest level and open only units that a cut may pass through.

A tree of the coarsest units is drawn first. An edge of it whose sides hold whole
numbers of districts may be cut. A unit may be opened if what hangs off it, with
some of its own people, can be dealt to both sides (``splitting_sums``): then each
tree edge at the unit is realised by a base edge, drawn by weight, which says on
which of the unit's parts it hangs; a tree of these parts is drawn, carrying what
hangs off each, and so on down. All edges that may be cut, of all opened trees,
are drawn from alike, and the probability of the one drawn is kept.

A district is then whole units but for those on its cut: each cut opens at most
one unit of a level. Everything here is one task's own work on one graph;
``random_plans`` deals seeds to tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.operators.trees import component_labels
from parcela.sources.shared import written
from parcela.spec import Graph, unordered

from .forest import LocalGraph, pick, wilson_tree

#: Rules on plans that are being built: (graph, district of each node or 0, districts in all) -> may stay.
Rule = Callable[[LocalGraph, np.ndarray, int], bool]


@dataclass(frozen=True)
class Balance:
    """Bounds of a district's population, and how many districts each side of a cut is to hold, in either order."""

    low: float
    high: float
    sides: tuple[int, int] = (1, 1)

    def fits(self, a: float, b: float) -> bool:
        return any(i * self.low <= a <= i * self.high and j * self.low <= b <= j * self.high for i, j in (self.sides, self.sides[::-1]))

    def splits(self, hung: float, rest: float, own: float) -> bool:
        """Whether ``own`` people can be dealt so that both sides fit, where one has ``hung`` and the other ``rest`` already."""
        for i, j in (self.sides, self.sides[::-1]):
            if i * self.low <= hung + own and j * self.low <= rest + own and hung < i * self.high and rest < j * self.high:
                return True
        return False


def splitting_sums(own: float, hanging: list[float], balance: Balance) -> list[float]:
    """Sums of subsets of ``hanging`` with which a node of ``own`` people may be opened, each once, in order.

    Sums are built up one by one and equal ones kept once, so that their number
    doesn't follow that of the subsets. None if a part is too large for any side.
    """
    most = max(balance.sides) * balance.high
    if any(h > most for h in hanging):
        return []
    sums = {0.0}
    for h in hanging:
        sums |= {s + h for s in sums if s + h < most}
    total = sum(hanging)
    return sorted(s for s in sums if balance.splits(s, total - s, own))


@dataclass
class Cut:
    """An edge that may be cut: its ends as base nodes, the level whose tree has it, and the nodes of one side, found when asked for."""

    edge: int
    level: int
    nodes: Callable[[], np.ndarray]
    pop: float

    @property
    def side(self) -> np.ndarray:
        return self.nodes()


@dataclass
class CutTree:
    """All trees of one draw: the edges that may be cut, the units that were opened (level, least base node), and closed nodes that should have been."""

    cuts: list[Cut] = field(default_factory=list)
    opened: list[tuple[int, int]] = field(default_factory=list)
    wanted: list[int] = field(default_factory=list)

    def log_probability(self) -> float:
        """Of the edge that is drawn: all are alike."""
        return -math.log(len(self.cuts))


def _parts(g: LocalGraph, nodes: np.ndarray, unit: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Part of each node (-1 outside): connected pieces of equal units, every node by itself without units; and their number."""
    part, n = np.full(len(g.ids), -1), 0
    inside = np.zeros(len(g.ids), bool)
    inside[nodes] = True
    for x in nodes.tolist():
        if part[x] >= 0:
            continue
        part[x], found = n, [x]
        for y in found if unit is not None else ():
            for z, _ in g.near[y]:
                if inside[z] and part[z] < 0 and unit[z] == unit[x]:
                    part[z] = n
                    found.append(z)
        n += 1
    return part, n


def cut_tree(
    g: LocalGraph, nodes: np.ndarray, units: list[np.ndarray], balance: Balance, rng: np.random.Generator, sample=wilson_tree, closed: np.ndarray | None = None
) -> CutTree:
    """Trees over ``nodes``; ``units``: the unit of every node of the graph on each level above the nodes, coarsest first.

    Nodes of ``closed`` stand for a part of a coarsest unit whose inside isn't at
    hand; those that the tree would open are given back as wanted.
    """
    out = CutTree()
    _draw(g, np.asarray(nodes), 0, units, balance, rng, sample, [], out, closed)
    return out


def _draw(g, nodes, level, units, balance, rng, sample, hooks: list[tuple[int, float, Callable[[], np.ndarray]]], out: CutTree, closed=None) -> None:
    """The tree of a unit's parts. hooks: what hangs on it from outside, as (base node it hangs on, population, its nodes when asked for)."""
    part, n = _parts(g, nodes, units[level] if level < len(units) else None)
    by_part = nodes[np.argsort(part[nodes], kind="stable")]
    members = np.split(by_part, np.searchsorted(part[by_part], np.arange(1, n)))
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (part, base edge)
    if n > 1:
        e = np.flatnonzero((part[g.u] >= 0) & (part[g.v] >= 0) & (part[g.u] != part[g.v]))
        a, b = np.minimum(part[g.u[e]], part[g.v[e]]), np.maximum(part[g.u[e]], part[g.v[e]])
        keys, at = np.unique(a * n + b, return_inverse=True)
        weight, zero = np.bincount(at, g.w[e]), np.zeros(n)
        quotient = LocalGraph(np.arange(n), zero, keys // n, keys % n, weight, np.ones(len(keys)), zero, zero)
        by_key, first = e[np.argsort(at, kind="stable")], np.searchsorted(np.sort(at), np.arange(len(keys) + 1))
        for k in sorted(sample(quotient, list(range(n)), rng)):
            base = by_key[first[k] : first[k + 1]]
            edge = int(base[pick(rng, g.w[base])])
            i, j = int(part[g.u[edge]]), int(part[g.v[edge]])
            near[i].append((j, edge))
            near[j].append((i, edge))
    held: list[list[tuple[int, float, Callable[[], np.ndarray]]]] = [[] for _ in range(n)]
    for x, pop, outside in hooks:
        held[part[x]].append((x, pop, outside))
    order, parent, todo = [], {0: (-1, -1)}, [0]  # a part comes before its subtree, which is a stretch of the order
    while todo:
        order.append(i := todo.pop())
        for j, edge in near[i]:
            if j != parent[i][0]:
                parent[j] = (i, edge)
                todo.append(j)
    own = [float(g.pop[m].sum()) for m in members]
    below, size = [own[i] + sum(p for _, p, _ in held[i]) for i in range(n)], [1] * n
    for i in reversed(order[1:]):
        below[parent[i][0]] += below[i]
        size[parent[i][0]] += size[i]
    place, total = {i: k for k, i in enumerate(order)}, below[0]

    def nodes_of(i: int, inside: bool = True) -> np.ndarray:
        """Of the subtree of a part, or of all others; with what hangs there from outside."""
        k = place[i]
        parts = order[k : k + size[i]] if inside else order[:k] + order[k + size[i] :]
        return np.concatenate([x for j in parts for x in (members[j], *(o() for _, _, o in held[j]))])

    for i in order[1:]:
        if balance.fits(below[i], total - below[i]):
            out.cuts.append(Cut(parent[i][1], level + 1, partial(nodes_of, i), below[i]))
    if level == len(units):
        return
    for i in order:
        hanging = [p for _, p, _ in held[i]] + [below[j] if parent[j][0] == i else total - below[i] for j, _ in near[i]]
        shut = closed is not None and len(members[i]) == 1 and bool(closed[members[i][0]])
        if (len(members[i]) < 2 and not shut) or not splitting_sums(own[i], hanging, balance):
            continue
        if shut:
            out.wanted.append(int(members[i][0]))
            continue
        inner = list(held[i])
        for j, edge in near[i]:
            x = int(g.u[edge]) if part[g.u[edge]] == i else int(g.v[edge])
            child = parent[j][0] == i
            inner.append((x, below[j], partial(nodes_of, j)) if child else (x, total - below[i], partial(nodes_of, i, False)))
        out.opened.append((level + 1, int(members[i].min())))
        _draw(g, members[i], level + 1, units, balance, rng, sample, inner, out, closed)


@dataclass
class Built:
    """A plan, the logarithm of the probability of its cuts given their trees, and the cuts as (base edge, level)."""

    assign: np.ndarray
    log_probability: float
    cuts: list[tuple[int, int]]


def _cut_off(g, tree: CutTree, assign, free, district, left, low, high, rng) -> tuple[np.ndarray, Cut]:
    """The plan with one more district, or with the last two."""
    cut = tree.cuts[int(rng.integers(len(tree.cuts)))]
    mine = cut.side
    rest = np.setdiff1d(free, mine)
    total = float(g.pop[free].sum())
    one = low <= cut.pop <= high and left * low <= total - cut.pop <= left * high
    other = low <= total - cut.pop <= high and left * low <= cut.pop <= left * high
    if other and (not one or total - cut.pop < cut.pop):  # where both may be the district, the smaller one
        mine, rest = rest, mine
    new = assign.copy()
    new[mine] = district
    if left == 1:
        new[rest] = district + 1
    return new, cut


def build(
    g: LocalGraph, units: list[np.ndarray], districts: int, low: float, high: float, rng: np.random.Generator, rules: tuple[Rule, ...] = (), max_attempts: int = 100,
    max_steps: int = 10_000, sample=wilson_tree, fixed: np.ndarray | None = None,
) -> Built:
    """Cuts districts off one at a time, on all levels, testing ``rules`` after each.

    A district that finds no cut which the rules allow in ``max_attempts`` trees
    takes the one before it back, which counts for a quarter of the attempts of
    that one. Districts of ``fixed`` (0: free) stay. Raises
    RuntimeError after ``max_steps`` trees.
    """
    start = np.zeros(len(g.ids), int) if fixed is None else np.asarray(fixed, int)
    held = len(np.unique(start[start > 0]))
    stack, attempts, steps = [(start, 0.0, [])], [0], 0
    allowed = lambda assign: all(rule(g, assign, districts) for rule in rules)
    if districts - held == 1:
        last = np.where(start == 0, districts, start)
        if low <= g.pop[start == 0].sum() <= high and allowed(last):
            return Built(last, 0.0, [])
    while steps < max_steps and districts - held > 1:
        assign, log_p, cuts = stack[-1]
        district = held + len(stack)
        if attempts[-1] >= max_attempts and len(stack) > 1:  # one back
            stack.pop()
            attempts.pop()
            attempts[-1] += max_attempts // 4
            continue
        attempts[-1] += 1
        steps += 1
        free, left = np.flatnonzero(assign == 0), districts - district
        try:
            tree = cut_tree(g, free, units, Balance(low, high, (1, left)), rng, sample)
        except ValueError:  # not connected
            continue
        if not tree.cuts:
            continue
        new, cut = _cut_off(g, tree, assign, free, district, left, low, high, rng)
        if not allowed(new):
            continue
        found = (new, log_p + tree.log_probability(), [*cuts, (cut.edge, cut.level)])
        if left == 1:
            return Built(*found)
        stack.append(found)
        attempts.append(0)
    raise RuntimeError(f"no plan in {steps} trees")


# ---------------------------------------------------------------- rules on plans that are being built


def pack_nodes(unit: np.ndarray, ideal: float, unpack: int = 0) -> Rule:
    """Each unit of n ideal districts holds floor(n) - unpack whole ones; while building, the unclaimed rest of a unit counts for floor(rest / ideal)."""

    def rule(g: LocalGraph, assign: np.ndarray, districts: int) -> bool:
        done = np.unique(assign[assign > 0])
        whole = {int(d): set(unit[assign == d].tolist()) for d in done}
        for u in np.unique(unit).tolist():
            target = math.floor(g.pop[unit == u].sum() / ideal) - unpack
            if target <= 0:
                continue
            packed = sum(w == {u} for w in whole.values())
            if packed < target and len(done) < districts:
                packed += math.floor(g.pop[(unit == u) & (assign == 0)].sum() / ideal)
            if packed < target:
                return False
        return True

    return rule


def allowed_excess(unit: np.ndarray, ideal: float, excess: int = 0) -> Rule:
    """A unit under one ideal district meets excess + 2 districts at most, a larger one ceil(n) + excess; its unclaimed rest counts for ceil(rest / ideal)."""

    def rule(g: LocalGraph, assign: np.ndarray, districts: int) -> bool:
        n, free = int(unit.max(initial=-1)) + 1, assign == 0
        pop = np.bincount(unit, g.pop, n)
        met = np.bincount(np.unique(np.stack([unit, assign])[:, ~free], axis=1)[0], minlength=n) + np.ceil(np.bincount(unit[free], g.pop[free], n) / ideal)
        return bool((met <= np.where(pop < ideal, excess + 2, np.ceil(pop / ideal) + excess)).all())

    return rule


def max_coarse_splits(unit: np.ndarray, most: int) -> Rule:
    """Units counted once for each district they reach into, less their number; while building, units that no district has reached are no gain."""

    def rule(g: LocalGraph, assign: np.ndarray, districts: int) -> bool:
        met = len(np.unique(np.stack([unit, assign])[:, assign > 0], axis=1).T)
        open_units = np.setdiff1d(unit, unit[assign > 0])  # each will be reached at least once
        return met + len(open_units) - len(np.unique(unit)) <= most

    return rule


def contiguous_traversals(unit: np.ndarray) -> Rule:
    """What a finished district uses of a unit is connected."""

    def rule(g: LocalGraph, assign: np.ndarray, districts: int) -> bool:
        key = np.where(assign > 0, assign * (int(unit.max()) + 1) + unit, -1)
        nodes = np.flatnonzero(assign > 0)
        return _parts(g, nodes, key)[1] == len(np.unique(key[nodes]))

    return rule


def codes(column) -> np.ndarray:
    """Units as numbers from 0."""
    return pd.factorize(np.asarray(column))[0]


# ---------------------------------------------------------------- many plans at once

SCHEMA = "seed long, node long, district int, log_probability double"


def random_plans(seeds: DataFrame, g: LocalGraph, units: list[np.ndarray], districts: int, low: float, high: float, rules: tuple[Rule, ...] = (), max_attempts: int = 100) -> DataFrame:
    """SCHEMA: the plan of each row of seeds(seed), a task's work each; the same for a seed whatever the partitioning. The graph is one object, shared by broadcast."""
    shared = seeds.sparkSession.sparkContext.broadcast((g, units))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, levels = shared.value
        for pdf in batches:
            for seed in pdf.seed.tolist():
                b = build(graph, levels, districts, low, high, np.random.Generator(np.random.PCG64(seed)), rules, max_attempts)
                yield pd.DataFrame({"seed": seed, "node": graph.ids, "district": b.assign, "log_probability": b.log_probability})

    return seeds.select("seed").mapInPandas(one, SCHEMA)


# ---------------------------------------------------------------- plans over a graph that no task holds


def _insides(boxes: pa.ListArray) -> dict[int, tuple[pd.DataFrame, pd.DataFrame]]:
    """Nodes (id, pop, piece, units of the finer levels) and edges (src, dst, w, p, q: parts of the ends) of each part, from one row of boxes."""
    if boxes.null_count:
        return {}
    piece, *inner = boxes.flatten().flatten()
    tables = [pa.Table.from_batches([pa.RecordBatch.from_struct_array(x.flatten())]).to_pandas() for x in inner]
    ends = [np.cumsum(pc.list_value_length(x).to_numpy()) for x in inner]
    return {p: tuple(t.iloc[(e[i - 1] if i else 0) : e[i]] for t, e in zip(tables, ends, strict=True)) for i, p in enumerate(piece.to_pylist())}


@dataclass
class _Building:
    """A plan being built over parts of coarsest units: a stack of (district of each part, or -1 where one is split; districts of the nodes of split parts; log p; cuts)."""

    rng: np.random.Generator
    stack: list[tuple[np.ndarray, dict[int, int], float, int]]
    attempts: list[int]
    steps: int = 0
    inside: dict[int, tuple] = field(default_factory=dict)  # of split parts


def _mixed(coarse: pd.DataFrame, links: pd.DataFrame, inside: dict[int, tuple]) -> tuple[LocalGraph, list[np.ndarray], np.ndarray, np.ndarray]:
    """Parts as single nodes, but for those of ``inside``, whose base nodes stand in their place; the units of each level, the part of each node, and which are closed."""
    pieces = coarse.piece.to_numpy()
    whole = ~np.isin(pieces, list(inside))
    depth = 1 + len(next(iter(inside.values()))[0]["units"].iloc[0]) if inside else 1
    base = pd.concat([n for n, _ in inside.values()], ignore_index=True) if inside else pd.DataFrame({"id": np.zeros(0, np.int64), "pop": np.zeros(0), "piece": np.zeros(0, np.int64), "units": []})
    piece = np.concatenate([pieces[whole], base.piece.to_numpy()])
    ids = np.concatenate([pieces[whole], base.id.to_numpy()])
    pop = np.concatenate([coarse["pop"].to_numpy()[whole], base["pop"].to_numpy()])
    closed = np.concatenate([coarse.nodes.to_numpy()[whole] > 1, np.zeros(len(base), bool)])
    order = np.lexsort([ids, piece])
    ids, piece, pop, closed = ids[order], piece[order], pop[order], closed[order]
    units = [coarse.unit.to_numpy()[np.searchsorted(pieces, piece)]]
    for level in range(depth - 1):
        names = np.concatenate([[f"part {x}" for x in pieces[whole]], [f"unit {u[level]}" for u in base.units]])[order]
        units.append(codes(names))
    u, v, w = links.p.to_numpy(), links.q.to_numpy(), links.w.to_numpy()
    far = whole[np.searchsorted(pieces, u)] & whole[np.searchsorted(pieces, v)]
    at = {x: i for i, x in enumerate(zip(piece.tolist(), ids.tolist(), strict=True))}
    a, b = ([at[x, x] for x in c[far].tolist()] for c in (u, v))
    weight = w[far].tolist()
    if inside:
        e = pd.concat([e for _, e in inside.values()], ignore_index=True).drop_duplicates(["src", "dst"])  # an edge between two parts lies in both
        for p, q, x, y, z in e[["p", "q", "src", "dst", "w"]].sort_values(["src", "dst"]).itertuples(index=False):
            a.append(at[p, x if p in inside else p])
            b.append(at[q, y if q in inside else q])
            weight.append(z)
    a, b, zero = np.array(a, int), np.array(b, int), np.zeros(len(ids))
    g = LocalGraph(ids, pop, np.minimum(a, b), np.maximum(a, b), np.array(weight, float), np.ones(len(a)), zero, zero)
    return g, units, piece, closed


def _go_on(s: _Building, coarse, links, fetched: dict[int, tuple], districts, low, high, rules, max_attempts, max_steps) -> list[int] | None:
    """Draws trees as ``build`` does until one would open parts whose inside isn't at hand, which are returned; None at the end."""
    pieces = coarse.piece.to_numpy()
    while len(s.stack) < districts:
        if s.attempts[-1] >= max_attempts and len(s.stack) > 1:  # one back
            s.stack.pop()
            s.attempts.pop()
            s.attempts[-1] += max_attempts // 4
            continue
        if s.steps >= max_steps:
            raise RuntimeError(f"no plan in {s.steps} trees")
        whole, split, log_p, cuts = s.stack[-1]
        before, inside = s.rng.bit_generator.state, s.inside | fetched
        g, units, piece, closed = _mixed(coarse, links, inside)
        place = np.searchsorted(pieces, piece)
        assign = np.where(whole[place] >= 0, whole[place], 0)
        for i in np.flatnonzero(whole[place] < 0).tolist():
            assign[i] = split[int(g.ids[i])]
        district = len(s.stack)
        left, free = districts - district, np.flatnonzero(assign == 0)
        tree = None
        try:
            tree = cut_tree(g, free, units, Balance(low, high, (1, left)), s.rng, closed=closed)
            if tree.wanted:
                s.rng.bit_generator.state = before  # the same tree again, when they are there
                return sorted({int(piece[i]) for i in tree.wanted})
        except ValueError:  # not connected
            pass
        fetched = {}
        s.attempts[-1] += 1
        s.steps += 1
        if tree is None or not tree.cuts:
            continue
        new, _ = _cut_off(g, tree, assign, free, district, left, low, high, s.rng)
        if not all(rule(g, new, districts) for rule in rules(units)):
            continue
        # a part is split where its nodes differ
        least, most = np.full(len(pieces), districts + 1), np.full(len(pieces), -1)
        np.minimum.at(least, place, new)
        np.maximum.at(most, place, new)
        cut = least != most
        nodes = np.flatnonzero(cut[place])
        s.inside = {x: inside[x] for x in pieces[cut].tolist()} | {x: s.inside[x] for x in s.inside}
        s.stack.append((np.where(cut, -1, least).astype(np.int32), dict(zip(g.ids[nodes].tolist(), new[nodes].tolist(), strict=True)), log_p + tree.log_probability(), cuts + 1))
        s.attempts.append(0)
        if left == 1:
            return None
    return None


def random_plans_by_units(
    seeds: DataFrame, graph: Graph, levels: list[str], districts: int, low: float, high: float, rules: Callable[[list[np.ndarray]], tuple[Rule, ...]] = lambda units: (),
    max_attempts: int = 100, max_steps: int = 10_000,
) -> DataFrame:
    """SCHEMA: as ``random_plans``, over a graph that no task holds, with at least two districts.

    A task holds the coarsest units' graph alone: connected parts of them, with
    populations and the weights between them. A tree of it tells which parts may
    be opened; all seeds ask for the insides of theirs by one join, and draw on.
    So a round is a join that brings as many nodes as these units have, and there
    are as many rounds as trees that the slowest seed needs. ``rules`` gets the
    unit of each node or unopened part, on every level; a part that isn't opened
    has one unit of a finer level.
    """
    spark, spec = seeds.sparkSession, graph.spec
    nodes = graph.nodes.select("id", F.col(spec.population).cast("double").alias("pop"), *[F.col(c).cast("string").alias(c) for c in levels])
    by_unit = nodes.select(F.lit(0).alias("plan_id"), F.col("id").alias("node"), F.col(levels[0]).alias("district"))
    labels = component_labels(graph.edges.withColumn(spec.edge_weight, F.col(spec.edge_weight).cast("double")).withColumnRenamed(spec.edge_weight, "connections"), by_unit)
    placed = written(nodes.join(labels.select(F.col("node").alias("id"), F.col("component").alias("piece")).hint("merge"), "id"), "pieces")
    ends = graph.edges.select("src", "dst", F.col(spec.edge_weight).cast("double").alias("w")).filter("w <> 0")
    for end, c in (("src", "p"), ("dst", "q")):
        ends = ends.join(placed.select(F.col("id").alias(end), F.col("piece").alias(c)).hint("merge"), end)
    ends = written(ends, "ends")
    coarse = placed.groupBy("piece").agg(F.sum("pop").alias("pop"), F.first(levels[0]).alias("unit"), F.count("*").alias("nodes")).toPandas().sort_values("piece", ignore_index=True)
    coarse["unit"] = codes(coarse.unit)
    a, b = unordered("p", "q")
    links = ends.filter("p <> q").groupBy(a.alias("p"), b.alias("q")).agg(F.sum("w").alias("w")).toPandas().sort_values(["p", "q"], ignore_index=True)
    row = F.struct("id", "pop", "piece", F.array(*levels[1:]).cast("array<string>").alias("units"))
    own = placed.groupBy("piece").agg(F.collect_list(row).alias("n"))
    at = ends.withColumn("piece", F.explode(F.array_distinct(F.array("p", "q"))))
    insides = written(own.join(at.groupBy("piece").agg(F.collect_list(F.struct("src", "dst", "w", "p", "q")).alias("e")).hint("merge"), "piece", "left"), "insides")
    shared = spark.sparkContext.broadcast((coarse, links))

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, between = shared.value
        for batch in batches:
            for r in (batch.slice(i, 1) for i in range(batch.num_rows)):
                seed, state, done = (r.column(c)[0].as_py() for c in ("seed", "state", "done"))
                wanted = None
                if not done:
                    first = (np.zeros(len(parts), np.int32), {}, 0.0, 0)
                    s = pickle.loads(state) if state else _Building(np.random.Generator(np.random.PCG64(seed)), [first], [0])
                    wanted = _go_on(s, parts, between, _insides(r.column("boxes")), districts, low, high, rules, max_attempts, max_steps)
                    state = pickle.dumps(s)
                yield pa.RecordBatch.from_pydict({"seed": [seed], "state": [state], "wanted": pa.array([wanted or []], pa.list_(pa.int64())), "done": [wanted is None]})

    box = F.struct("piece", "n", F.coalesce("e", F.array().cast(insides.schema["e"].dataType)).alias("e"))
    kind = T.ArrayType(insides.select(box.alias("b")).schema["b"].dataType)
    state = seeds.select(F.col("seed").cast("long").alias("seed"), F.lit(None).cast("binary").alias("state"), F.lit(False).alias("done"), F.lit(None).cast(kind).alias("boxes"))
    while True:
        out = written(state.mapInArrow(advance, "seed long, state binary, wanted array<long>, done boolean"), "building")
        if out.filter("NOT done").isEmpty():
            break
        asked = out.select("seed", F.explode("wanted").alias("piece")).join(insides, "piece").groupBy("seed").agg(F.collect_list(box).alias("boxes"))
        state = out.drop("wanted").join(asked, "seed", "left").select("seed", "state", "done", "boxes").repartition(max(1, out.count()), "seed")

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, _ = shared.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                whole, split, log_p, _ = pickle.loads(r.state).stack[-1]
                every, keep = parts.piece.to_numpy(), whole >= 0
                yield pd.DataFrame({"seed": r.seed, "piece": every[keep], "node": None, "district": whole[keep], "log_probability": log_p}).astype({"node": "Int64"})
                yield pd.DataFrame({"seed": r.seed, "piece": None, "node": list(split), "district": list(split.values()), "log_probability": log_p}).astype({"piece": "Int64", "node": "Int64"})

    done = written(out.mapInPandas(finished, "seed long, piece long, node long, district int, log_probability double"), "parts")
    whole = placed.select(F.col("id").alias("node"), "piece").hint("merge").join(done.filter("piece IS NOT NULL").drop("node"), "piece").select("seed", "node", "district", "log_probability")
    return whole.unionByName(done.filter("piece IS NULL").select("seed", "node", "district", "log_probability"))
