"""Chain-local graph, random spanning trees and balanced plans: numpy and plain Python, one object for each task."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from parcela.spec import GraphSpec


@dataclass
class LocalGraph:
    """Nodes 0..n-1 with their ids, populations and columns; edges u < v with weights and perimeters, none of weight 0."""

    ids: np.ndarray
    pop: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    length: np.ndarray
    area: np.ndarray
    border: np.ndarray
    columns: dict[str, np.ndarray] = field(default_factory=dict)  # further numeric columns of the nodes, for energies

    def __post_init__(self):
        self.near: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for e, (a, b) in enumerate(zip(self.u.tolist(), self.v.tolist(), strict=True)):
            self.near[a].append((b, e))
            self.near[b].append((a, e))
        self.edge = {(a, b): e for e, (a, b) in enumerate(zip(self.u.tolist(), self.v.tolist(), strict=True))}

    @classmethod
    def from_tables(cls, nodes, edges, spec: GraphSpec | None = None) -> LocalGraph:
        """From collected pandas tables: one graph, whose size doesn't grow with the ensemble."""
        spec = spec or GraphSpec()
        nodes = nodes.sort_values("id", ignore_index=True)
        at = {x: i for i, x in enumerate(nodes.id)}
        edges = edges[edges[spec.edge_weight] != 0]
        a, b = (np.array([at[x] for x in edges[c]], int) for c in ("src", "dst"))
        col = lambda t, c, d: t[c].fillna(d).to_numpy(float) if c in t else np.full(len(t), d)
        more = {c: nodes[c].to_numpy(float) for c in nodes.select_dtypes("number") if c != "id"}
        return cls(
            nodes.id.to_numpy(), nodes[spec.population].to_numpy(float), np.minimum(a, b), np.maximum(a, b), edges[spec.edge_weight].to_numpy(float),
            col(edges, spec.edge_perimeter, 1.0), col(nodes, spec.area, 1.0), col(nodes, spec.node_border, 0.0), more,
        )

    def edge_of(self, a: int, b: int) -> int:
        return self.edge[(a, b) if a < b else (b, a)]


def pick(rng: np.random.Generator, weights: np.ndarray) -> int:
    """Index drawn with the given weights: the first whose running sum exceeds a uniform draw."""
    total = np.cumsum(weights)
    return min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(total) - 1)


def wilson_tree(g: LocalGraph, nodes: list[int], rng: np.random.Generator) -> set[int]:
    """Edges of a spanning tree of the induced subgraph, drawn in proportion to the product of its weights."""
    inside = set(nodes)
    near = {x: [(y, e) for y, e in g.near[x] if y in inside] for x in nodes}
    steps = {x: np.cumsum([g.w[e] for _, e in near[x]]) for x in nodes}
    start = nodes[int(rng.integers(len(nodes)))]
    done, queue = {start}, deque([start])
    while queue:
        for y, _ in near[queue.popleft()]:
            if y not in done:
                done.add(y)
                queue.append(y)
    if len(done) != len(nodes):
        raise ValueError("not connected: no spanning tree")
    tree, in_tree = set(), {start}
    for x in nodes:
        leave: dict[int, tuple[int, int]] = {}
        at = x
        while at not in in_tree:  # the last exit from each node is the loop-erased walk
            c = steps[at]
            leave[at] = near[at][min(int(np.searchsorted(c, rng.random() * c[-1], side="right")), len(c) - 1)]
            at = leave[at][0]
        at = x
        while at not in in_tree:
            in_tree.add(at)
            tree.add(leave[at][1])
            at = leave[at][0]
    return tree


def kruskal_tree(g: LocalGraph, nodes: list[int], rng: np.random.Generator) -> set[int]:
    """The maximum spanning tree under weights multiplied by uniform draws."""
    inside = np.zeros(len(g.ids), bool)
    inside[nodes] = True
    edges = np.flatnonzero(inside[g.u] & inside[g.v])
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tree = set()
    for e in edges[np.argsort(-g.w[edges] * rng.random(len(edges)), kind="stable")]:
        a, b = find(int(g.u[e])), find(int(g.v[e]))
        if a != b:
            up[a] = b
            tree.add(int(e))
    return tree


def tree_path(g: LocalGraph, tree_near, a: int, b: int) -> list[int]:
    """Nodes from a to b along the tree."""
    back, queue = {a: a}, deque([a])
    while queue and b not in back:
        x = queue.popleft()
        for y in tree_near(x):
            if y not in back:
                back[y] = x
                queue.append(y)
    path = [b]
    while path[-1] != a:
        path.append(back[path[-1]])
    return path[::-1]


def exchange_tree(g: LocalGraph, nodes: list[int], rng: np.random.Generator, steps: int | None = None) -> set[int]:
    """A random spanning tree by edge exchange: add a uniform edge, drop one of the cycle's with weight 1/w."""
    tree = kruskal_tree(g, nodes, rng)
    inside = np.zeros(len(g.ids), bool)
    inside[nodes] = True
    edges = np.flatnonzero(inside[g.u] & inside[g.v])
    links: list[set[int]] = [set() for _ in g.ids]
    for e in tree:
        links[g.u[e]].add(int(g.v[e]))
        links[g.v[e]].add(int(g.u[e]))
    n = len(edges)
    for _ in range(math.ceil(n * math.log(max(n, 2)) / 4) if steps is None else steps):
        one_tree_exchange(g, links, tree, int(edges[int(rng.integers(n))]), rng)
    return tree


def one_tree_exchange(g: LocalGraph, links: list[set[int]], tree: set[int], e: int, rng: np.random.Generator) -> None:
    """Adds edge e to its tree and removes one edge of the cycle it closes, e itself included, with weight 1/w."""
    if e in tree:
        return
    a, b = int(g.u[e]), int(g.v[e])
    path = tree_path(g, links.__getitem__, a, b)
    cycle = [g.edge_of(x, y) for x, y in zip(path, path[1:], strict=False)] + [e]
    out = cycle[pick(rng, 1 / g.w[cycle])]
    if out == e:
        return
    tree.remove(out)
    tree.add(e)
    x, y = int(g.u[out]), int(g.v[out])
    links[x].discard(y)
    links[y].discard(x)
    links[a].add(b)
    links[b].add(a)


class RootedForest:
    """A forest by parents, with the population at and below each node: paths, links and cuts cost the depth of what they touch."""

    def __init__(self, g: LocalGraph, tree: set[int]):
        self.links: list[set[int]] = [set() for _ in g.ids]
        for e in tree:
            self.links[g.u[e]].add(int(g.v[e]))
            self.links[g.v[e]].add(int(g.u[e]))
        self.up, self.below = [-2] * len(g.ids), g.pop.astype(float).tolist()
        for root in range(len(g.ids)):
            if self.up[root] != -2:
                continue
            self.up[root], order = -1, [root]
            for x in order:
                for y in self.links[x]:
                    if y != self.up[x]:
                        self.up[y] = x
                        order.append(y)
            for x in reversed(order[1:]):
                self.below[self.up[x]] += self.below[x]

    def root(self, x: int) -> int:
        while self.up[x] >= 0:
            x = self.up[x]
        return x

    def path(self, a: int, b: int) -> tuple[list[int], int]:
        """Nodes from a to b, and the place of the one nearest to the root: both ends climb until one meets where the other has been."""
        up, left, right = self.up, [a], [b]
        at_left, at_right, x, y = {a: 0}, {b: 0}, a, b
        if a == b:
            return [a], 0
        while x >= 0 or y >= 0:
            if x >= 0:
                x = up[x]
                if x in at_right:
                    return left + right[: at_right[x] + 1][::-1], len(left)
                if x >= 0:
                    at_left[x] = len(left)
                    left.append(x)
            if y >= 0:
                y = up[y]
                if y in at_left:
                    return left[: at_left[y] + 1] + right[::-1], at_left[y]
                if y >= 0:
                    at_right[y] = len(right)
                    right.append(y)
        raise ValueError("no path: two trees")

    def hanging(self, path: list[int], top: int) -> list[float]:
        """For each node of a path, the population of what hangs off it, itself included; ``top``: the place nearest to the root."""
        below = self.below
        out = [below[x] for x in path]
        for i in range(len(path)):
            if i != top:
                out[i + 1 if i < top else i - 1] -= below[path[i]]
        out[top] += below[self.root(path[top])] - below[path[top]]
        return out

    def members(self, path: list[int], places: list[int]) -> list[int]:
        """Nodes of what hangs off the nodes of a path at ``places``, these included."""
        on, out = set(path), []
        for i in places:
            todo = [(path[i], -1)]
            while todo:
                x, back = todo.pop()
                out.append(x)
                todo += [(y, x) for y in self.links[x] if y != back and y not in on]
        return out

    def cut(self, a: int, b: int) -> None:
        child, x = (a, b) if self.up[a] == b else (b, a)
        self.links[a].discard(b)
        self.links[b].discard(a)
        self.up[child] = -1
        while x >= 0:
            self.below[x] -= self.below[child]
            x = self.up[x]

    def link(self, a: int, b: int) -> None:
        """Joins two trees; that of a hangs on b."""
        x, way = a, [a]
        while self.up[x] >= 0:
            x = self.up[x]
            way.append(x)
        total, old = self.below[x], [self.below[y] for y in way]
        for i in range(len(way) - 1, 0, -1):
            self.up[way[i]], self.below[way[i]] = way[i - 1], total - old[i - 1]
        self.up[a], self.below[a] = b, total
        x = b
        while x >= 0:
            self.below[x] += total
            x = self.up[x]
        self.links[a].add(b)
        self.links[b].add(a)


def subtree_pops(g: LocalGraph, tree: set[int], root: int) -> tuple[list[int], dict[int, int], dict[int, float]]:
    """Nodes in breadth-first order, their parents, and the population at and below each."""
    near: dict[int, list[int]] = {}
    for e in tree:
        near.setdefault(int(g.u[e]), []).append(int(g.v[e]))
        near.setdefault(int(g.v[e]), []).append(int(g.u[e]))
    order, parent = [root], {root: -1}
    for x in order:
        for y in near.get(x, ()):
            if y != parent[x]:
                parent[y] = x
                order.append(y)
    pops = {x: float(g.pop[x]) for x in order}
    for x in reversed(order[1:]):
        pops[parent[x]] += pops[x]
    return order, parent, pops


def hierarchical_tree(g: LocalGraph, nodes: list[int], rng: np.random.Generator, units: list[np.ndarray], sample=wilson_tree) -> set[int]:
    """A spanning tree that is a tree inside every unit of every level, coarsest level first in ``units`` (unit of each node).

    Whole units hang on single edges of such a tree, so that cutting it splits
    few of them. Units, or their connected parts, are joined by a tree of the
    quotient graph, whose edges are realised by base edges drawn by weight.
    """
    if not units:
        return sample(g, nodes, rng)
    inside = np.zeros(len(g.ids), bool)
    inside[nodes] = True
    part = np.full(len(g.ids), -1)
    groups: list[list[int]] = []
    for x in nodes:
        if part[x] < 0:
            part[x] = len(groups)
            found = [x]
            for y in found:
                for z, _ in g.near[y]:
                    if inside[z] and part[z] < 0 and units[0][z] == units[0][x]:
                        part[z] = len(groups)
                        found.append(z)
            groups.append(found)
    tree: set[int] = set()
    for members in groups:
        tree |= hierarchical_tree(g, members, rng, units[1:], sample)
    between: dict[tuple[int, int], list[int]] = {}
    for e in np.flatnonzero(inside[g.u] & inside[g.v] & (part[g.u] != part[g.v])):
        a, b = sorted((int(part[g.u[e]]), int(part[g.v[e]])))
        between.setdefault((a, b), []).append(int(e))
    keys, k = list(between), np.zeros(len(groups))
    ends = np.array(keys, int).reshape(-1, 2)
    quotient = LocalGraph(np.arange(len(groups)), k, ends[:, 0], ends[:, 1], np.array([g.w[between[x]].sum() for x in keys]), np.ones(len(keys)), k, k)
    for e in sample(quotient, list(range(len(groups))), rng) if len(groups) > 1 else ():
        chosen = between[keys[e]]
        tree.add(chosen[pick(rng, g.w[chosen])])
    return tree


def balanced_edges(g: LocalGraph, tree: set[int], low: float, high: float, districts: int) -> list[tuple[int, int]]:
    """(edge, districts on its lower side) for each tree edge that leaves both sides a whole number of districts within bounds."""
    order, parent, pops = subtree_pops(g, tree, int(g.u[min(tree)]))
    total, out = pops[order[0]], []
    for x in order[1:]:
        for k in range(1, districts):
            if k * low <= pops[x] <= k * high and (districts - k) * low <= total - pops[x] <= (districts - k) * high:
                out.append((g.edge_of(x, parent[x]), k))
    return out


def three_way_cuts(g: LocalGraph, tree: set[int], low: float, high: float) -> list[tuple[int, int]]:
    """Pairs of tree edges whose removal leaves three parts within bounds: by nesting of the subtrees' intervals."""
    order, parent, pops = subtree_pops(g, tree, int(g.u[min(tree)]))
    children: dict[int, list[int]] = {}
    for x in order[1:]:
        children.setdefault(parent[x], []).append(x)
    enter, leave, clock, stack = {}, {}, 0, [(order[0], False)]
    while stack:
        x, done = stack.pop()
        if done:
            leave[x] = clock
            continue
        enter[x], clock = clock, clock + 1
        stack.append((x, True))
        stack += [(y, False) for y in children.get(x, ())]
    xs = np.array(order[1:])
    p, total = np.array([pops[x] for x in xs]), pops[order[0]]
    start, end = np.array([enter[x] for x in xs]), np.array([leave[x] for x in xs])
    out = []
    for i, x in enumerate(xs):
        below = (start > start[i]) & (end <= end[i])
        above = (start < start[i]) & (end >= end[i])
        first = np.where(below, p[i] - p, p[i])
        second = np.where(above, p - p[i], p)
        rest = total - first - second
        ok = (first >= low) & (first <= high) & (second >= low) & (second <= high) & (rest >= low) & (rest <= high)
        out += [(g.edge_of(int(x), parent[int(x)]), g.edge_of(int(xs[j]), parent[int(xs[j])])) for j in np.flatnonzero(ok) if j > i]
    return out


def random_plan(g: LocalGraph, districts: int, low: float, high: float, rng: np.random.Generator, max_attempts: int = 1000, nodes: list[int] | None = None, sample=wilson_tree, accept=None) -> np.ndarray:
    """District (1..k) of each node, 0 for those not in ``nodes``: districts are cut off random trees one at a time.

    A cut leaves one district within bounds and a remainder that can hold the
    others. ``accept(assign)`` may refuse finished plans. Raises after
    ``max_attempts``.
    """
    everything = list(range(len(g.ids))) if nodes is None else nodes
    for _ in range(max_attempts):
        assign, rest = np.zeros(len(g.ids), int), list(everything)
        for d in range(1, districts):
            try:
                tree = sample(g, rest, rng)
            except ValueError:
                break
            order, parent, pops = subtree_pops(g, tree, rest[0])
            total, left = pops[rest[0]], districts - d
            if len(order) != len(rest):
                break
            cuts = []
            for x in order[1:]:
                for mine, other, below in ((pops[x], total - pops[x], True), (total - pops[x], pops[x], False)):
                    if low <= mine <= high and left * low <= other <= left * high:
                        cuts.append((x, below))
            if not cuts:
                break
            x, below = cuts[int(rng.integers(len(cuts)))]
            under = {x}
            for y in order:
                if parent[y] in under:
                    under.add(y)
            mine = under if below else set(rest) - under
            assign[list(mine)] = d
            rest = [y for y in rest if y not in mine]
        else:
            assign[rest] = districts
            if low <= g.pop[rest].sum() <= high and (accept is None or accept(assign)):
                return assign
    raise RuntimeError(f"no balanced plan in {max_attempts} attempts")


def random_plan_with_fixed(g: LocalGraph, fixed: np.ndarray, districts: int, low: float, high: float, rng: np.random.Generator, max_attempts: int = 1000) -> np.ndarray:
    """Keeps the districts in ``fixed`` (0: free) and cuts the free nodes into the rest."""
    held = len(np.unique(fixed[fixed > 0]))
    free = np.flatnonzero(fixed == 0).tolist()
    rest = random_plan(g, districts - held, low, high, rng, max_attempts, free)
    return np.where(fixed > 0, fixed, rest + held * (rest > 0))


def random_plan_by_cluster(g: LocalGraph, cluster: np.ndarray, districts: dict[int, int], low: float, high: float, rng: np.random.Generator, max_attempts: int = 1000) -> np.ndarray:
    """Each cluster is cut on its own; the next one's districts are numbered on."""
    out, offset = np.zeros(len(g.ids), int), 0
    for c, k in sorted(districts.items()):
        part = random_plan(g, k, low, high, rng, max_attempts, np.flatnonzero(cluster == c).tolist())
        out += np.where(part > 0, part + offset, 0)
        offset += k
    return out
