"""The 4 x 4 grid with four districts of four nodes, and all its balanced plans by brute force."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

XY = [(i % 4, i // 4) for i in range(16)]
EDGES = [(i, j) for i in range(16) for j in range(i + 1, 16) if abs(XY[i][0] - XY[j][0]) + abs(XY[i][1] - XY[j][1]) == 1]
NEAR = {i: [b if a == i else a for a, b in EDGES if i in (a, b)] for i in range(16)}
BORDER = [(x in (0, 3)) + (y in (0, 3)) for x, y in XY]


def _connected(nodes: frozenset) -> bool:
    seen, todo = set(), [min(nodes)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in NEAR[x] if y in nodes]
    return len(seen) == len(nodes)


@cache
def all_plans() -> list[tuple[int, ...]]:
    """Every partition into four connected sets of four nodes: district (1..4) of each node."""
    quads = [frozenset(c) for c in combinations(range(16), 4) if _connected(frozenset(c))]
    out = []

    def go(left: frozenset, chosen: list):
        if not left:
            assign = [0] * 16
            for d, q in enumerate(chosen, 1):
                for x in q:
                    assign[x] = d
            out.append(tuple(assign))
            return
        first = min(left)
        for q in quads:
            if first in q and q <= left:
                go(left - q, [*chosen, q])

    go(frozenset(range(16)), [])
    return out


def cut_edges(assign) -> int:
    return sum(assign[a] != assign[b] for a, b in EDGES)


def log_forests(assign, w=None) -> float:
    total = 0.0
    w = np.ones(len(EDGES)) if w is None else w
    for d in (1, 2, 3, 4):
        nodes = [i for i in range(16) if assign[i] == d]
        at = {x: i for i, x in enumerate(nodes)}
        lap = np.zeros((4, 4))
        for (a, b), x in zip(EDGES, w, strict=True):
            if a in at and b in at:
                lap[at[a], at[b]] -= x
                lap[at[b], at[a]] -= x
        lap -= np.diag(lap.sum(1))
        total += np.linalg.slogdet(lap[1:, 1:])[1]
    return total


def frames(spark, w=None):
    """nodes, edges, plans of the grid, all plans at once."""
    nodes = spark.createDataFrame([(i, 1, 1.0, float(BORDER[i]), str(XY[i][0] // 2 + 2 * (XY[i][1] // 2)), str(i)) for i in range(16)], "id long, pop long, area double, border_length double, county string, name string")
    w = [1.0] * len(EDGES) if w is None else w
    edges = spark.createDataFrame([(a, b, 1.0, float(x)) for (a, b), x in zip(EDGES, w, strict=True)], "src long, dst long, length double, connections double")
    plans = spark.createDataFrame([(p, i, d) for p, assign in enumerate(all_plans()) for i, d in enumerate(assign)], "plan_id int, node long, district int")
    return nodes, edges, plans
