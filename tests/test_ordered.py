"""Running sums and numbers by ranges, containment of nested intervals, and arcs of cycles, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import cycles as Y
from parcela.operators import ordered as Q


def nested(rng, low, high, out, deep=0):
    """Intervals of a walk over a tree: nested or apart; some equal, some with equal begins or ends, some empty."""
    while low <= high and len(out) < 400:
        end = rng.randint(low, high)
        out.append((len(out), low, end))
        if rng.random() < 0.15:
            out.append((len(out), low, end))
        if deep < 5 and rng.random() < 0.7:
            nested(rng, low + rng.randint(0, 1), end - rng.randint(0, 1), out, deep + 1)
        low = end + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contained_counts(spark, seed):
    out: list = []
    nested(random.Random(seed), 0, 300, out)
    df = spark.createDataFrame(out, "id long, enter long, leave long")
    want = {i: sum(a <= c and d <= b for _, c, d in out) for i, a, b in out}
    for ranges in (1, 7):
        assert {r.id: r.below for r in Q.contained_counts(df, ranges).collect()} == want
    assert Q.contained_counts(df.limit(0)).count() == 0


def test_running_and_numbered(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(x)) for i, x in enumerate(rng.integers(-5, 20, 500))]
    df = spark.createDataFrame(rows, "id long, x long").repartition(5)
    order = [F.col("x"), F.col("id").desc()]
    plain, total, want = sorted(rows, key=lambda r: (r[1], -r[0])), 0, {}
    for n, (i, x) in enumerate(plain, 1):
        total += x
        want[i] = (n, total)
    for ranges in (1, 6):
        got = Q.numbered(Q.running(df, order, F.col("x"), "upto", ranges), order, "n", ranges)
        assert {r.id: (r.n, r.upto) for r in got.collect()} == want
    plan = Q.numbered(df, order, "n", 6)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_arcs_and_overlaps(spark):
    """Any weights, zero and fractions among them; cycles of one position; the cut that stands."""
    rng = np.random.default_rng(3)
    cycles = {f"c{k}": np.round(rng.random(int(rng.integers(1, 9))) * 8, 1) * (rng.random() > 0.2 or rng.integers(0, 2)) for k in range(60)}
    rows = [(k, i + 1, float(x)) for k, w in cycles.items() for i, x in enumerate(w)]
    df = spark.createDataFrame(rows, "cycle_id string, pos int, weight double").repartition(3)
    low, high = 3.05, 14.05
    n_u = {k: max(1, len(w) // 2) for k, w in cycles.items()}
    want, changed = {}, {}
    for k, w in cycles.items():
        n = len(w)
        for a in range(1, n + 1):
            for b in range(a, n):
                pop = w[a - 1 : b].sum()
                if low <= pop <= high and low <= w.sum() - pop <= high:
                    want[k, a, b] = round(float(pop), 6)
                    arc, first = set(range(a, b + 1)), set(range(1, n_u[k] + 1))
                    same = sum(w[i - 1] for i in range(1, n + 1) if (i in arc) == (i in first))
                    changed[k, a, b] = round(float(w.sum() - same), 6), round(float(same), 6)
    arcs = Y.cut_arcs(df, low, high)
    assert {(r.cycle_id, r.a, r.b): round(r.pop, 6) for r in arcs.collect()} == want and len(want) > 50
    sizes = spark.createDataFrame([(k, len(w), n_u[k]) for k, w in cycles.items()], "cycle_id string, n long, n_u long")
    got = {(r.cycle_id, r.a, r.b): (round(r.overlap, 6), round(r.total - r.overlap, 6)) for r in Y.overlaps(df, sizes, arcs).collect()}
    assert set(got) == set(want)
    for key, (side, rest) in got.items():  # what changes sides if the arc stands for the first district's rest, or for the first district
        assert {side, rest} == set(changed[key])
    standing = sizes.select("cycle_id", F.col("n_u").cast("int").alias("b"))
    assert {(r.cycle_id, r.a, r.b) for r in Y.cut_arcs(df, low, high, standing).collect()} == {k for k in want if k[1:] != (1, n_u[k[0]])}


def test_marks_and_swaps(spark):
    """A marked node that changes sides while its label is swapped leaves the labels where they are."""
    rows = [(a, b, n_u, mark, swap) for a in (1, 2, 3) for b in (2, 3) for n_u in (1, 2) for mark in (1, 2, 3) for swap in (False, True)]
    df = spark.createDataFrame(rows, "a int, b int, n_u long, mark int, swap boolean")
    for r in Y.mark_stays(df, F.col("mark"), F.col("swap")).collect():
        moves = (r.mark <= r.n_u) != (r.a <= r.mark <= r.b)
        assert r.stays == (moves == (not r.swap))
