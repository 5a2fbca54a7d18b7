"""Chains as a stream: each tick (chain_id, steps) advances its chain, whose forest is held as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcela.plans.chain import run_chain
from parcela.plans.forest import LocalGraph, random_plan
from parcela.sources.run_config import SEED_BASE, SEED_STEP

STATE = "step long, districts array<int>, tree array<int>, rng string"
OUTPUT = "chain_id long, step long, districts array<int>, accepted int, proposals int"


def run(ticks: DataFrame, g: LocalGraph, districts: int, low: float, high: float, mix: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """OUTPUT, a row for each tick of the stream ticks(chain_id, steps), in append mode."""
    mix, weights = mix or {"two_tree": 0.1, "one_tree": 0.9}, weights or {}
    shared = ticks.sparkSession.sparkContext.broadcast(g)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        graph, chain, out = shared.value, int(key[0]), []
        if state.exists:
            step, assign, tree, rng = state.get
            assign, tree, rng = np.array(assign), set(tree), json.loads(rng)
        else:
            seed = SEED_BASE + SEED_STEP * chain
            step, assign, tree, rng = 0, random_plan(graph, districts, low, high, np.random.Generator(np.random.PCG64([seed, 1]))), None, None
        for pdf in batches:
            for n in pdf.steps:
                n = int(n)
                for at, s, log, r in run_chain(graph, np.asarray(assign), low, high, n, step + n, SEED_BASE + SEED_STEP * chain, mix, weights, step + 1, tree, rng):
                    if at == step + n:  # windows end at multiples; every tick is one window
                        last, proposals = s, log
                        rng = r.bit_generator.state
                step, assign, tree = step + n, last.assign, set(last.tree)
                out.append((chain, step, assign.tolist(), sum(p.accepted for p in proposals), len(proposals)))
        state.update((step, np.asarray(assign).tolist(), sorted(int(e) for e in tree), json.dumps(rng)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return ticks.groupBy("chain_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
