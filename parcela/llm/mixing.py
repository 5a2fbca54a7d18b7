"""Mixing sources to target weights by temperature.

A source's token share is raised to an exponent in 0..1 and normalised: 1 keeps
the natural mix, 0 makes all sources equal. The exponent is bisected to the
target: the largest entropy of the weights, or the flattest weights with which
no source is repeated more than ``max_repetition`` times. The budget defaults
to the smallest number of tokens at which every source is seen whole at least
once, so that mixing drops nothing.

The weights are realised by blocks: each source is hashed into ``n_blocks``
blocks; in every epoch its blocks come in another permutation, and the last
epoch stops at the block with which the source's budget is met. A block's place
in the stream is its share of the source's budget, so that every stretch of the
stream holds the sources at their weights. A hot source is spread over its
blocks and no source's rows meet in one task. The table of sources is never
collected: bisection reads sums of powers of shares from it.

Defined results: null is a source of its own; null or empty texts have no
tokens; a source without tokens is seen once; repeated rows are placed alike;
an empty table gives an empty result; a column named like a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, fresh, release, slices, small_batches, table, written
from .tokens import Encoder, tokenizer_path

N_BLOCKS = 1024
#: Exponents tried in one pass over the table of sources.
GRID = 31
MAX_REPETITION = 2.0
#: Block tables up to this many rows (some 60 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
RESULTS = ("epoch", "block", "mix_place")


def n_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """Number of tokens of op9's tokenizer, without an end id: what shares are taken of."""
    path = tokenizer or tokenizer_path()

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for t in texts:
            parts = (p.column(0).to_pylist() for p in slices([pa.RecordBatch.from_arrays([t], ["text"])]))
            yield pa.array([len(x) for p in parts for x in encoder.encode(p)], pa.int64())
        del encoder
        release()

    return count(text.cast("binary"))


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    norm = sum(powers)
    return [p / norm for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x)


def repetitions(tokens: list[int], exponent: float, budget: float | None = None) -> list[float]:
    """Epochs over each source under the budget; without one, the least rises to 1."""
    if not sum(tokens):
        return [1.0] * len(tokens)
    w, total = weights(tokens, exponent), sum(tokens)
    ratio = [x * total / t if t else None for x, t in zip(w, tokens, strict=True)]
    scale = budget / total if budget is not None else 1 / min(r for r in ratio if r is not None)
    least = 1.0 if budget is None else 0.0  # rounding must not cut the last block of the source seen once
    return [1.0 if r is None else max(least, r * scale) for r in ratio]


def _bisect(over: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent in 0..1 that isn't ``over``, which falls as the exponent rises; GRID exponents are tried at a time."""
    low, high = 0.0, 1.0
    if not over([low])[0]:
        return low
    while high - low > 2.0**-50:
        tried = [x for x in (low + (high - low) * i / (GRID + 1) for i in range(1, GRID + 1)) if low < x < high]
        if not tried:
            break
        passed = [x for x, o in zip(tried, over(tried), strict=True) if o]
        low, high = max([low, *passed]), min([high, *(x for x in tried if x not in passed)])
    return high


def bisect_exponent(tokens: list[int], target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None) -> float:
    """The smallest exponent that meets the repetition limit, or the one with the target entropy; both fall as it rises."""
    if not any(tokens):
        return 1.0
    if target_entropy is not None:
        return _bisect(lambda tried: [entropy(weights(tokens, a)) > target_entropy for a in tried])
    return _bisect(lambda tried: [max(repetitions(tokens, a, budget)) > max_repetition for a in tried])


def epochs_column(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> Column:
    """Epochs of each row (tokens) of ``sources``, as ``repetitions`` at ``bisect_exponent``; from sums over the table, which is never collected."""
    t = F.col("tokens").cast("double")
    total, least, most = sources.filter("tokens > 0").agg(F.sum(t), F.min(t), F.max(t)).first()
    if not total:
        return F.lit(1.0)

    def sums(tried: list[float]) -> list[tuple[float, float]]:
        """Of each exponent: the sum of the powers, and of powers times the logarithm of the share."""
        share = t / total
        each = [(F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))) for a in tried]
        row = sources.filter("tokens > 0").agg(*[x for pair in each for x in pair]).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def ratio(tokens: float, a: float, norm: float) -> float:
        return (tokens / total) ** a / norm * total / tokens

    def over(tried: list[float]) -> list[bool]:
        out = []
        for a, (norm, logs) in zip(tried, sums(tried), strict=True):
            if target_entropy is not None:
                out.append(math.log(norm) - a * logs / norm > target_entropy)
            else:  # the smallest source is repeated most, the largest least
                scale = budget / total if budget is not None else 1 / ratio(most, a, norm)
                out.append(ratio(least, a, norm) * scale > max_repetition)
        return out

    a = _bisect(over)
    norm = sums([a])[0][0]
    scale = budget / total if budget is not None else 1 / ratio(most, a, norm)
    epochs = F.pow(t / total, F.lit(a)) / norm * total / t * scale
    return F.when(F.col("tokens") > 0, F.greatest(F.lit(1.0 if budget is None else 0.0), epochs)).otherwise(F.lit(1.0))


def mix_sources(
    docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", target_entropy: float | None = None,
    max_repetition: float | None = MAX_REPETITION, budget: float | None = None, n_blocks: int = N_BLOCKS, seed: int = 0,
    tokenizer: str | None = None,
) -> DataFrame:
    """Rows of ``docs``, repeated as the mix asks, with epoch (from 0), block and mix_place (0..1, the place in the stream)."""
    docs = docs.select(*[c for c, n in zip(columns(docs), docs.columns, strict=True) if n.lower() not in RESULTS])
    s, b = fresh(docs, "source_key"), fresh(docs, "block_of")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    block = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(text_col, F.lit(seed))).otherwise(F.xxhash64(id_col, F.lit(seed))), F.lit(n_blocks)).cast("int")
    keyed = docs.select(*columns(docs), key.alias(s), block.alias(b))
    counted = keyed.select(F.col(s).alias("s"), F.col(b).alias("b"), n_tokens(F.col(text_col), tokenizer).alias("tokens"))
    with small_batches(docs.sparkSession):
        blocks = written(counted.groupBy("s", "b").agg(F.sum("tokens").alias("tokens")), "mix_blocks")
    sources = written(blocks.groupBy("s").agg(F.sum("tokens").alias("tokens")), "mix_sources")
    recipe = sources.select("s", F.col("tokens").alias("total"), epochs_column(sources, target_entropy, max_repetition, budget).alias("epochs"))
    order = Window.partitionBy("s", "epoch").orderBy(F.xxhash64("s", "b", "epoch", F.lit(seed)), "b")
    placed = blocks.join(written(recipe, "recipe"), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1))))
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("before", before).withColumn("rank", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("s", "epoch")))
    # in the last epoch, blocks up to the one whose middle passes the budget
    placed = placed.filter((F.col("epoch") + 1 <= F.col("epochs")) | (F.col("before") + F.col("tokens") / 2 <= (F.col("epochs") - F.col("epoch")) * F.col("total")))
    place = F.coalesce(F.try_divide(F.col("epoch") * F.col("total") + F.col("before"), F.col("epochs") * F.col("total")), F.col("rank") / F.col("n"))
    placed = written(placed.select(F.col("s").alias(s), F.col("b").alias(b), "epoch", place.alias("mix_place")), "mix_places")
    if placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    return keyed.join(placed, [s, b]).select(*columns(docs), F.col(b).alias("block"), "epoch", "mix_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_sources(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "epoch", "block", "mix_place")
