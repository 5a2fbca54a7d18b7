"""Hard negatives of anchors by exact inner products, with early discards after an orthogonal PCA rotation.

Vectors become whole numbers (``floor(scale * x)``) and every score is an
integer inner product. To spare most of them,

1. the second moments of all vectors are summed in tasks; their eigenvectors are
   an orthogonal rotation that gathers what vectors share in leading components;
2. rows and anchors are dealt by row number into blocks, and each pair of blocks
   is a cell with a task's work. In a cell the partial products over leading
   components are accumulated in steps (``CUTS``). What the remaining components
   can add is bounded by the product of the residual norms, plus a slack for
   rounding (``_slack``); a pair whose bounds leave the scores that are still
   sought is discarded;
3. survivors are scored by integer products, which alone decide.

First come each anchor's positives: the first ``n_positives`` other rows of its
label. Their scores set the windows of the negatives, ``low`` to ``high`` percent
of a positive's score, and a second pass over the cells finds the first
``n_negatives`` rows of other labels in each window. A cell hands on no more than
that many rows for each anchor and window, and a label or id of any frequency is
spread over all cells.

Defined results: a row without label or vector, with a null or non-finite
component, or so long a vector (2^31 and more after scaling) that scores could
pass 64 bits takes no part. Shorter vectors count as padded with zeros. Rows are
told apart by their place in the table, so that rows that share an id are rows of
their own; ties go to the smaller id, null ids last, then to the place. A null id
is no anchor. A positive score of zero or less has the window that the
inequalities leave. An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, with_row_ids, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
#: Shares of the components after which bounds are looked at.
CUTS = (1 / 8, 1 / 4, 1 / 2)
#: Values in a block of rows, of anchors, and in the arrays of a step.
ROW_VALUES, ANCHOR_VALUES, STEP_VALUES = 1 << 21, 1 << 18, 1 << 22
#: Blocks smaller than this are not made for the sake of more tasks.
LEAST_ROWS = 64
MOMENT_PARTS = 8
#: No score is larger.
MOST = 2**62
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """A row of d numbers for each list, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    out = np.zeros((n, d), np.int64)
    if n:
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        out[np.arange(d) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((d, d))
    for b in batches:
        x = _vectors(b.column(0), d).astype(np.float64)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moments"])


def _summed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(d * d)
    for b in batches:
        for m in b.column(0):
            total += np.frombuffer(m.as_py(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moments"])


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments of all vectors (column v), by falling eigenvalue. Only d by d sums reach the driver."""
    parts = written(rows.select("v").mapInArrow(lambda b: _moments(b, d), "moments binary"), "moments")
    sums = parts.repartition(MOMENT_PARTS).mapInArrow(lambda b: _summed(b, d), "moments binary").collect()
    total = np.sum([np.frombuffer(r.moments, np.float64) for r in sums], axis=0).reshape(d, d)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def _slack(d: int) -> float:
    """Of the product of two norms: more than the rounding of the rotation and of all products can add up to."""
    return (d + 16) ** 2 * 2.0**-50


class Rotated:
    """Integer vectors, their rotation, and the norms of what follows each cut."""

    def __init__(self, ints: np.ndarray, q: np.ndarray):
        d = ints.shape[1]
        self.ints, self.turned = ints, ints.astype(np.float64) @ q
        self.cuts = sorted({max(1, int(d * c)) for c in CUTS} | {d})
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.tails = [np.sqrt(squares[:, c]) if c < d else np.zeros(len(ints)) for c in self.cuts]
        self.norms = np.sqrt(squares[:, 0]) + 1

    def __len__(self) -> int:
        return len(self.ints)


def survivors(a: Rotated, i0: int, i1: int, b: Rotated, rows: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, rows and exact scores of all allowed pairs whose score may lie in low..high of the anchor (and some others): anchors i0 to i1, rows of ``b``."""
    d = a.ints.shape[1]
    cut, slack = a.cuts[0], _slack(d)
    partial = a.turned[i0:i1, :cut] @ b.turned[rows, :cut].T
    reach = np.outer(a.tails[0][i0:i1], b.tails[0][rows]) + np.outer(a.norms[i0:i1] * slack, b.norms[rows])
    alive = allowed & (partial + reach >= low[i0:i1, None]) & (partial - reach <= high[i0:i1, None])
    at, to = np.nonzero(alive)
    known = partial[at, to]
    at, to = at + i0, rows[to]
    step = max(1, STEP_VALUES // d)
    for s in range(0, len(at), step):
        i, j, p = at[s : s + step], to[s : s + step], known[s : s + step]
        for k, (before, cut) in enumerate(zip(a.cuts, a.cuts[1:], strict=False), 1):
            p = p + np.einsum("ij,ij->i", a.turned[i, before:cut], b.turned[j, before:cut])
            reach = a.tails[k][i] * b.tails[k][j] + a.norms[i] * slack * b.norms[j]
            keep = (p + reach >= low[i]) & (p - reach <= high[i])
            i, j, p = i[keep], j[keep], p[keep]
        yield i, j, np.einsum("ij,ij->i", a.ints[i], b.ints[j])


class First:
    """The first k of each group by falling score, id (null last) and place, as they come in."""

    NAMES = ("group", "score", "none", "id", "rid")

    def __init__(self, groups: int, k: int):
        self.k, self.held = k, [np.zeros(0, bool if n == "none" else np.int64) for n in self.NAMES]
        self.least = np.full(groups, -np.inf)

    def add(self, *columns: np.ndarray) -> None:
        group, score, none, ids, rid = (np.concatenate(x) for x in zip(self.held, columns, strict=True))
        order = np.lexsort((rid, ids, none, -score, group))
        g = group[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        last = order[rank == self.k - 1]
        self.least[group[last]] = score[last]
        self.held = [x[order[rank < self.k]] for x in (group, score, none, ids, rid)]


def _ramp(n: int) -> Iterator[slice]:
    """Batches of rows, small ones first, so that the scores sought rise early."""
    at, size = 0, 64
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(2048, size * 4)


def _ids(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = t.column(name).combine_chunks()
    return pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(c).to_numpy(zero_copy_only=False)


ANCHORS = 512
POSITIVE_SCHEMA = "anchor_rid long, rid long, vec_id long, score long"
NEGATIVE_SCHEMA = "anchor_rid long, slot int, anchor_id long, positive_id long, positive_score long, rid long, vec_id long, score long"


def _positives(rows: pa.Table, anchors: pa.Table, q: np.ndarray, k: int) -> pa.Table:
    """The first k rows of each anchor's label in one cell."""
    d = len(q)
    anchors = anchors.sort_by("label")
    a, b = Rotated(_vectors(anchors.column("v"), d), q), Rotated(_vectors(rows.column("v"), d), q)
    arid, brid = (t.column("rid").to_numpy() for t in (anchors, rows))
    alabel, blabel = (t.column("label").to_numpy() for t in (anchors, rows))
    ids, none = _ids(rows, "vec_id")
    first, high = First(len(a), k), np.full(len(a), np.inf)
    for label in np.unique(alabel).tolist():
        mine = np.flatnonzero(blabel == label)
        i_from, i_to = np.searchsorted(alabel, label), np.searchsorted(alabel, label, "right")
        for i0 in range(i_from, i_to, ANCHORS):
            i1 = min(i_to, i0 + ANCHORS)
            for part in _ramp(len(mine)):
                at = mine[part]
                allowed = arid[i0:i1, None] != brid[at][None, :]
                for i, j, score in survivors(a, i0, i1, b, at, first.least, high, allowed):
                    first.add(i, score, none[j], ids[j], brid[j])
    g, score, empty, vec_id, rid = first.held
    return pa.table({"anchor_rid": arid[g], "rid": rid, "vec_id": pa.array(vec_id, pa.int64(), mask=empty), "score": score})


def _negatives(rows: pa.Table, anchors: pa.Table, q: np.ndarray, k: int, low: int, high: int) -> pa.Table:
    """The first k rows of other labels in the window of each anchor and positive in one cell."""
    d = len(q)
    a, b = Rotated(_vectors(anchors.column("v"), d), q), Rotated(_vectors(rows.column("v"), d), q)
    arid, brid = (t.column("rid").to_numpy() for t in (anchors, rows))
    alabel, blabel = (t.column("label").to_numpy() for t in (anchors, rows))
    ids, none = _ids(rows, "vec_id")
    positives = anchors.column("positives").to_pylist()
    slots = max(map(len, positives), default=1)
    # whole bounds of 100 * score: low * p and high * p; a window past the last positive takes nothing
    lo, hi = np.full((len(a), slots), np.inf), np.full((len(a), slots), -np.inf)
    floor, roof = np.full((len(a), slots), 1, np.int64), np.zeros((len(a), slots), np.int64)
    for i, ps in enumerate(positives):
        for s, p in enumerate(ps):
            floor[i, s], roof[i, s] = max(-MOST, min(MOST, -(-low * p["score"] // 100))), max(-MOST, min(MOST, high * p["score"] // 100))
            lo[i, s], hi[i, s] = floor[i, s] - 0.5, roof[i, s] + 0.5
    first = First(len(a) * slots, k)
    roofs = np.where(floor <= roof, hi, -np.inf).max(1)
    for i0 in range(0, len(a), ANCHORS):
        i1 = min(len(a), i0 + ANCHORS)
        for part in _ramp(len(b)):
            at = np.arange(part.start, part.stop)
            sought = np.where(floor <= roof, np.maximum(lo, first.least.reshape(len(a), slots)), np.inf).min(1)
            allowed = alabel[i0:i1, None] != blabel[at][None, :]
            for i, j, score in survivors(a, i0, i1, b, at, sought, roofs, allowed):
                for s in range(slots):
                    fits = np.flatnonzero((score >= floor[i, s]) & (score <= roof[i, s]))
                    first.add(i[fits] * slots + s, score[fits], none[j[fits]], ids[j[fits]], brid[j[fits]])
    g, score, empty, vec_id, rid = first.held
    of, slot = (g // slots).tolist(), (g % slots).tolist()
    anchor_ids = anchors.column("vec_id").to_pylist()
    chosen = [positives[i][s] for i, s in zip(of, slot, strict=True)]
    return pa.table(
        {
            "anchor_rid": arid[g // slots], "slot": pa.array(slot, pa.int32()), "anchor_id": pa.array([anchor_ids[i] for i in of], pa.int64()),
            "positive_id": pa.array([p["vec_id"] for p in chosen], pa.int64()), "positive_score": pa.array([p["score"] for p in chosen], pa.int64()),
            "rid": rid, "vec_id": pa.array(vec_id, pa.int64(), mask=empty), "score": score,
        }
    )


def whole_numbers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchors: Column, scale: float) -> DataFrame:
    """rid, vec_id, label, anchor, v (integers) of the rows that take part."""
    raw = stored(rows).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    raw = with_row_ids(raw, "rid")
    finite = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    squares = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    ints = F.transform("x", lambda x: F.when(F.abs(x * scale) < 2.0**31 - 2, F.floor(x * scale).cast("int")).otherwise(0))
    whole = raw.filter(F.col("label").isNotNull() & finite).filter(squares < 2.0**62)
    return whole.select("rid", "vec_id", "label", (F.col("anchor") & F.col("vec_id").isNotNull()).alias("anchor"), ints.alias("v"))


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: float = SCALE, row_values: int = ROW_VALUES, anchor_values: int = ANCHOR_VALUES,
) -> DataFrame:
    """SCHEMA: for each anchor and positive, the first negatives by rank; ``anchors`` is a condition on ``rows``."""
    if n_positives < 1 or n_negatives < 1 or low < 0 or high < 0:
        raise ValueError("counts are 1 at least, percentages 0")
    spark = rows.sparkSession
    base = written(whole_numbers(rows, id_col, label_col, vector_col, anchors, scale), "vectors")
    n, n_anchors, d = base.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    d = max(1, d)
    q = rotation(base, d)
    # as many blocks as the values ask for; more, where tasks would stand idle
    blocks = max(-(-n * d // row_values), min(-(-n // LEAST_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    anchor_blocks = -(-n_anchors * d // anchor_values)

    def cells(df: DataFrame, own: int, others: int, place: Column) -> DataFrame:
        """Each row once for each block of the other side."""
        block = F.pmod(F.xxhash64("rid"), F.lit(own))
        return df.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", place).drop("own", "other")

    dealt = cells(base.select("rid", "vec_id", "label", "v"), blocks, anchor_blocks, F.col("own") * anchor_blocks + F.col("other"))
    spread = lambda df: cells(df, anchor_blocks, blocks, F.col("other") * anchor_blocks + F.col("own"))

    def searched(anchors: DataFrame, find, schema: str) -> DataFrame:
        return dealt.groupBy("cell").cogroup(spread(anchors).groupBy("cell")).applyInArrow(find, schema)

    def ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    chosen = base.filter("anchor").select("rid", "vec_id", "label", "v")
    found = ranked(searched(chosen, lambda r, a: _positives(r, a, q, n_positives), POSITIVE_SCHEMA), n_positives, "anchor_rid")
    lists = found.groupBy("anchor_rid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    chosen = written(chosen.join(lists.withColumnRenamed("anchor_rid", "rid"), "rid"), "positives")
    out = ranked(searched(chosen, lambda r, a: _negatives(r, a, q, n_negatives, low, high), NEGATIVE_SCHEMA), n_negatives, "anchor_rid", "slot")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, rid) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
