"""Best-fit packing of token sequences under several capacities.

Every document is tokenised whole and ends with an end id. Only documents over
the capacity are cut, into full pieces and a last shorter one. Pieces are dealt
by row number and piece into groups of about ``group_pieces``, the same in every
retry, and each group is packed by
vector best-fit: longest piece first, into the open bin that fits in all of

* tokens (``capacity``),
* documents (``max_docs``),
* attention cost, the sum of squared lengths (``max_cost``),

and has the smallest weighted norm of what would be left (``by="norm"``), or
the largest weighted dot product of piece and residual (``by="dot"``). Each
group wastes at most part of a few bins. Only lengths and checksums are
shuffled, never tokens.

Defined results: a null or empty text is the end id alone; rows that share an
id are packed as documents of their own; a null id stays null, and any 64-bit id
beside it what it is; a text of any length is cut into pieces; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, small_batches, stored, table, with_row_ids, written
from .tokens import END_ID, Encoder, tokenizer_path

CAPACITY, MAX_DOCS, GROUP_PIECES = 4096, 4096, 16384
WEIGHTS = (1.0, 0.001, 0.001)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for b in slices(batches):
        rows = []
        ids = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
        for (doc, rid), tokens in zip(ids, encoder.encode(b.column(1).to_pylist()), strict=True):
            data = np.append(tokens, END_ID).astype("<u4")
            for i, start in enumerate(range(0, len(data), capacity)):
                part = data[start : start + capacity]
                rows.append((doc, i, start, len(part), zlib.crc32(part.tobytes()), rid))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])
    del encoder
    release()


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, by: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    cost = capacity * capacity if max_cost is None else max_cost
    full = np.array([capacity, max_docs, cost], np.float64)
    w = np.asarray(weights, np.float64)
    items = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], 1)
    if (items > full).any():
        raise ValueError("a piece is over a capacity by itself")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    room, number, used = np.zeros((len(lengths), 3)), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_open, n_bins = 0, 0
    least = lengths.min() if len(lengths) else 0
    for k, i in enumerate(order):
        item = items[i]
        if k % 256 == 0 and n_open:  # bins that nothing fits any more are closed
            live = (room[:n_open, 0] >= least) & (room[:n_open, 1] >= 1) & (room[:n_open, 2] >= least * least)
            m = int(live.sum())
            room[:m], number[:m], used[:m] = room[:n_open][live], number[:n_open][live], used[:n_open][live]
            n_open = m
        r = room[:n_open]
        fits = np.flatnonzero((r[:, 0] >= item[0]) & (r[:, 1] >= item[1]) & (r[:, 2] >= item[2]))
        if len(fits):
            scaled = r[fits] / full
            if by == "dot":
                j = fits[np.argmax((scaled * (item / full) * w).sum(1))]
            else:
                j = fits[np.argmin((((scaled - item / full) ** 2) * w).sum(1))]
        else:
            j, n_open = n_open, n_open + 1
            room[j], number[j], used[j] = full, n_bins, 0
            n_bins += 1
        bins[i], offsets[i] = number[j], used[j]
        room[j] -= item
        used[j] += int(item[0])
    return bins, offsets


def _pack_group(t: pa.Table, capacity: int, max_docs: int, max_cost: int | None, by: str) -> pa.Table:
    """In Arrow throughout, where a 64-bit id beside a null one stays what it is."""
    t = t.sort_by([("rid", "ascending"), ("piece", "ascending")])
    bins, offsets = best_fit(t.column("length").to_numpy(), capacity, max_docs, max_cost, by)
    sequence = t.column("grp").to_numpy() * 2**32 + bins
    return t.drop_columns(["rid", "grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, by: str = "norm",
    group_pieces: int = GROUP_PIECES, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    raw = stored(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    raw = with_row_ids(raw, "rid").select("doc_id", "text", "rid")
    with small_batches(docs.sparkSession):
        pieces = written(raw.mapInArrow(lambda b: _pieces(b, path, capacity), schema + ", rid long"), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(lambda t: _pack_group(t, capacity, max_docs, max_cost, by), schema + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
