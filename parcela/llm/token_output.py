"""Packed token ids as binary matrices, with segment lengths and position resets.

Documents are tokenised whole, each with an end id. Overlong ones are split
losslessly into pieces of the row width. Pieces, not documents, are dealt by row
number into groups of about ``group_bytes`` of text, so that a text of any
length is spread; each group is packed by best-fit decreasing: a segment tree over the remaining
capacities finds the tightest open row in logarithmic time. A row of the result
is a row of the packed matrix:

* ``input_ids``: ``width`` little-endian ids of ``dtype`` (uint16 by default,
  as the vocabulary is under 65,536), padded with ``PAD_ID``;
* ``cu_seqlens``: cumulative lengths of its segments, from 0;
* ``position_resets``: where position ids start again from 0 (each segment's
  start); ``position_ids`` expands them.

``unpacked`` gives the ids of every document back.

Defined results: a null or empty text is the end id alone; rows that share an
id stay separate segments; a null id stays null, and any 64-bit id beside it what
it is; a text of any length is split into pieces of the row width; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, stored, table, with_row_ids
from .tokens import END_ID, Encoder, tokenizer_path

#: Bytes of text that a group stands for; its ids take no more than twice that, mostly half.
GROUP_BYTES = 16 << 20
WIDTH, PAD_ID, DTYPE = 4096, 0, "<u2"
SCHEMA = "row_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class CapacityTree:
    """Segment tree over remaining capacities 0..top: which capacities some open row has."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Capacity and row of the tightest row with at least ``need`` left, taken out; or None."""
        some, i = self.some, need + self.size
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            while i and not (i < self.size and (some[2 * i] or some[2 * i + 1])):
                some[i] = 0
                i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of piece numbers."""
    tree, rows = CapacityTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = width, len(rows)
            rows.append([])
        left, row = found
        rows[row].append(i)
        if left > lengths[i]:
            tree.add(left - lengths[i], row)
    return rows


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, width: int, dtype: str, groups: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for b in slices(batches):
        grp, docs, pieces, data, rids = [], [], [], [], []
        ids = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
        for (doc, rid), tokens in zip(ids, encoder.encode(b.column(1).to_pylist()), strict=True):
            whole = np.append(tokens, END_ID)
            if whole.max() > np.iinfo(dtype).max:
                raise ValueError(f"ids do not fit {dtype}")
            for i, start in enumerate(range(0, len(whole), width)):
                # by row number and piece: the same group on every retry, whatever order rows come in
                grp.append(xxhash.xxh64_intdigest(struct.pack("<qi", rid, i)) % groups)
                docs.append(doc)
                pieces.append(i)
                rids.append(rid)
                data.append(whole[start : start + width].astype(dtype).tobytes())
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((grp, docs, pieces, data, rids), types, strict=True)], ["grp", "doc_id", "piece", "ids", "rid"])
    del encoder
    release()


def _assemble(t: pa.Table, width: int, dtype: str) -> pa.Table:
    """In Arrow throughout, where a 64-bit id beside a null one stays what it is."""
    size = np.dtype(dtype).itemsize
    t = t.sort_by([("rid", "ascending"), ("piece", "ascending")])
    doc_ids, pieces, parts, first = t.column("doc_id").to_pylist(), t.column("piece").to_pylist(), t.column("ids").to_pylist(), t.column("grp")[0].as_py() << 32
    lengths = [len(x) // size for x in parts]
    out = []
    for r, members in enumerate(best_fit_decreasing(lengths, width)):
        ends = np.cumsum([lengths[i] for i in members]).tolist()
        pad = np.full(width - ends[-1], PAD_ID, dtype).tobytes()
        ids = b"".join(parts[i] for i in members) + pad
        out.append((first + r, ends[-1], [doc_ids[i] for i in members], [pieces[i] for i in members], [0, *ends], [0, *ends[:-1]], ids))
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary())
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def packed_matrix(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, dtype: str = DTYPE, group_bytes: int = GROUP_BYTES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of the matrix (SCHEMA)."""
    path = tokenizer or tokenizer_path()
    docs = stored(docs)
    # a text has no more tokens than bytes, and its end id
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    raw = with_row_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), "rid").select("doc_id", "text", "rid")
    tokens = raw.mapInArrow(lambda b: _tokenised(b, path, width, dtype, groups), "grp long, doc_id long, piece int, ids binary, rid long")
    return tokens.groupBy("grp").applyInArrow(lambda t: _assemble(t, width, dtype), SCHEMA)


def position_ids(cu_seqlens: list[int], width: int = WIDTH) -> np.ndarray:
    """Positions from 0 in every segment; 0 in the padding."""
    out = np.zeros(width, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def unpacked(rows: DataFrame, dtype: str = DTYPE) -> pd.DataFrame:
    """doc_id (objects, so that 64-bit ids beside null ones stay what they are), piece, ids: every segment of a matrix small enough for the driver."""
    out = []
    for r in rows.select("doc_ids", "pieces", "cu_seqlens", "input_ids").collect():
        ids = np.frombuffer(r.input_ids, dtype)
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            out.append((doc, piece, ids[a:b]))
    made = pd.DataFrame(out, columns=["doc_id", "piece", "ids"], dtype=object)
    return made.astype({"piece": "int64"})


def write_matrix(rows: DataFrame, path: str) -> None:
    """The matrix as Parquet: one binary row each, in order of row id within a file."""
    rows.sortWithinPartitions("row_id").write.parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrix(table(spark, sf_dir, "documents"))
