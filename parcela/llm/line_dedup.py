"""Line dedup by probing a sharded minimal perfect hash.

The keys of all lines are hashed to 128 bits. Every distinct hash is dealt into
a shard by its high bits; each shard builds a minimal perfect hash (levels of
bit vectors with ranks) over its distinct hashes, which indexes compact arrays:
fingerprints (32 bits), counts of documents (8 bits, cut at 255), and the last
document id of the keys that reach ``min_docs``. Documents then probe these
arrays, and the counts found there decide: no line is joined.

The arrays lie as files in the shared folder, in units of at most about
``batch_bytes``. A task holds its rows compressed, beside the hashes of their
lines in order of unit, reads each unit that these need once, one at a time, and
then goes through its rows again with the answers. What it holds is bounded by
``HELD_BYTES``, after which it begins anew, so a task of an ordinary split reads
a unit once, however much text it has. The documents are scanned once. What all
tasks read together is their number times the arrays' size (some 6 bytes a
distinct line), so tasks should be large. A hot line is one key of the arrays
and makes no task heavy.

Defined results: null and empty texts are one empty line; keys under
``min_chars`` code points always stay; a document that repeats a line keeps or
loses all its copies; rows that share an id count as documents of their own,
and all of them keep the line if theirs is the largest id; a null id ranks
below all others; an empty table gives an empty result; arrays that can't be
read, or lack a line, are an error, never lines that stay; further columns pass
through, and a column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, drop_written, folder_of, slices, table, written

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 65536
BATCH_BYTES = 64 << 20
#: A chunk's texts are Python objects at once; a task holds so many bytes of compressed rows, hashes and answers between two readings of the arrays.
CHUNK_BYTES, HELD_BYTES = 8 << 20, 256 << 20
SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
MOST = 255


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """64 bits for each hash (columns of two uint64), another function for each level."""
    with np.errstate(over="ignore"):
        x = h[:, 0] + h[:, 1] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: at each level, keys alone at their place set a bit; the rank of the bit is the index."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.base, rest = 0, keys
        while len(rest):
            m = 64 * max(1, -(-2 * len(rest) // 64))
            at = (_mixed(rest, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            self._add(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]

    def _add(self, words: np.ndarray) -> None:
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.levels.append((words, self.base + np.concatenate([[0], ones[:-1]])))
        self.base += int(ones[-1])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """-1 for what is certainly no key; for other strangers, any index."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            at = _mixed(keys[todo], level) % np.uint64(64 * len(words))
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (ranks[at >> np.uint64(6)] + below)[hit]
            todo = todo[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [words.tobytes() for words, _ in self.levels]

    @classmethod
    def load(cls, parts: list[bytes]) -> PerfectHash:
        out = cls(np.zeros((0, 2), np.uint64))
        for p in parts:
            out._add(np.frombuffer(p, np.uint64))
        return out


class Shard:
    """A perfect hash and its arrays, as read from a row of the arrays' table."""

    def __init__(self, levels: list[bytes], prints: bytes, counts: bytes, last: bytes, min_docs: int):
        self.mph = PerfectHash.load(levels)
        self.prints, self.counts = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint8)
        self.often = self.counts >= min_docs
        self.last, self.rank = np.frombuffer(last, np.int64), np.cumsum(self.often) - 1

    def last_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys of enough documents, and the largest id of those. All must be keys, as every line was indexed."""
        at = self.mph.index(hashes)
        if not ((at >= 0) & (self.prints[np.maximum(at, 0)] == _print(hashes))).all():
            raise RuntimeError("the arrays lack a line of the documents: they aren't those of these documents")
        hit = np.flatnonzero(self.often[at])
        return hit, self.last[self.rank[at[hit]]]


def _keys_of(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, ids = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}
            hashes += map(_hash, found)
            ids += [NO_ID if doc is None else doc] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["h", "id"])


def _pairs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)


def _print(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, 1] >> np.uint64(32)).astype(np.uint32)


def _build(pdf: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """Arrays of one shard. Counts are cut at MOST; last ids are kept for the keys of enough documents, in order of index."""
    keys = _pairs(list(pdf.h))
    mph = PerfectHash(keys)
    order = np.argsort(mph.index(keys))
    counts = np.minimum(pdf.n.to_numpy()[order], MOST).astype(np.uint8)
    last = pdf["last"].to_numpy(np.int64)[order][counts >= min_docs]
    row = {"unit": pdf.unit.iloc[0], "shard": pdf["shard"].iloc[0], "levels": mph.dump(), "prints": _print(keys)[order].tobytes(), "counts": counts.tobytes(), "last": last.tobytes()}
    return pd.DataFrame([row])


KEY_BYTES = 6  # of the arrays, a distinct line


def line_arrays(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, batch_bytes: int = BATCH_BYTES) -> tuple[str, int, int]:
    """The folder with a row of arrays for each shard; the number of shards; and of units (both powers of two)."""
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"counts are kept up to {MOST}")
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    lines = raw.mapInArrow(lambda b: _keys_of(b, min_chars), "h binary, id long")
    distinct = written(lines.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("last")), "lines")
    n, shards, units = distinct.count(), 1, 1
    while shards * shard_keys < n:
        shards *= 2
    while units < shards and units * batch_bytes < n * KEY_BYTES:
        units *= 2
    keyed = distinct.withColumn("shard", F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long") % shards).withColumn("unit", F.col("shard") % units)
    arrays = keyed.groupBy("shard").applyInPandas(lambda pdf: _build(pdf, min_docs), "unit long, shard long, levels array<binary>, prints binary, counts binary, last binary")
    folder = folder_of(arrays, "arrays", "unit")
    drop_written(distinct)
    return folder, shards, units


def _read_unit(folder: str, unit: int) -> list[dict]:
    """Rows of one unit, from the shared folder. A folder that isn't there is an error: units are read for lines that they hold."""
    store, path = pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    files = store.get_file_info(pafs.FileSelector(f"{path}/unit={unit}"))
    rows = []
    for f in files:
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                rows += pq.read_table(source).to_pylist()
    return rows


class Arrays:
    """The units of the arrays, read as they are needed; only the last one stays in memory."""

    def __init__(self, folder: str, shards: int, units: int, min_docs: int):
        self.folder, self.n_shards, self.units, self.min_docs = folder, shards, units, min_docs
        self.unit, self.shards = -1, {}
        self.reads = 0

    def of(self, unit: int) -> dict[int, Shard]:
        if unit != self.unit:
            self.shards = {}
            self.shards = {r["shard"]: Shard(r["levels"], r["prints"], r["counts"], r["last"], self.min_docs) for r in _read_unit(self.folder, unit)}
            self.unit = unit
            self.reads += 1
        return self.shards

    def shard_of(self, pairs: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(pairs).view(">u4").reshape(len(pairs), -1)[:, 0].astype(np.int64) % self.n_shards

    def answer(self, unit: int, pairs: np.ndarray) -> np.ndarray:
        """For hashes of one unit, whether enough documents hold each, and the largest id of those."""
        out, shard = np.zeros(len(pairs), ANSWER), self.shard_of(pairs)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            s = int(shard[part[0]])
            held = self.of(unit).get(s)
            if held is None:
                raise RuntimeError(f"shard {s} of the line arrays is missing in {self.folder}")
            hit, last = held.last_of(pairs[part])
            out["hit"][part[hit]], out["last"][part[hit]] = True, last
        return out


ANSWER = np.dtype([("last", np.int64), ("hit", np.bool_)])


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column(b.schema.get_field_index("text")).to_pylist()]


def _chunk_keys(chunk: list[pa.RecordBatch], min_chars: int) -> list[bytes]:
    """The distinct keys of a chunk that count, in the order in which they first occur."""
    found: dict[bytes, bool] = {}
    for b in chunk:
        for t in _texts(b):
            for k in map(line_key, t.split(b"\n")):
                if k not in found:
                    found[k] = long_enough(k, min_chars)
    return [k for k, long in found.items() if long]


class Chunk:
    """Some rows, compressed, and the hashes of their keys in order of unit."""

    def __init__(self, rows: list[pa.RecordBatch], arrays: Arrays, min_chars: int):
        hashes = _pairs([_hash(k) for k in _chunk_keys(rows, min_chars)])
        unit = arrays.shard_of(hashes) % arrays.units
        self.order = np.argsort(unit, kind="stable").astype(np.int32)
        self.hashes, unit = hashes[self.order], unit[self.order]
        self.units, starts = np.unique(unit, return_index=True)
        self.ends = np.append(starts, len(unit))
        self.answers = np.zeros(len(hashes), ANSWER)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in rows:
                out.write_batch(b)
        self.rows = sink.getvalue()
        self.nbytes = self.rows.size + self.hashes.nbytes + self.order.nbytes + self.answers.nbytes

    def ask(self, arrays: Arrays, unit: int) -> None:
        i = int(np.searchsorted(self.units, unit))
        if i < len(self.units) and self.units[i] == unit:
            part = slice(self.ends[i], self.ends[i + 1])
            self.answers[part] = arrays.answer(unit, self.hashes[part])

    def reduced(self, min_chars: int) -> Iterator[pa.RecordBatch]:
        """The rows again, with the lines that stay."""
        batches = list(pa.ipc.open_stream(self.rows))
        keys = _chunk_keys(batches, min_chars)
        hit = self.answers["hit"]
        last_of = {keys[i]: last for i, last in zip(self.order[hit].tolist(), self.answers["last"][hit].tolist(), strict=True)}
        for b in batches:
            names = b.schema.names
            out, total, dropped = [], [], []
            for doc, t in zip(b.column(names.index("doc_id")).to_pylist(), _texts(b), strict=True):
                me, lines = NO_ID if doc is None else doc, t.split(b"\n")
                kept = [x for x in lines if last_of.get(line_key(x), me) == me]
                out.append(b"\n".join(kept))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            made = {"text": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays(
                [made.get(n, b.column(i)) for i, n in enumerate(names)] + [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
            )


def _chunks(batches: Iterator[pa.RecordBatch], arrays: Arrays, min_chars: int) -> Iterator[Chunk]:
    held, size = [], 0
    for b in slices(batches, size=CHUNK_BYTES):
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield Chunk(held, arrays, min_chars)
            held, size = [], 0
    if held:
        yield Chunk(held, arrays, min_chars)


def _answered(chunks: list[Chunk], arrays: Arrays, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Asks unit by unit for all chunks together, then gives their rows back, each chunk freed after its own."""
    for unit in sorted({int(u) for c in chunks for u in c.units}):
        for c in chunks:
            c.ask(arrays, unit)
    chunks.reverse()
    while chunks:
        yield from chunks.pop().reduced(min_chars)


def _probe(batches: Iterator[pa.RecordBatch], arrays: Arrays, min_chars: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for c in _chunks(batches, arrays, min_chars):
        held.append(c)
        size += c.nbytes
        if size >= HELD_BYTES:
            yield from _answered(held, arrays, min_chars)
            held, size = [], 0
    yield from _answered(held, arrays, min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with text reduced to the lines that stay, and n_lines (before), n_dropped."""
    docs = docs.select(*[c for c, n in zip(columns(docs), docs.columns, strict=True) if n.lower() not in ("n_lines", "n_dropped")])
    folder, shards, units = line_arrays(docs, min_chars, min_docs, shard_keys, batch_bytes)
    arrays = Arrays(folder, shards, units, min_docs)
    kinds, names = {"doc_id": "long", "text": "binary"}, docs.columns
    plain = [n if n in kinds else f"c{i}" for i, n in enumerate(names)]  # any name may come, but not all may go through a grouped map
    out = docs.select(*[c.cast(kinds[n]).alias(n) if n in kinds else c.alias(p) for c, n, p in zip(columns(docs), names, plain, strict=True)])
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL("n_lines long, n_dropped long").fields])
    out = out.mapInArrow(lambda b: _probe(b, arrays, min_chars), schema)
    return out.select(*[F.col("text").cast("string").alias(n) if n == "text" else F.col(p).alias(n) for n, p in zip(names, plain, strict=True)], "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND c.last IS DISTINCT FROM k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL OR c.last IS NOT DISTINCT FROM k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.r
"""
