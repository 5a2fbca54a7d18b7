"""Near-duplicates by MinHash, banding, verification and connected components.

1. Each text is reduced to its set of word shingles (64-bit hashes), and the
   set to ``BANDS * ROWS`` minima of universal hash functions. Documents with
   equal sets form a class; one of each class goes on.
2. Classes that agree in all ``ROWS`` minima of a band share a bucket (a pair at
   the threshold misses all bands with a probability of about 3e-5). Buckets are
   linked as stars to their least member, never as pairs, and each edge of a
   star is checked on the signatures: it holds if the estimate is no more than
   six standard deviations under the threshold. So chance buckets, as of a shared
   template, join nothing. Members of buckets that the edges that hold don't join
   to one component get buckets of another kind: by each of the rarest shingles
   of their set, as many as any set that is similar enough must meet one of, an
   exact bound. A template's shingles are common and fall out. Of these buckets
   those that are still apart are searched whole, signatures alone; those over
   ``BUCKET_DOCS`` in pairs of blocks.
3. The components of these edges are groups. Each group is searched for links
   between different components, confirmed on the full sets. A link joins two
   components, so that a large group of copies costs few confirmations and gives
   at most one link for each class. Groups over ``BLOCK_DOCS`` classes or
   ``BLOCK_BYTES`` of sets are dealt into blocks, and every pair of blocks is
   searched by a task of its own; nothing is capped. Only texts of group members
   are read into this step, and its tasks are dealt by bytes.
4. The links' components, by alternating large-star and small-star, are the
   result.

Defined results: a null, empty or blank text has no shingles and is linked with
nothing; a text with fewer words than a shingle is one shingle; repeated rows
are linked as copies; null ids rank after all others; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, fresh, release, sized, slices, small_batches, stored, table, with_row_ids, without_rows, written
from .components import components
from .wordhash import SPACE, P, WordHasher, mix

BANDS, ROWS = 56, 8
BLOCK_DOCS, BLOCK_BYTES = 512, 8 << 20
BUCKET_DOCS = 2048
PERCENT = 80
CHUNK = 2048
GROUP_TEXT = 1 << 20
#: Texts from which common shingles are counted, and how many of these a task holds.
COMMON_DOCS, COMMON_SHINGLES = 2048, 500_000
log = logging.getLogger(__name__)


class Shingler:
    """Shingle sets of UTF-8 texts, computed over whole groups of texts at a time."""

    def __init__(self, words: int, separators: np.ndarray = SPACE):
        self.words, self.hasher = words, WordHasher(separators)
        rng = np.random.default_rng(1)
        self.coef = rng.integers(1, 2**63, words + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word."""
        starts, ends = self.hasher.bounds(data)
        return self.hasher.hashes(data, starts, ends), starts

    def _group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        h, at = self.word_hashes(data)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(at, bounds)
        k, c = self.words, self.coef
        with np.errstate(over="ignore"):
            full = h[: max(0, len(h) - k + 1)] * c[0]
            for j in range(1, k):
                full = full + h[j : j + len(full)] * c[j]
            full = mix(full)
            for a, b in zip(first[:-1], first[1:], strict=True):
                n = b - a
                if n >= k:
                    yield np.unique(full[a : b - k + 1])
                elif n:
                    yield mix((h[a:b] * c[:n]).sum(keepdims=True) + c[k] * np.uint64(n))
                else:
                    yield np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        group, size = [], 0
        for t in texts:
            group.append(t or b"")
            size += len(group[-1])
            if size >= GROUP_TEXT:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


class MinHasher:
    """Minima of BANDS * ROWS universal hash functions a*x+b modulo 2^32, a odd."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.coef = rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), CHUNK):
            np.minimum(out, (self.a * x[None, i : i + CHUNK] + self.b).min(1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, other keys for other bands."""
        with np.errstate(over="ignore"):
            s = (minima.reshape(BANDS, ROWS).astype(np.uint64) * self.coef).sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(P)
        return mix(s)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler, hasher = Shingler(words), MinHasher()
    for b in slices(batches):
        counts, prints, bands, signatures = [], [], [], []
        for s in shingler.sets(b.column(2).to_pylist()):
            counts.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            minima = hasher.minima(s)
            bands.append(hasher.bands(minima).view(np.int64) if len(s) else np.zeros(0, np.int64))
            signatures.append(minima.astype(np.uint8).tobytes())  # the lowest byte of each minimum
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(signatures, pa.binary()),
            ],
            ["rid", "doc_id", "n", "print", "bands", "sig"],
        )
    release()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler, hasher = Shingler(words), MinHasher()
    for b in slices(batches):
        sets, signatures = [], []
        for s in shingler.sets(b.column(1).to_pylist()):
            sets.append(s.tobytes())
            signatures.append(hasher.minima(s).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], ["rid", "grp", "nb", "shingles", "sig"]
        )
    release()


def needed(percent: int, k: int = BANDS * ROWS) -> float:
    """How many of k signature bytes a pair must share to be looked at: six deviations under the threshold; bytes also agree by chance."""
    t = percent / 100
    floor = t - 6 * np.sqrt(t * (1 - t) / k)
    return k * (floor + (1 - floor) / 256)


def _search(rids, blocks, sizes, signatures, percent: int, cross: bool, root, confirmed=lambda i, j: True) -> list[tuple[int, int]]:
    """Links that join components (``root``), between members of one group (of different blocks only, if ``cross``)."""
    n, t, least = len(rids), percent / 100, needed(percent, signatures.shape[1])
    links = []
    for i in range(n - 1):
        rest = np.flatnonzero((root[i + 1 :] != root[i]) & (sizes[i + 1 :] >= t * sizes[i]) & (t * sizes[i + 1 :] <= sizes[i])) + i + 1
        if cross:
            rest = rest[blocks[rest] != blocks[i]]
        if not len(rest):
            continue
        same = (signatures[rest] == signatures[i]).sum(1)
        for j in rest[np.argsort(-same, kind="stable")][: int((same >= least).sum())]:
            if root[j] != root[i] and confirmed(i, j):
                links.append((int(rids[i]), int(rids[j])))
                root[root == root[j]] = root[i]
    return links


def _matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)


def _links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links confirmed on the full sets."""
    out = []
    for (_, b0, b1), g in pdf.groupby(["grp", "b0", "b1"], sort=True):
        g = g.sort_values("rid")
        sets = [np.frombuffer(s, np.uint64) for s in g.shingles]
        sizes = np.array([len(s) for s in sets])

        def confirmed(i: int, j: int, sets=sets, sizes=sizes) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return 100 * both >= percent * (sizes[i] + sizes[j] - both)

        out += _search(g.rid.to_numpy(), g.block.to_numpy(), sizes, _matrix(g.sig), percent, b0 != b1, np.arange(len(g)), confirmed)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _likely(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges between components of a bucket, on signatures alone."""
    out = []
    for (_, b0, b1), g in pdf.groupby(["band", "b0", "b1"], sort=True):
        g = g.sort_values("rid")
        root = np.unique(g.label.to_numpy(), return_inverse=True)[1]
        out += _search(g.rid.to_numpy(), g.block.to_numpy(), g.n.to_numpy(), _matrix(g.sig), percent, b0 != b1, root)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, rid, nb, ...) once for each pair of the group's blocks that their own is part of, and block, b0, b1."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumn("b0", F.least("block", "other")).withColumn("b1", F.greatest("block", "other")).drop("other", "nb")


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """rid, band: of each text's shingles the rarest ones, as many as must hold one that a linked text's rarest ones hold too."""
    shingler, (keys, counts) = Shingler(words), common
    for b in slices(batches):
        rids, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rid, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1).to_pylist()), strict=True):
            x = s.view(np.int64)
            seen = np.zeros(len(x), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                seen = np.where(keys[at] == x, counts[at], 0)
            first = x[np.lexsort((x, seen))[: len(x) - -(-percent * len(x) // 100) + 1]]
            rids.append(np.full(len(first), rid))
            bands.append(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids)), pa.array(np.concatenate(bands))], ["rid", "band"])
    release()


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(words)
    for b in slices(batches):
        for s in shingler.sets(b.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])
    release()


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of at most COMMON_DOCS texts (rid, text) hold, sorted, and of how many; COMMON_SHINGLES at most.

    They only make prefixes selective: whatever the order of shingles, linked sets share one among their prefixes.
    """
    some = texts.orderBy(F.xxhash64("rid"), "rid").limit(COMMON_DOCS).select("text")
    counts = some.mapInArrow(lambda b: _shingles(b, words), "s long").groupBy("s").agg(F.count("*").alias("k")).filter("k > 2")
    found = counts.orderBy(F.desc("k"), "s").limit(COMMON_SHINGLES).toArrow().sort_by("s")
    return found.column("s").to_numpy(), found.column("k").to_numpy()


def likely_edges(signed: DataFrame, reps: DataFrame, raw: DataFrame, words: int, percent: int, temporary: list[DataFrame]) -> DataFrame:
    """Edges (a, b) whose components are the groups: pairs that share a bucket and whose signatures agree enough."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        temporary.append(written(df, label))
        return temporary[-1]

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_matrix(list(x)) == _matrix(list(y))).sum(1) if len(x) else [], dtype="int32")

    def labelled(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
        by = labels.select(F.col("rid").alias(column), F.col("label").alias(out))
        return df.join(sized(by), column, "left").withColumn(out, F.coalesce(out, column))

    def starred(banded: DataFrame, known: DataFrame | None):
        """All edges so far; (band, rid, label) of the buckets whose members they don't join; (band, k) of these; signatures."""
        # merge joins where no side has a bound
        buckets = keep(banded.groupBy("band").agg(F.min("rid").alias("least"), F.count("*").alias("k")).filter("k > 1"), "buckets")
        members = keep(banded.join(buckets.hint("merge"), "band").filter("rid <> least").select("band", "rid", "least", "k"), "members")
        stars = keep(members.select("rid", "least").distinct(), "stars")
        ends = keep(stars.select(F.explode(F.array("rid", "least")).alias("rid")).distinct(), "ends")
        prints = keep(signed.select("rid", "n", "sig").join(sized(ends), "rid", "left_semi"), "signatures")
        a, b = (prints.select(*[F.col(c).alias(f"{c}_{x}") for c in prints.columns]) for x in "ab")
        pairs = stars.join(a.hint("merge"), F.col("rid") == F.col("rid_a")).join(b.hint("merge"), F.col("least") == F.col("rid_b"))
        pairs = pairs.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (agree("sig_a", "sig_b") >= float(needed(percent))))
        edges = keep(pairs.select(F.col("rid").alias("a"), F.col("least").alias("b")), "edges")
        edges = edges if known is None else known.unionByName(edges)
        labels = keep(components(edges).withColumnsRenamed({"node": "rid", "root": "label"}), "labels")
        apart = labelled(labelled(members, labels, "rid", "label"), labels, "least", "least_label").filter("label <> least_label")
        open_bands = keep(apart.select("band", "least", "k").distinct(), "open")
        inside = members.select("band", "rid").join(sized(open_bands.select("band")), "band", "left_semi").unionByName(open_bands.select("band", F.col("least").alias("rid")))
        return edges, labelled(inside, labels, "rid", "label"), open_bands, prints

    banded = signed.select("rid", "bands").join(reps.hint("merge"), "rid", "left_semi").select("rid", F.explode("bands").alias("band"))
    edges, inside, open_bands, _ = starred(banded, None)
    if not open_bands.limit(1).count():
        return edges
    # what shares a bucket by chance, or by a template, is told apart by its rarest shingles
    apart = keep(inside.select("rid").distinct(), "apart")
    texts = raw.select("rid", "text").join(sized(apart), "rid", "left_semi")
    common = raw.sparkSession.sparkContext.broadcast(common_shingles(texts, words))
    with small_batches(raw.sparkSession):
        prefixes = keep(texts.mapInArrow(lambda b: _prefixes(b, words, percent, common.value), "rid long, band long"), "prefixes")
    edges, inside, open_bands, prints = starred(prefixes, edges)
    k = F.col("k").cast("double")
    rows, pairs, n = open_bands.agg(F.coalesce(F.sum(F.col("k") * F.ceil(F.col("k") / BUCKET_DOCS)), F.lit(0)), F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0.0)), F.count("*")).first()
    log.info("%s buckets are searched whole, %d pairs", n, pairs)
    if not rows:
        return edges
    inside = inside.join(prints.hint("merge"), "rid").join(sized(open_bands.select("band", F.ceil(F.col("k") / BUCKET_DOCS).cast("int").alias("nb"))), "band")
    dealt = _in_blocks(inside, "band").withColumn("bin", F.pmod(F.xxhash64("band", "b0", "b1"), F.lit(max(1, -(-rows // BUCKET_DOCS)))))
    more = dealt.groupBy("bin").applyInPandas(lambda pdf: _likely(pdf, percent), "a long, b long")
    return edges.unionByName(keep(more, "more_edges"))


def near_duplicates(docs: DataFrame, words: int, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: rid (row number of the stored table), doc_id, n_shingles, component_id, keep_rid."""
    temporary: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        temporary.append(written(df, label))
        return temporary[-1]

    raw = stored(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    raw = with_row_ids(raw, "rid").select("rid", "doc_id", "text")
    with small_batches(docs.sparkSession):
        signed = written(raw.mapInArrow(lambda b: _signed(b, words), "rid long, doc_id long, n long, print binary, bands array<long>, sig binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    classes = keep(signed.filter("n > 0").groupBy("print").agg(first), "classes").select("print", "first", F.col("first.rid").alias("rep"))
    edges = likely_edges(signed, classes.select(F.col("rep").alias("rid")), raw, words, percent, temporary)
    groups = keep(components(edges).select(F.col("node").alias("rid"), F.col("root").alias("grp")), "groups")
    weight = signed.select("rid", "n").join(sized(groups), "rid").groupBy("grp").agg(F.count("*").alias("docs"), (F.sum("n") * 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    weight = keep(weight.withColumn("nb", blocks), "weight")
    groups = keep(groups.join(weight.select("grp", "nb"), "grp"), "sized")
    moved = weight.agg(F.coalesce(F.sum((F.col("bytes") + BANDS * ROWS * F.col("docs")) * F.col("nb")), F.lit(0))).first()[0]
    bins = max(1, -(-moved // BLOCK_BYTES))
    # of all texts, only those of group members go on
    searched = raw.select("rid", "text").join(sized(groups), "rid").select("rid", "text", "grp", "nb")
    sets = searched.mapInArrow(lambda b: _sets(b, words), "rid long, grp long, nb int, shingles binary, sig binary")
    dealt = _in_blocks(sets, "grp").withColumn("bin", F.pmod(F.xxhash64("grp", "b0", "b1"), F.lit(bins)))
    links = dealt.groupBy("bin").applyInPandas(lambda pdf: _links(pdf, percent), "a long, b long")
    with small_batches(docs.sparkSession):
        links = keep(links, "links")
    roots = keep(components(links).withColumnRenamed("node", "rep"), "roots")
    labelled = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = keep(labelled.groupBy("root").agg(F.min("first").alias("least")), "least")
    labelled = written(labelled.join(least, "root").select("print", "least"), "labelled")
    for t in temporary:
        drop_written(t)
    out = signed.select("rid", "doc_id", "n", "print").join(labelled.hint("merge"), "print", "left")
    alone = F.col("n") == 0
    return out.select(
        "rid", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(alone, F.col("rid")).otherwise(F.col("least.rid")).alias("keep_rid"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns."""
    docs = stored(docs)
    return without_rows(docs, fresh(docs, "rid"), near_duplicates(docs, words, percent, text_col, id_col).filter("rid <> keep_rid"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return d.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, counted on whole sets; classes of equal sets first, so that copies stay few rows.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 3) END)) AS i FROM w),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS s FROM i),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id),
class AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k),
cs AS (SELECT doc_id AS rep, s FROM sh WHERE doc_id IN (SELECT rep FROM class)),
inter AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m FROM cs a JOIN cs b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM inter JOIN class x ON x.rep = a JOIN class y ON y.rep = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
arc AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT r.a, arc.b FROM reach r JOIN arc ON arc.a = r.b),
least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id, coalesce(least.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets ON sets.doc_id = w.doc_id LEFT JOIN class ON class.k = sets.k LEFT JOIN least ON least.rep = class.rep
"""
