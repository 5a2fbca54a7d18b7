"""Exact duplicates by deterministic block naming (native: DataFrame functions only).

Every normalised text is cut into blocks of a fixed number of bytes. The
distinct blocks are sorted and named by integers; adjacent pairs of names are
then named in turn, level by level, until one name is left for each document.
A name at a level stands for exactly one sequence of blocks, so two documents
share the identity ``(level, name)`` if and only if their texts are equal.

The sort key of a block is ``(xxhash64, bytes)``. The bytes decide only where
two different blocks share a hash: such blocks are found exactly (a count of
distinct bytes for each hash) and named by their bytes, all others by their
hash alone, so that the bytes of the corpus are shuffled once and never joined.

Defined results: a null text counts as empty and so equals the empty text;
white space alone is one space; repeated rows are separate members of one
group, of which exactly one row is kept; null ids rank after all others; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, fresh, one_space, stored, table, with_row_ids, without_rows, written

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    """Array of binary blocks, one empty block for an empty text."""

    def cut(data: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.length(data) - 1) / size).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))

    # bound by an outer transform, else the text would be normalised again for every block
    return F.get(F.transform(F.array(text.cast("binary")), cut), F.lit(0))


def _names(keys: DataFrame) -> DataFrame:
    """Integer names in sort order for distinct rows; ``keys`` plus ``name``. Written, so that a retry can't renumber."""
    cols = keys.columns
    return written(
        keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()),
        "names",
    )


def identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: rid (row number of the stored table), id, sha (binary), level, name."""
    docs = stored(docs)
    text = one_space(F.coalesce(F.col(text_col), F.lit("")))
    rows = with_row_ids(docs.select(F.col(id_col).alias("id"), text.alias("t")), "rid")
    base = written(
        rows.select(
            "rid", "id", F.unhex(F.sha2("t", 256)).alias("sha"),
            F.transform(_blocks(F.col("t"), block_bytes), lambda b: F.xxhash64(b)).alias("hs"),
        ),
        "blocks",
    )
    blocks = docs.select(F.explode(_blocks(text, block_bytes)).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    counts = written(blocks.distinct().groupBy("h").agg(F.count("*").alias("k")), "hashes")
    # A hash that several different blocks share is no sort key by itself: those blocks are told apart by their bytes.
    clashing = [r.h for r in counts.filter("k > 1").select("h").limit(1).collect()]
    if clashing:
        shared = counts.filter("k > 1").select("h")
        known = blocks.join(shared, "h", "left_semi").distinct().withColumnRenamed("block", "b")
        named = _names(counts.filter("k = 1").select("h", F.lit(None).cast("binary").alias("b")).unionByName(known))
        at = rows.select("rid", F.posexplode(_blocks(F.col("t"), block_bytes)).alias("pos", "block")).select("rid", "pos", F.xxhash64("block").alias("h"), "block")
        plain = at.join(counts.filter("k > 1"), "h", "left_anti").select("rid", "pos", "h", F.lit(None).cast("binary").alias("b"))
        clash = at.join(shared, "h", "left_semi").select("rid", "pos", "h", F.col("block").alias("b"))
        by = named.select(F.col("h").alias("nh"), F.col("b").alias("nb"), "name")
        level = plain.unionByName(clash).join(by, (F.col("h") == F.col("nh")) & F.col("b").eqNullSafe(F.col("nb"))).select("rid", "pos", "name")
    else:
        named = _names(counts.select("h"))
        level = base.select("rid", F.posexplode("hs").alias("pos", "h")).join(named, "h").select("rid", "pos", "name")
    most = base.agg(F.max(F.size("hs"))).first()[0] or 1
    sizes = base.select("rid", F.size("hs").alias("left"))
    level = level.join(sizes, "rid")
    done, levels, k = [], [], 0
    while True:
        level = written(level, f"level{k}")
        levels.append(level)
        done.append(level.filter("left = 1").select("rid", F.lit(k).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (
            level.filter("left > 1")
            .groupBy("rid", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.ceil(F.max("left") / 2).cast("int").alias("left"),
            )
        )
        names = _names(pairs.select("a", "b").distinct())
        levels.append(names)
        level = pairs.join(names, ["a", "b"]).select("rid", "pos", "name", "left")
        most, k = (most + 1) // 2, k + 1
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    out = written(base.select("rid", "id", "sha").join(ends, "rid"), "identities")
    for t in (base, counts, named, *levels):
        drop_written(t)
    return out


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: rid, id, keep_id, keep_rid, group_size, kept, sha."""
    ids = identities(docs, text_col, id_col, block_bytes)
    groups = ids.groupBy("level", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "rid")).alias("first"), F.count("*").alias("group_size")
    )
    groups = written(groups, "groups")  # so that a hot group's rows are a side of the join that can be split
    return ids.join(groups, ["level", "name"]).select(
        "rid", "id", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "sha",
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = stored(docs)
    return without_rows(docs, fresh(docs, "rid"), exact_dedup(docs, text_col, id_col).filter("not kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""
