"""Homomorphic multiset fingerprints of documents (native: DataFrame functions only).

A document is the multiset of its paragraphs (its lines). Each paragraph is
hashed to a wide vector; a document's fingerprint is the sum of the vectors of
its paragraphs, lane by lane, modulo 2^32:

* ``N_IDENT`` identity lanes, hashed from the whole paragraph, for equality
  whatever the order of the paragraphs;
* ``N_LANES`` likeness lanes, to each of which every three-word shingle of the
  paragraph adds 1 or -1 by a bit of its hash, so that the cosine of two
  fingerprints follows the share of wording in common (its standard error is
  about ``N_LANES ** -0.5``).

Sums commute, so paragraphs may be inserted or deleted by ``combined`` without
reading the rest of the document.

The next document is found on narrow rows (id, length, hash, row number), sorted
over all tasks; what is shuffled of the texts is each text once, by row number,
and of its successor's only the part that the edit takes. So no group of rows
is larger than one text, however ids repeat. Lanes are added eight at a time, as
bytes of one long, over chunks of ``CHUNK`` shingles, and then two at a time, as
halves of one long, which hold any text of under 2^31 shingles.

Defined results: a null text is the empty text, whose fingerprint is that of
one empty paragraph; likeness is 1 for equal fingerprints, else the cosine of
the likeness lanes cut to 0..1 (0 where one of them is all zero). Rows that
share an id follow each other in the order of length, hash and row number; null
ids come last. A lone document is its own next. An empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, stored, table, with_row_ids, written

N_LANES, N_IDENT, SHINGLE = 128, 8, 3
MODULUS = 2**32
#: Shingles in a chunk: as many as a byte holds without a sign.
CHUNK = 127
BYTES, HALVES, LOW = 0x0101010101010101, 0x000000FF000000FF, 0xFFFFFFFF


def successors(rows: DataFrame) -> DataFrame:
    """From rows (rid, doc_id, n, h): rid, doc_id, n, next_rid; the next in descending id, nulls last, the first after the last.

    Sorted by range over all tasks and written; then each part finds its own
    successors and the head of the next part, of which there are as many as parts.
    """
    rows = rows.withColumn("none", F.col("doc_id").isNull()).withColumn("key", F.bitwise_not(F.coalesce("doc_id", F.lit(0))))
    order = ["none", "key", "n", "h", "rid"]
    parts = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    heads = parts.groupBy("part").agg(F.min_by("rid", F.struct(*order)).alias("head"))
    one = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(one), F.first("head").over(one)).alias("head"))
    inside = F.lead("rid").over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("next_rid", inside).join(F.broadcast(heads), "part").select("rid", "doc_id", "n", F.coalesce("next_rid", "head").alias("next_rid"))


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """rid, doc_id, t, n (code points), next_rid, prefix (what the edit takes of the next text), own (code points that stay): a row for each row of ``docs``."""
    rows = stored(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = with_row_ids(rows, "rid")
    after = written(successors(rows.select("rid", "doc_id", F.length("t").alias("n"), F.xxhash64("t").alias("h"))), "successors")
    half = F.floor(F.col("n") / 2).cast("int")
    # each text learns whose next it is and how much of it that one takes; then its shuffle by row number serves both uses
    taken = after.select(F.col("next_rid").alias("rid"), F.col("rid").alias("to_rid"), half.alias("take"))
    known = rows.select("rid", "t").join(after.join(taken.hint("merge"), "rid").hint("merge"), "rid")
    prefix = known.select(F.col("to_rid").alias("rid"), F.expr("substring(t, 1, take)").alias("prefix"))
    whole = known.select("rid", "doc_id", "t", "n", "next_rid", "to_rid", "take").join(prefix.hint("merge"), "rid")
    return whole.select("rid", "doc_id", "t", "n", "next_rid", "prefix", (F.col("n") - half).alias("own"))


def _shingles(paragraph: Column) -> Column:
    """A hash for each three-word shingle; a shorter paragraph is one shingle, a blank one none."""

    def hashes(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(words) - SHINGLE)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))

    trimmed = F.trim(paragraph, F.lit(SPACE_CHARS))
    # bound by an outer transform, else the split would run again for every shingle
    found = F.get(F.transform(F.array(F.split(trimmed, SPACE)), hashes), F.lit(0))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(found)


def _identity(paragraphs: Column) -> Column:
    """The identity lanes of an array of paragraphs."""

    def lane(i: int, high: bool) -> Column:
        half = lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(i), p), 32) if high else F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(LOW))
        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda s, p: F.pmod(s + half(p), F.lit(MODULUS)))

    return F.array(*[lane(i, high) for i in range(N_IDENT // 2) for high in (False, True)])


def _fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, fp: from rows (keys, paragraphs); a zero vector where there are none."""
    rows = texts.select(*keys, _identity(F.col("paragraphs")).alias("ident"), F.flatten(F.transform("paragraphs", _shingles)).alias("hs"))
    rows = rows.select(*keys, "ident", F.posexplode_outer("hs").alias("pos", "h0")).withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    # how many shingles of a chunk have each bit set in their hash, and in a second one: eight lanes in the bytes of one long
    words, bits = range(N_LANES // 64), range(32)
    ones = [F.sum(F.shiftrightunsigned(f"h{w}", i).bitwiseAND(F.lit(BYTES))).alias(f"c{w}_{i}") for w in words for i in range(8)]
    chunks = rows.groupBy(*keys, "ident", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.count("h0").alias("k"), *ones)
    # then of the text: bit i in the low half and bit i + 32 in the high half of one long
    halves = [F.sum(F.shiftrightunsigned(f"c{w}_{i % 8}", i - i % 8).bitwiseAND(F.lit(HALVES))).alias(f"s{w}_{i}") for w in words for i in bits]
    sums = chunks.groupBy(*keys, "ident").agg(F.sum("k").alias("k"), *halves)
    at = [(w, i) for w in words for i in bits]
    low = [_centred(2 * F.coalesce(f"s{w}_{i}", F.lit(0)).bitwiseAND(F.lit(LOW)) - F.col("k")) for w, i in at]
    high = [_centred(2 * F.shiftrightunsigned(F.coalesce(f"s{w}_{i}", F.lit(0)), 32) - F.col("k")) for w, i in at]
    return sums.select(*keys, F.struct(F.array(*low, *high).alias("lanes"), "ident").alias("fp"))


def _centred(x: Column) -> Column:
    """Modulo 2^32, as -2^31..2^31-1."""
    return F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Of two structs (lanes, ident): 1 if equal, else the cosine of their likeness lanes, cut to 0..1."""
    norm = F.sqrt(_dot(a["lanes"], a["lanes"])) * F.sqrt(_dot(b["lanes"], b["lanes"]))
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(_dot(a["lanes"], b["lanes"]), norm)))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(cosine)


def as_hex(fp: Column) -> Column:
    """Eight digits for each lane, identity lanes first."""
    lanes = F.concat(fp["ident"], F.transform(fp["lanes"], lambda x: F.pmod(x, F.lit(MODULUS))))
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (sign -1)."""
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: _centred(x + sign * y)).alias("lanes"),
        F.zip_with(a["ident"], b["ident"], lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS))).alias("ident"),
    )


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_chars, edited_sha256 and the structs own, edited, next."""
    base = with_next(docs, text_col, id_col)
    stays = F.substring(F.col("t"), F.lit(1), F.col("own"))
    edited = F.concat(stays, "prefix")
    same = F.size(F.split(stays, "\n")) - 1  # paragraphs that the edit leaves as they are
    texts = base.select("rid", "doc_id", "n", "next_rid", F.unhex(F.sha2(edited, 256)).alias("sha"), same.alias("m"), F.split("t", "\n").alias("p"), F.split(edited, "\n").alias("q"))
    slices = [F.slice("p", F.lit(1), F.col("m")), F.slice("p", F.col("m") + 1, F.size("p")), F.slice("q", F.col("m") + 1, F.size("q"))]
    texts = texts.select("rid", "doc_id", "n", "next_rid", "sha", F.posexplode(F.array(*slices)).alias("v", "paragraphs"))
    # partitioned by row number since the joins: no further shuffle until the next document's fingerprint is looked up
    each = _fingerprints(texts, "rid", "doc_id", "n", "next_rid", "sha", "v")
    parts = [F.max(F.when(F.col("v") == v, F.col("fp"))).alias(f"f{v}") for v in range(3)]
    both = each.groupBy("rid", "doc_id", "n", "next_rid", "sha").agg(*parts)
    # sums of what both texts share and of what each has alone
    both = both.select("rid", "doc_id", "n", "next_rid", "sha", *[combined(F.col("f0"), F.col(f"f{v}")).alias(name) for v, name in ((1, "own"), (2, "edited"))])
    done = written(both, "fingerprints")
    nxt = done.select(F.col("rid").alias("next_rid"), F.col("own").alias("next"))
    return done.join(nxt.hint("merge"), "next_rid").select("doc_id", F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), "own", "edited", "next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(table(spark, sf_dir, "documents"))
    own, edited, nxt = F.col("own"), F.col("edited"), F.col("next")
    return f.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(own).alias("fingerprint"), as_hex(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, nxt).alias("near_next"),
    )
