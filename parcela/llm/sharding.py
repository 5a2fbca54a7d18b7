"""Sharding by fixed virtual slots (native: DataFrame functions only).

Records are hashed into a fixed number of virtual slots. Bytes are summed for
each slot, and a versioned map from slots to shards is built from these sums,
largest slot first to the least loaded shard. The map is kept: ``save_map``
writes each version to a folder of its own under the map's folder, and
``shard_documents`` starts from the newest version there. Rebalancing edits the
map: a new version keeps each slot where it is unless its shard is over the new
mean, so that only the excess moves. The map has ``n_slots`` rows whatever the input,
which bounds what is broadcast and what one task folds.

A record's slot follows its id, checksum and size, so that copies of a text,
which have ids of their own, and rows that share an id are spread over all
slots; rows without an id are spread by their number in the stored table. Only
rows that are the same in all three share a slot.

Defined results: a null text has size 1 and checksum 0; repeated rows each get a
place of their own; an empty table gives an empty result and an empty map; extra
columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table, with_row_ids, written

N_SLOTS = 4096


def slot_of(*cols: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, size_col: str = "size", slot_col: str = "vslot") -> DataFrame:
    """vslot, bytes, n: at most ``n_slots`` rows."""
    return records.groupBy(slot_col).agg(F.sum(size_col).alias("bytes"), F.count("*").alias("n"))


def _heaviest_first(loads: DataFrame, *extra: str) -> DataFrame:
    order = F.struct((-F.col("bytes")).alias("o"), F.col("vslot").alias("vslot"), F.col("bytes").alias("bytes"), *extra)
    return loads.agg(F.array_sort(F.collect_list(order)).alias("slots"))


def _least(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def _added(loads: Column, at: Column, more: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == at, x + more).otherwise(x))


def build_map(loads: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """version, vslot, bytes, shard: each slot, heaviest first, to the shard with the fewest bytes."""

    def step(acc, x):
        j = _least(acc["loads"])
        return F.struct(_added(acc["loads"], j, x["bytes"]).alias("loads"), F.concat(acc["to"], F.array(j)).alias("to"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("to"))
    folded = _heaviest_first(loads).select("slots", F.aggregate("slots", start, step)["to"].alias("to"))
    pairs = folded.select(F.explode(F.arrays_zip("slots", "to")).alias("p"))
    return pairs.select(F.lit(version).alias("version"), F.col("p.slots.vslot").alias("vslot"), F.col("p.slots.bytes").alias("bytes"), F.col("p.to").alias("shard"))


def rebalance(old: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map: slots stay unless their shard is over the mean load or gone; the rest go to the least loaded shards."""
    now = loads.join(old.select("vslot", "version", F.col("shard").alias("was")), "vslot", "left")
    version = F.coalesce(F.max("version"), F.lit(0)).alias("version")
    order = F.struct((-F.col("bytes")).alias("o"), F.col("vslot").alias("vslot"), F.col("bytes").alias("bytes"), F.col("was").alias("was"))
    all_slots = now.agg(F.array_sort(F.collect_list(order)).alias("slots"), version, F.ceil(F.sum("bytes") / n_shards).alias("mean"))

    def keep(acc, x):
        stays = (x["was"] < n_shards) & (F.coalesce(F.get(acc["loads"], x["was"]), F.lit(0)) + x["bytes"] <= acc["mean"])
        to = F.when(F.coalesce(stays, F.lit(False)), x["was"]).otherwise(F.lit(-1))
        return F.struct(_added(acc["loads"], to, x["bytes"]).alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"), acc["mean"].alias("mean"))

    def place(acc, p):
        j = F.when(p["to"] >= 0, p["to"]).otherwise(_least(acc["loads"]))
        more = F.when(p["to"] >= 0, F.lit(0)).otherwise(p["slots"]["bytes"])
        return F.struct(_added(acc["loads"], j, more).alias("loads"), F.concat(acc["to"], F.array(j)).alias("to"))

    empty = F.array().cast("array<int>").alias("to")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), empty, F.col("mean").alias("mean"))
    kept = all_slots.select("slots", "version", F.aggregate("slots", start, keep).alias("k"))
    zipped = kept.select("slots", "version", F.arrays_zip("slots", F.col("k.to").alias("to")).alias("z"), F.col("k.loads").alias("loads"))
    placed = zipped.select("slots", "version", F.aggregate("z", F.struct("loads", empty), place)["to"].alias("to"))
    pairs = placed.select("version", F.explode(F.arrays_zip("slots", "to")).alias("p"))
    return pairs.select((F.col("version") + 1).alias("version"), F.col("p.slots.vslot").alias("vslot"), F.col("p.slots.bytes").alias("bytes"), F.col("p.to").alias("shard"))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Writes a version (one number in column ``version``) to its folder; a version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is not None:
        slot_map.write.mode("error").parquet(f"{folder.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A stored version, the newest by default; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    names = [f.getPath().getName() for f in store.listStatus(path)]
    known = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
    if not known or (version is not None and version not in known):
        return None
    return spark.read.schema("version int, vslot int, bytes long, shard int").parquet(f"{folder.rstrip('/')}/version={known[-1] if version is None else version}")


def shard_documents(
    docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, text_col: str = "text", id_col: str = "doc_id", map_folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records with their shard and a place in it, gapless from 0; and the stored map.

    Version 1 is built where ``map_folder`` holds no map, else the newest one is
    rebalanced to the loads and ``n_shards``; a version that changes nothing is
    not stored.
    """
    spark = docs.sparkSession
    folder = map_folder or f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/slot_map-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = stored(docs).select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    records = with_row_ids(records, "rid")
    by_id, by_row = slot_of("doc_id", "text_crc32", "size", n_slots=n_slots), slot_of("rid", n_slots=n_slots)
    records = written(records.withColumn("vslot", F.when(F.col("doc_id").isNull(), by_row).otherwise(by_id)), "records")
    loads = written(slot_loads(records), "loads")
    old = load_map(spark, folder)
    new = written(build_map(loads, n_shards) if old is None else rebalance(old, loads, n_shards), "slot_map")
    if old is None or new.join(old, ["vslot", "shard", "bytes"], "left_anti").limit(1).count() or old.count() != new.count():
        save_map(new, folder)
    slot_map = load_map(spark, folder)
    slot_map = new if slot_map is None else slot_map
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(loads.select("vslot", "n"), "vslot").select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "rid"))
    # the map has n_slots rows at most, so its broadcast is bounded by that parameter
    placed = records.withColumn("rn", within).join(F.broadcast(starts), "vslot")
    return placed.withColumn("slot", (F.col("start") + F.col("rn") - 1).cast("long")), slot_map


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
