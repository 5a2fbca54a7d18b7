"""Graph of the units of a text corpus, kept up to date as files of documents arrive.

    python -m jobs.corpus_graph --tables DIR --output DIR --checkpoint DIR [--config jobs/corpus_graph.toml]

A unit is a source within a language; its population is the characters of its
documents. Two units are joined by the number of different lines (at least
``min_chars`` characters, white space stripped at both ends, A-Z lower-cased)
that both hold. The result is a graph as the library's operators take it, at two
levels, so that a corpus can be cut into balanced parts that share few lines.

``documents`` is read as a stream of files that ends when all present files are
read; the checkpoint knows them, so that a run takes only new ones. Each
micro-batch writes three increments, partitions of its own number that a repeated
attempt replaces: ``units`` (documents and characters), ``keys`` (pairs of line
and unit not seen before) and ``edges`` (what these pairs add to the shared
lines). Old texts are never read again; of old lines only those that the batch
holds are looked up, by a join on their hash. The units of a line are a set of
units, never of documents, and lines that go from the same set to the same set
count together before pairs are made.

``graph/kind=…/level=…`` is then summed up from the increments: level 1 are the
languages (quotients), level 2 the units; nodes have unit_a, edges unit_a < unit_b.
A null language or source is called ``none``; a null text has no lines.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, replace_partitions, settings, table
from parcela.operators import hierarchy as H

log = logging.getLogger("jobs.corpus_graph")

SPACES = " \t\n\x0b\x0c\r"
UNITS = "lang string, source string, documents long, characters long, batch long"
KEYS = "key binary, unit string, batch long"
EDGES = "src string, dst string, lines long, batch long"
GRAPH = "unit_a string, unit_b string, documents long, characters long, lines long, kind string, level int"


@dataclass(frozen=True)
class Settings:
    min_chars: int = 20
    files_per_trigger: int = 1000


def unit(lang: str = "lang", source: str = "source"):
    return F.concat_ws("/", lang, source)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """key (16 bytes), unit: the lines of each unit, each once."""
    lines = docs.select(unit().alias("unit"), F.explode(F.split("text", "\n")).alias("line"))
    key = F.translate(F.trim("line", F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = lines.withColumn("line", key).filter(F.char_length("line") >= min_chars)
    return keys.select(F.unhex(F.md5("line")).alias("key"), "unit").distinct()


def added_edges(new: DataFrame, seen: DataFrame) -> DataFrame:
    """src < dst, lines: how many shared lines the pairs ``new`` (key, unit) add to those of ``seen``."""
    old = seen.select("key", "unit").join(new.select("key").distinct(), "key", "left_semi")
    both = old.withColumn("fresh", F.lit(False)).unionByName(new.select("key", "unit").withColumn("fresh", F.lit(True)))
    of = lambda fresh: F.array_sort(F.collect_set(F.when(F.col("fresh") == fresh, F.col("unit"))))
    moves = both.groupBy("key").agg(of(False).alias("before"), of(True).alias("added")).groupBy("before", "added").agg(F.count("*").alias("lines"))
    ends = moves.select("before", "added", "lines", F.explode("added").alias("a"))
    ends = ends.select("lines", "a", F.explode(F.concat("before", F.filter("added", lambda b: b > F.col("a")))).alias("b"))
    return ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("lines").alias("lines"))


def graph(units: DataFrame, edges: DataFrame) -> DataFrame:
    """GRAPH: both levels, from summed increments."""
    nodes = H.with_path(units.withColumn("id", unit()), ["lang", "source"])
    parts = [
        nodes.select(F.col("id").alias("unit_a"), "documents", "characters", F.lit("node").alias("kind"), F.lit(2).alias("level")),
        edges.select(F.col("src").alias("unit_a"), F.col("dst").alias("unit_b"), "lines", F.lit("edge").alias("kind"), F.lit(2).alias("level")),
    ]
    coarse, joined = H.quotient_graph(nodes.select("id", "path", "documents", "characters"), edges, 1)
    parts += [
        coarse.select(F.array_join("path", "/").alias("unit_a"), "documents", "characters", F.lit("node").alias("kind"), F.lit(1).alias("level")),
        joined.select(F.array_join("q1", "/").alias("unit_a"), F.array_join("q2", "/").alias("unit_b"), "lines", F.lit("edge").alias("kind"), F.lit(1).alias("level")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[x.split()[0] for x in GRAPH.split(", ")])


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, s: Settings | None = None) -> DataFrame:
    """Reads new files to their end, waits for the stream, and returns the whole graph as it then stands."""
    s, output = s or Settings(), output.rstrip("/")
    paths = {name: f"{output}/{name}" for name in ("units", "keys", "edges")}
    schemas = {"units": UNITS, "keys": KEYS, "edges": EDGES}
    for name, path in paths.items():  # so that the first batch finds tables
        spark.createDataFrame([], schemas[name]).write.mode("ignore").partitionBy("batch").parquet(path)

    def read(name: str) -> DataFrame:
        return spark.read.schema(schemas[name]).parquet(paths[name])

    def take(batch: DataFrame, number: int) -> None:
        named = batch.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text"))
        units = named.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("characters"))
        replace_partitions(units.withColumn("batch", F.lit(number).cast("long")), paths["units"], "batch")
        seen = lambda: read("keys").filter(F.col("batch") < number)  # noqa: E731  what a repeated attempt left doesn't count
        new = line_keys(named, s.min_chars).join(seen().select("key", "unit"), ["key", "unit"], "left_anti")
        replace_partitions(new.withColumn("batch", F.lit(number).cast("long")), paths["keys"], "batch")
        new = read("keys").filter(F.col("batch") == number)
        replace_partitions(added_edges(new, seen()).withColumn("batch", F.lit(number).cast("long")), paths["edges"], "batch")
        n = read("units").filter(F.col("batch") == number).agg(F.sum("documents")).first()[0]
        log.info("batch %s: read %s documents, %s new pairs of line and unit", number, n or 0, new.count())

    # a pattern that fits this name alone: without one, a stream takes folders only, and a table may be a single file
    pattern = f"{tables.rstrip('/')}/documents.parque[t]"
    stream = spark.readStream.schema(table(spark, tables, "documents").schema).option("maxFilesPerTrigger", s.files_per_trigger).parquet(pattern)
    query = stream.select("lang", "source", "text").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    units = read("units").groupBy("lang", "source").agg(F.sum("documents").alias("documents"), F.sum("characters").alias("characters"))
    edges = read("edges").groupBy("src", "dst").agg(F.sum("lines").alias("lines"))
    replace_partitions(graph(units, edges), f"{output}/graph", "kind", "level")
    out = spark.read.schema(GRAPH).parquet(f"{output}/graph")
    for r in out.groupBy("kind", "level").agg(F.count("*").alias("n")).orderBy("kind", "level").collect():  # four rows
        log.info("%s/graph has %s rows of kind %s at level %s", output, r.n, r.kind, r.level)
    return out


if __name__ == "__main__":
    main("corpus_graph", lambda spark, a: run(spark, a.tables, a.output, a.checkpoint, settings(Settings, a.config)), checkpoint=True)
