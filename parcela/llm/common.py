"""Shared by the corpus operators: table paths, lineage cuts in the shared folder, row ids.

Every intermediate table goes to the folder that the cluster names in
``spark.checkpoint.dir``; executors may be lost at any time and nothing that a
later step needs lies on their own disks.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The same as characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a temporary folder, but in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = "file://" + tempfile.mkdtemp(prefix="parcela-")
    return _local_dir[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def folder_of(df: DataFrame, label: str, by: str) -> str:
    """A folder of the shared one to which ``df`` is written as Parquet, with a folder inside it for each value of ``by``: for tasks that read files themselves.

    The path is a whole URI: a path without scheme may mean one store to Spark and another to a task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()
    return whole if not whole.startswith("file:/") or whole.startswith("file://") else "file://" + whole.removeprefix("file:")


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by ``written`` once nothing reads it any more."""
    files = df.inputFiles()
    if not files:
        return
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "/parcela/" not in path.toString():
        raise ValueError(f"not an intermediate table: {path}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: File hashes up to this many rows (16 bytes each) are broadcast; the driver's own list of the files takes more.
BROADCAST_FILES = 2_000_000
#: Row ids up to this many (some 30 bytes each) are broadcast.
BROADCAST_ROWS = 500_000
ROW_BITS = 36


def fresh(df: DataFrame, stem: str) -> str:
    """A name that no column of ``df`` has, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _place(df: DataFrame) -> tuple[Column, Column]:
    meta = df.metadataColumn("_metadata")  # also beside a column of that name
    return meta["file_path"], meta["row_index"]


def stored(df: DataFrame) -> DataFrame:
    """``df`` if its rows come from files as they are, else a written copy: only then do rows have a lasting place."""
    try:
        df.select(*_place(df)).schema
    except AnalysisException:
        return written(df, "stored")
    return df


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """A ``stored`` table with a number for each row, from its file's place among the sorted hashes of names and its place in the file.

    Unlike ``monotonically_increasing_id`` it doesn't depend on how a scan is
    split, which changes when executors come or go between two scans. ``name``
    must be ``fresh``.
    """
    file, row = _place(df)
    names = df.select(file.alias("file")).distinct()
    hashed = lambda seed, name: F.call_function("xxhash64", F.lit(seed), name)
    for seed in range(8):  # until no two files share a hash
        files = names.select(hashed(seed, F.col("file")).alias("h")).groupBy("h").agg(F.count("*").alias("k"))
        numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h")).cast("long")
        files = written(files.withColumn("no", numbered), "files")
        if not files.filter("k > 1").limit(1).count():
            break
    else:
        raise RuntimeError("names of files share their hashes under every seed")
    small = files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    h, at, no = fresh(df, "file_hash"), fresh(df, "file_row"), fresh(df, "file_number")
    placed = df.select("*", hashed(seed, file).alias(h), row.alias(at))
    files = files.select(F.col("h").alias(h), F.col("no").alias(no))
    joined = placed.join(F.broadcast(files) if small else files.hint("merge"), h)
    return joined.select(*columns(df), F.shiftleft(no, ROW_BITS).bitwiseOR(F.col(at)).alias(name))


def sized(ids: DataFrame) -> DataFrame:
    """A written table of row ids for the small side of a join: broadcast if it holds at most ``BROADCAST_ROWS``, else for a merge join."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids.hint("merge")


def without_rows(df: DataFrame, rid: str, dropped: DataFrame) -> DataFrame:
    """``df`` (stored) without the rows whose ids are in ``dropped`` (one column ``rid``), with its columns alone."""
    dropped = written(dropped.select(F.col("rid").alias(rid)), "dropped")
    return with_row_ids(df, rid).join(sized(dropped), rid, "left_anti").select(*columns(df))


def release() -> None:
    """Gives back what a task's Python worker has freed: it lives on, and beside the executor's heap there is little room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, jobs hand so many rows at a time to Python: a batch of texts lies in the executor and in its worker at once. The setting is put back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: A piece of a batch has no more bytes than this, or one row.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows and bytes at most, so that only a piece's texts are Python objects at a time."""
    for b in batches:
        left = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while left:
            piece = left.pop()
            if piece.num_rows > 1 and piece.nbytes > size:
                half = piece.num_rows // 2
                left += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def one_space(col):
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(col, SPACE, " ")
