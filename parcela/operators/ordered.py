"""Running sums, row numbers and containment of intervals over whole tables, without one task that sees all rows.

Rows are dealt by ranges of the order, summed up within each range, and moved by
what lies in the ranges before: only one sum a range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.sources.shared import written


def running(df: DataFrame, order: list[Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (a whole number) over all rows up to each, itself included. ``order`` must tell all rows apart, or equal ones may come in either order."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__value", value.cast("long")).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("__value")).collect()}  # a row a range
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__upto", F.sum("__value").over(within)).join(F.broadcast(spark.createDataFrame(before, "__range int, __before long")), "__range")
    return placed.withColumn(name, F.col("__upto") + F.col("__before")).drop("__value", "__range", "__upto", "__before")


def numbered(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of each row in the order, from 1."""
    return running(df, order, F.lit(1), name, ranges)


def contained_counts(intervals: DataFrame, ranges: int | None = None) -> DataFrame:
    """id, below: how many of intervals(id, enter, leave) lie in each, itself included. Two intervals are nested or apart, as those of a walk over a tree.

    Then those that begin in an interval lie in it, but for those that begin with
    it and end later. Both are numbers of rows up to a place of one order, which
    begins and ends of all intervals are sorted into: no interval meets another.
    """
    iv = intervals.select("id", F.col("enter").cast("double").alias("enter"), F.col("leave").cast("double").alias("leave"))
    # begins come before ends at the same place; of begins there, longer intervals first
    at = lambda place, kind, rank: F.struct(place.alias("place"), F.lit(kind).alias("kind"), rank.alias("rank"))
    begin, end = at(F.col("enter"), 0, -F.col("leave")), at(F.col("leave"), 1, F.lit(0.0))
    events = iv.select("id", F.explode(F.array(begin, end)).alias("e")).select("id", "e.*")
    counted = running(events, [F.col("place"), F.col("kind"), F.col("rank"), F.col("id")], F.col("kind") == 0, "upto", ranges)
    # equal intervals lie in each other: their begins count from the first of them
    firsts = counted.filter("kind = 0").groupBy("place", "rank").agg(F.min("upto").alias("first"))
    begins = counted.filter("kind = 0").join(firsts, ["place", "rank"]).select("id", "first")
    ends = counted.filter("kind = 1").select("id", "upto")
    return begins.join(ends, "id").select("id", (F.col("upto") - F.col("first") + 1).alias("below"))
