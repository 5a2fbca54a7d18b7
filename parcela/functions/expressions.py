"""Column expressions for arrays, random choices and names, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_all(array: str | Column, value) -> Column:
    """An array of the same length with one value throughout; nested arrays keep their shape."""
    return F.transform(array, lambda _: F.lit(value))


def random_order(seed: int, *keys: str) -> Column:
    """A reproducible draw for each key, the same however the rows are partitioned and in any engine: a digest to sort by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def random_element(table: DataFrame, groups: list[str], key: str, seed: int, n: int = 1) -> DataFrame:
    """n rows of each group, drawn without replacement, with ``draw`` from 1."""
    w = Window.partitionBy(*groups).orderBy(random_order(seed, key), key)
    return table.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)


def random_pair(array: Column, seed: int, *keys: str) -> Column:
    """Two different elements of an array, as a struct (first, second); null for fewer than two."""
    shuffled = F.transform(F.array_sort(F.transform(array, lambda x: F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], x).alias("o"), x.alias("x")))), lambda s: s["x"])
    return F.when(F.size(array) >= 2, F.struct(F.get(shuffled, F.lit(0)).alias("first"), F.get(shuffled, F.lit(1)).alias("second")))


def suffix(path: Column) -> Column:
    """The upper-case ending of a file name, with its dot; empty if there is none."""
    return F.upper(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def population_bounds(total: Column, districts: int, tolerance: float) -> tuple[Column, Column]:
    """Least and most people of a district."""
    return F.ceil((1 - tolerance) * total / districts), F.floor((1 + tolerance) * total / districts)
