"""Ranks, caps and running sums over a whole table without gathering it in one task.

A window over a whole table, or over a class with a third of all rows, is one task. Here a coarse
bucket of the order is counted first; the counts (at most `BUCKETS` rows a group) are accumulated, and
a row's rank is its rank inside its own small bucket plus the rows in buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order

#: Hexadecimal digits of a hash that make a bucket: 16**3 buckets.
DIGITS = 3


def _offsets(df: DataFrame, by: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """Sum of value in all buckets before, per group and bucket."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, bucket, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias(name))


def _match(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join that lets null group keys meet."""
    names = {k: f"_k{i}" for i, k in enumerate(by)}
    r = right.select(*[F.col(k).alias(v) for k, v in names.items()], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for k, v in names.items():
        on = on & F.col(k).eqNullSafe(F.col(v))
    return left.join(r, on).drop(*names.values())


def ranked(df: DataFrame, order: list[Column], bucket: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with 1-based ranks in the order; bucket must not decrease along it."""
    by = by or []
    d = df.withColumn("_b", bucket)
    first = _offsets(d, by, "_b", F.lit(1), "_before")
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    placed = d.withColumn("_in", F.row_number().over(w))
    return _match(placed, first, [*by, "_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_b")


def shuffled(df: DataFrame, tag: str, key: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with 1-based ranks in a reproducible random order of `key`."""
    d = df.withColumn("_o", hash_order(tag, F.col(key)))
    return ranked(d, [F.col("_o"), F.col(key)], F.substring("_o", 1, DIGITS), by, name).drop("_o")


def running_sum(df: DataFrame, order: list[Column], bucket: Column, value: Column, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows before in the order."""
    d = df.withColumn("_b", bucket).withColumn("_v", value)
    first = _offsets(d, [], "_b", F.col("_v"), "_before")
    w = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("_in", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return _match(placed, first, ["_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_b", "_v")
