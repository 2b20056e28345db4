"""Frequencies: value sets in first-seen order, heavy hitters, duplicates by interval, counts by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold


def set_counts(df: DataFrame, value: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """keys, value, cnt, idx: how often each value occurs, numbered from 1 as first seen."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"), F.min(order).alias("first__"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("first__")
    return counts.withColumn("idx", F.row_number().over(w)).drop("first__")


class MisraGries:
    """At most `size` weighted values: weight <= frequency <= weight + rows / (size + 1).

    A value that comes when the table is full lowers all weights by one and is not kept itself.
    """

    def __init__(self, size: int, weights: dict | None = None):
        if size < 1:
            raise ValueError("size must be at least 1")
        self.size = size
        self.weights: dict = dict(weights or {})

    def add(self, value) -> None:
        w = self.weights
        if value in w:
            w[value] += 1
        elif len(w) < self.size:
            w[value] = 1
        else:
            self.weights = {k: n - 1 for k, n in w.items() if n > 1}

    def rows(self):
        return [(str(k), n) for k, n in self.weights.items()]


def heavy_hitters(df: DataFrame, value: str, order: str, size: int, keys: list[str] | None = None) -> DataFrame:
    """keys, value, weight of the frequent values, fed in order."""
    rows = df.where(F.col(value).isNotNull()).withColumn("value__", F.col(value).cast("string"))
    return ordered_fold(rows, keys or [], [order], ["value__"], lambda: MisraGries(size), "value string, weight bigint")


def frequent_values(df: DataFrame, value: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """keys, value, cnt: the k most frequent values exactly, ties by value; counts are aggregated before they are ranked."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("cnt"), value)
    return counts.withColumn("rank__", F.row_number().over(w)).where(F.col("rank__") <= k).drop("rank__")


def duplicate_pct(df: DataFrame, value: str, interval: Column, keys: list[str] | None = None, exact: bool = False) -> DataFrame:
    """keys, interval, total, unique, duplicate_pct: (1 - min(unique / total, 1)) * 100 per interval."""
    unique = F.count_distinct(value) if exact else F.approx_count_distinct(value)
    out = df.where(F.col(value).isNotNull()).groupBy(*(keys or []), interval.alias("interval")).agg(F.count("*").alias("total"), unique.alias("unique"))
    return out.withColumn("duplicate_pct", (1 - F.least(F.col("unique") / F.col("total"), F.lit(1.0))) * 100)


def duplicate_range(pct: DataFrame, keys: list[str], interval: str = "interval") -> DataFrame:
    """pct with the least and greatest percentage of each key's other intervals."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(interval)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    p = F.col("duplicate_pct")
    return pct.withColumn("other_min", F.least(F.min(p).over(before), F.min(p).over(after))).withColumn("other_max", F.greatest(F.max(p).over(before), F.max(p).over(after)))


def path_counts(df: DataFrame, path: list[str]) -> DataFrame:
    """path columns (null below a prefix), level, cnt of every prefix of the path; missing parts are NIL."""
    filled = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NIL")).alias(c) for c in path))
    out = filled.rollup(*path).agg(F.grouping_id().alias("g__"), F.count("*").alias("cnt"))
    # a prefix of k of the n columns has grouping id 2**(n - k) - 1
    return out.where("g__ < " + str(2 ** len(path) - 1)).select(*path, (len(path) - F.bit_count("g__")).cast("int").alias("level"), "cnt")
