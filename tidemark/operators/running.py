"""Running statistics: count, mean, variance and deviations of finite values; running prefixes of them.

Non-finite and null values are skipped. With fewer than two values variance and deviations are 0; an empty
group has count 0 and mean 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite


def _aggregates(x: str):
    v = F.when(is_finite(F.col(x).cast("double")), F.col(x).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(v).cast("double").alias("count"), zero(F.avg(v)).alias("avg"), zero(F.var_samp(v)).alias("variance"), zero(F.stddev_samp(v)).alias("sd"), zero(F.when(F.count(v) > 1, F.stddev_pop(v))).alias("usd")]


def running_stats(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """keys, count, avg, variance, sd (corrected) and usd (uncorrected); partial aggregation runs before the shuffle."""
    return df.groupBy(*(keys or [])).agg(*_aggregates(x))


def running_prefix(df: DataFrame, x: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Every row with the mean and count of its group's values so far, in the given order."""
    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(is_finite(F.col(x).cast("double")), F.col(x).cast("double"))
    return df.withColumn("count_so_far", F.count(v).over(w)).withColumn("mean_so_far", F.coalesce(F.avg(v).over(w), F.lit(0.0)))


def merge_stats(states: DataFrame, keys: list[str]) -> DataFrame:
    """states (keys, count, mean, m2) of disjoint parts -> the whole's; what a two-level rollup or several days' states need.

    Pairwise updates are folded in closed form: M2 = sum(m2) + sum(count * mean^2) - total^2 / count.
    """
    n, total = F.sum("count"), F.sum(F.col("count") * F.col("mean"))
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    m2 = F.sum("m2") + F.sum(F.col("count") * F.col("mean") * F.col("mean")) - F.coalesce(F.try_divide(total * total, n), F.lit(0.0))
    return states.groupBy(*keys).agg(n.alias("count"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def as_state(stats: DataFrame) -> DataFrame:
    """running_stats() as the state that is stored: count, mean, m2."""
    keep = [c for c in stats.columns if c not in ("count", "avg", "variance", "sd", "usd")]
    return stats.select(*keep, "count", F.col("avg").alias("mean"), (F.col("variance") * F.greatest(F.col("count") - 1, F.lit(0.0))).alias("m2"))
