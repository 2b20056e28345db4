"""Matrix profile: for each window of a series the distance to its nearest z-normalised neighbour, and anomalies.

Two plans with the same result. `matrix_profile` is relational: window statistics, a join of windows along diagonals, running dot
products, and a minimum per window. `matrix_profile_blocked` deals out diagonals to tasks that compute them with cumulative sums over
a broadcast series (size checked): the quadratic part then neither shuffles nor joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold
from .p2 import Quantile

#: Values of a series that may be broadcast (8 bytes each).
MOST_BROADCAST = 4_000_000


def check_parameters(n: int, m: int, percent: float) -> None:
    if m < 4:
        raise ValueError("m must be at least 4")
    if n // 4 < m:
        raise ValueError("n must be at least 4 * m")
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")


def _diagonals(df: DataFrame, n: int, m: int, percent: float, seed: int) -> DataFrame:
    """diag: distances between windows that are compared, in a seeded order, as many as `percent` asks for."""
    length = n - m + 1
    diags = df.sparkSession.range(m // 4 + 1, length).withColumnRenamed("id", "diag")
    if percent >= 100:
        return diags
    return diags.orderBy(F.md5(F.concat_ws(":", "diag", F.lit(seed)).cast("binary")), "diag").limit(int(percent / 100 * length + 1) + 1)


def matrix_profile(series: DataFrame, n: int, m: int, keys: list[str] | None = None, percent: float = 100, seed: int = 0) -> DataFrame:
    """series (keys, i, v) with i from 0 to n - 1 -> keys, i, mp, mpi of the n - m + 1 windows.

    mp is infinite and mpi 0 for a window without any comparable neighbour (constant windows have none). Ties go to the
    lowest neighbour.
    """
    check_parameters(n, m, percent)
    keys = keys or []
    length = n - m + 1
    part = keys or [F.lit(0)]
    frame = Window.partitionBy(*part).orderBy("i").rowsBetween(0, m - 1)
    v = F.col("v").cast("double")
    st = series.where(F.col("i").between(0, n - 1)).select(*keys, F.col("i").cast("bigint").alias("i"), v.alias("v")).withColumns({"mu": F.avg("v").over(frame), "sd": F.stddev_pop("v").over(frame)})
    j = st.select(*keys, F.col("i").alias("j"), F.col("v").alias("vj"), F.col("mu").alias("mj"), F.col("sd").alias("sj"))
    k = st.select(*keys, F.col("i").alias("k"), F.col("v").alias("vk"), F.col("mu").alias("mk"), F.col("sd").alias("sk"))
    # each value meets its partner on every diagonal that is compared: an equi-join on the partner's place
    first = m // 4 + 1
    spread = j.where(F.col("j") >= first).select("*", F.explode(F.sequence(F.lit(first).cast("bigint"), F.least(F.col("j"), F.lit(length - 1).cast("bigint")))).alias("diag"))
    if percent < 100:
        spread = spread.join(F.broadcast(_diagonals(series, n, m, percent, seed)), "diag")  # n numbers at most
    spread = spread.withColumn("k", F.col("j") - F.col("diag"))
    pair = spread.join(k, [*keys, "k"])
    along = Window.partitionBy(*keys, "diag").orderBy("j").rowsBetween(0, m - 1)
    qt = pair.withColumn("qt", F.sum(F.col("vj") * F.col("vk")).over(along)).where(F.col("j") < length)
    d = qt.withColumn("d", 2 * (m - F.try_divide(F.col("qt") - m * F.col("mj") * F.col("mk"), F.col("sj") * F.col("sk")))).where("d is not null and not isnan(d)")
    both = d.select(*keys, F.explode(F.array(F.struct(F.col("j").alias("i"), F.col("k").alias("nn"), "d"), F.struct(F.col("k").alias("i"), F.col("j").alias("nn"), "d"))).alias("e"))
    best = both.groupBy(*keys, F.col("e.i").alias("i")).agg(F.min(F.struct(F.col("e.d").alias("d"), F.col("e.nn").alias("nn"))).alias("b"))
    windows = st.where(F.col("i") < length).select(*keys, "i")
    return windows.join(best, [*keys, "i"], "left").select(*keys, "i", F.coalesce(F.sqrt(F.abs(F.col("b.d"))), F.lit(float("inf"))).alias("mp"), F.coalesce(F.col("b.nn"), F.lit(0)).alias("mpi"))


def _block(values: np.ndarray, m: int, diags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least distances and neighbours of every window over some diagonals."""
    length = len(values) - m + 1
    sums = lambda x: np.convolve(x, np.ones(m), "valid")
    centred = values - values.mean()
    mu = sums(centred) / m
    sd = np.sqrt(np.maximum(sums(centred**2) / m - mu**2, 0))
    flat = sd < 1e-9 * max(1.0, np.abs(centred).max(initial=0))
    best, where = np.full(length, np.inf), np.zeros(length, np.int64)
    for g in diags.tolist():
        run = np.concatenate(([0.0], np.cumsum(centred[g:] * centred[: len(values) - g])))
        qt = run[m:] - run[:-m]
        a, b = np.arange(g, length), np.arange(length - g)
        ok = ~(flat[a] | flat[b])
        d = np.full(len(a), np.inf)
        d[ok] = 2 * (m - (qt[ok] - m * mu[a[ok]] * mu[b[ok]]) / (sd[a[ok]] * sd[b[ok]]))
        for own, other in ((a, b), (b, a)):
            better = (d < best[own]) | (d == best[own]) & ok & (other < where[own])
            best[own[better]], where[own[better]] = d[better], other[better]
    return best, where


def matrix_profile_blocked(series: DataFrame, n: int, m: int, percent: float = 100, seed: int = 0, tasks: int = 64) -> DataFrame:
    """The same for one long series: series (i, v) -> i, mp, mpi. Each task emits a row per window, so the shuffle is tasks * windows rows at most."""
    check_parameters(n, m, percent)
    if n > MOST_BROADCAST:
        raise ValueError("the series is too long to broadcast")
    rows = series.where(F.col("i").between(0, n - 1)).select(F.col("i").cast("bigint"), F.col("v").cast("double")).orderBy("i").toPandas()  # n values, checked above
    values = np.zeros(n)
    values[rows["i"]] = rows["v"]
    shared = series.sparkSession.sparkContext.broadcast(values)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        diags = [p["diag"].to_numpy() for p in parts]
        if diags and sum(map(len, diags)):
            best, where = _block(shared.value, m, np.concatenate(diags))
            hit = np.flatnonzero(np.isfinite(best))
            yield pd.DataFrame({"i": hit, "d": best[hit], "nn": where[hit]})

    spark = series.sparkSession
    dealt = _diagonals(series, n, m, percent, seed).repartition(tasks)
    best = dealt.mapInPandas(run, "i bigint, d double, nn bigint").groupBy("i").agg(F.min(F.struct("d", "nn")).alias("b"))
    windows = spark.range(0, n - m + 1).withColumnRenamed("id", "i")
    return windows.join(best, "i", "left").select("i", F.coalesce(F.sqrt(F.abs(F.col("b.d"))), F.lit(float("inf"))).alias("mp"), F.coalesce(F.col("b.nn"), F.lit(0)).alias("mpi"))


class _Anomaly:
    """Discord of a profile against its running 95 % and 50 % quantiles."""

    def __init__(self):
        self.q95, self.q50 = Quantile(0.95), Quantile(0.5)
        self.e95 = self.e50 = None
        self.discord, self.at = -np.inf, 0

    def add(self, i, mp):
        if mp > self.discord:
            self.discord, self.at = mp, i
        self.e95, self.e50 = self.q95.add(mp, compat=True), self.q50.add(mp, compat=True)
        return ()

    def rows(self):
        if not np.isfinite(self.discord):
            return []
        if self.e95 is None:
            return [(self.at, None, None)]
        gap = self.discord - self.e50
        return [(self.at, (self.discord - self.e95) / gap * 100 if gap else None, gap)]


def anomaly(profile: DataFrame, keys: list[str] | None = None, last: int | None = None) -> DataFrame:
    """profile -> keys, at, relative_pct, distance: the window least like any other, how far it exceeds the 95 % quantile, in percent of its distance to the median.

    last: only the profile's last windows, for the current interval. No row where the greatest distance is infinite; with
    fewer than five windows there are no quantiles, and the two values are null.
    """
    keys = keys or []
    if last is not None:
        ends = profile.groupBy(*keys).agg((F.max("i") - last).alias("end__")) if keys else profile.agg((F.max("i") - last).alias("end__"))
        profile = (profile.join(ends, keys) if keys else profile.crossJoin(F.broadcast(ends))).where("i > end__")
    return ordered_fold(profile, keys, ["i"], ["i", "mp"], _Anomaly, "at bigint, relative_pct double, distance double")
