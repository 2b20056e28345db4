"""P-square quantiles and equiprobable histograms (Jain and Chlamtac, 1985): a few markers, moved by piecewise parabolas.

Marker i has a height (its estimate) and a position (how many observations are at or below it). An observation shifts the
positions above it, and every inner marker that is off its desired position by one or more moves one place, its height
following the parabola through its neighbours, or the line where the parabola would leave their interval. Non-finite
values are skipped. Until every marker has an observation there is no estimate.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from .folds import ordered_fold


class Markers:
    """Heights and positions; desired() says where the inner markers should be."""

    def __init__(self, count: int):
        self.size = count
        self.heights: list[float] = []
        self.positions = [float(i + 1) for i in range(count)]

    @property
    def ready(self) -> bool:
        return len(self.heights) == self.size

    def desired(self) -> list[float]:
        raise NotImplementedError

    def observe(self, x: float) -> bool:
        """Takes an observation; whether the markers were ready before it."""
        q, n = self.heights, self.positions
        if len(q) < self.size:
            q.append(x)
            if len(q) == self.size:
                q.sort()
            return False
        last = self.size - 1
        if x < q[0]:
            q[0], cell = x, 1
        elif x >= q[last]:
            q[last], cell = x, last
        else:
            cell = bisect_right(q, x)
        for i in range(cell, self.size):
            n[i] += 1
        for i, want in enumerate(self.desired()[1:-1], 1):
            off = want - n[i]
            step = 1.0 if off >= 1 and n[i + 1] - n[i] > 1 else -1.0 if off <= -1 and n[i] - n[i - 1] > 1 else 0.0
            if step:
                self._move(i, step)
        return True

    def _move(self, i: int, step: float) -> None:
        q, n = self.heights, self.positions
        below, above = n[i] - n[i - 1], n[i + 1] - n[i]
        rise = ((below + step) * (q[i + 1] - q[i]) / above + (above - step) * (q[i] - q[i - 1]) / below) * step / (n[i + 1] - n[i - 1])
        height = q[i] + rise
        if not q[i - 1] < height < q[i + 1]:
            j = i + int(step)
            height = q[i] + step * (q[j] - q[i]) / (n[j] - n[i])
        q[i] = height
        n[i] += step

    def estimate(self, marker: int) -> float | None:
        return self.heights[marker] if self.ready else None

    def count(self, marker: int) -> int:
        return int(self.positions[marker]) if self.ready else 0


class Quantile(Markers):
    """Five markers: least, p/2, p, (1+p)/2, greatest. p is kept in single precision, as the binary state has it."""

    def __init__(self, p: float):
        if not 0 < p < 1:
            raise ValueError("p must be between 0 and 1")
        super().__init__(5)
        single = np.float32
        self.p = float(single(p))
        half, upper = single(p) / single(2), (single(1) + single(p)) / single(2)
        self.rates = [0.0, float(half), float(single(p)), float(upper), 1.0]
        self.wanted = [1.0, float(single(1) + single(2) * single(p)), float(single(1) + single(4) * single(p)), float(single(3) + single(2) * single(p)), 5.0]

    def desired(self) -> list[float]:
        self.wanted = [w + r for w, r in zip(self.wanted, self.rates, strict=True)]
        return self.wanted

    def add(self, x: float, compat: bool = False) -> float | None:
        """The running estimate of p. compat: the fifth observation returns 3.0 in place of the median of five."""
        if self.observe(x):
            return self.heights[2]
        return (3.0 if compat else self.heights[2]) if self.ready else None


class Histogram(Markers):
    """b + 1 markers at equal shares of the observations."""

    def __init__(self, buckets: int):
        if not 4 <= buckets < 65535:
            raise ValueError("buckets must be between 4 and 65534")
        super().__init__(buckets + 1)
        self.b = buckets

    def desired(self) -> list[float]:
        span = self.positions[-1] - 1
        return [1 + i * span / self.b for i in range(self.size)]

    def add(self, x: float) -> None:
        self.observe(x)


class _Rows:
    """A fold: markers in, a row per marker out (marker, estimate, count)."""

    def __init__(self, markers: Markers):
        self.markers = markers

    def add(self, x: float) -> tuple:
        return (self.markers.add(x),)

    def rows(self):
        m = self.markers
        return [(i, m.estimate(i), m.count(i)) for i in range(m.size)]


def _finite(df: DataFrame, x: str) -> DataFrame:
    return df.where(is_finite(F.col(x).cast("double"))).withColumn("x__", F.col(x).cast("double"))


def quantile(df: DataFrame, x: str, order: str, p: float, keys: list[str] | None = None) -> DataFrame:
    """keys, marker, estimate, n of a P-square quantile fed in the given order."""
    Quantile(p)
    return ordered_fold(_finite(df, x), keys or [], [order], ["x__"], lambda: _Rows(Quantile(p)), "marker int, estimate double, n bigint")


def quantile_prefix(df: DataFrame, x: str, order: str, p: float, keys: list[str] | None = None) -> DataFrame:
    """keys, the order column, value, estimate: the running estimate after each observation."""

    class Each(_Rows):
        def add(self, seq, value):
            return seq, value, self.markers.add(value)

    kind = df.schema[order].dataType.simpleString()
    return ordered_fold(_finite(df, x), keys or [], [order], [order, "x__"], lambda: Each(Quantile(p)), f"`{order}` {kind}, value double, estimate double", emit_each=True)


def histogram(df: DataFrame, x: str, order: str, buckets: int, keys: list[str] | None = None) -> DataFrame:
    """keys, marker, estimate, n of a P-square histogram fed in the given order."""
    Histogram(buckets)
    return ordered_fold(_finite(df, x), keys or [], [order], ["x__"], lambda: _Rows(Histogram(buckets)), "marker int, estimate double, n bigint")


def exact_percentiles(df: DataFrame, x: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, p, value: interpolated exact percentiles, order-free and fully native; an operator of its own, not P-square."""
    got = _finite(df, x).groupBy(*(keys or [])).agg(F.percentile("x__", F.array(*(F.lit(p) for p in shares))).alias("q"))
    return got.select(*(keys or []), F.explode(F.arrays_zip(F.array(*(F.lit(p) for p in shares)).alias("p"), F.col("q").alias("value"))).alias("z")).select(*(keys or []), "z.p", "z.value")


def mergeable_percentiles(df: DataFrame, x: str, shares: list[float], keys: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """keys, p, value by mergeable summaries: the scalable order-free form, partial aggregates first; rank error at most 1 / accuracy."""
    got = _finite(df, x).groupBy(*(keys or [])).agg(F.percentile_approx("x__", [float(p) for p in shares], accuracy).alias("q"))
    return got.select(*(keys or []), F.explode(F.arrays_zip(F.array(*(F.lit(p) for p in shares)).alias("p"), F.col("q").alias("value"))).alias("z")).select(*(keys or []), "z.p", "z.value")
