"""Count-min sketches: mergeable linear ones as relations, and conservative-update ones with deletions as ordered folds.

Cells of a key: column (h1 + i * h2 + i * i) mod 2**32 mod width in row i, h1 and h2 being 32-bit hashes with seeds 1 and 2. The
linear sketch is a sum per cell: it can be split, merged and salted freely and over-estimates more. The
conservative sketch raises only the cells that must rise, and depends on the order of its updates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import UINT_MAX, saturate_uint
from .folds import ordered_fold


@dataclass(frozen=True)
class Shape:
    """Dimensions for an error of epsilon of all items with probability 1 - delta."""

    epsilon: float
    delta: float

    def __post_init__(self):
        if not 0 < self.epsilon < 1 or not 0 < self.delta < 1:
            raise ValueError("epsilon and delta must be between 0 and 1")

    @property
    def width(self) -> int:
        return math.ceil(math.e / self.epsilon)

    @property
    def depth(self) -> int:
        return math.ceil(math.log(1 / self.delta))


def xxh32(column: Column, seed: int) -> Column:
    """The 32-bit xxHash of a binary column, as a bigint; Arrow batches, for what the engine's own hashes can't give."""

    @F.pandas_udf("bigint")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else xxhash.xxh32_intdigest(bytes(k), seed) for k in keys], dtype="Int64")

    return run(column)


def md5_32(column: Column, seed: int) -> Column:
    """32 bits of MD5, natively: the seed picks the digest's first or second eight digits."""
    return F.conv(F.substring(F.md5(column), 1 + 8 * (seed - 1), 8), 16, 10).cast("bigint")


HASHES = {"xxh32": xxh32, "md5": md5_32}


def _cells_of(keys: DataFrame, key: str, shape: Shape, hashes: str) -> DataFrame:
    """keys with a row per sketch row: d, w."""
    h = HASHES[hashes]
    hashed = keys.withColumn("h1__", h(F.col(key).cast("binary"), 1)).withColumn("h2__", h(F.col(key).cast("binary"), 2))
    rows = F.explode(F.sequence(F.lit(0), F.lit(shape.depth - 1))).alias("d")
    spot = F.pmod(F.pmod(F.col("h1__") + F.col("d") * F.col("h2__") + F.col("d") * F.col("d"), F.lit(2**32)), F.lit(shape.width))
    return hashed.select("*", rows).withColumn("w", spot.cast("int")).drop("h1__", "h2__")


def linear_sketch(events: DataFrame, key: str, n: Column | str, shape: Shape, hashes: str = "xxh32") -> DataFrame:
    """d, w, cnt: sums per cell. Keys are summed before they are hashed and exploded, so each distinct key is hashed once."""
    totals = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.col(n).cast("bigint") if isinstance(n, str) else n.cast("bigint")).alias("n__"))
    return _cells_of(totals, key, shape, hashes).groupBy("d", "w").agg(F.sum("n__").alias("cnt"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("d", "w").agg(F.sum("cnt").alias("cnt"))


def linear_query(sketch: DataFrame, keys: DataFrame, key: str, shape: Shape, hashes: str = "xxh32", groups: list[str] | None = None) -> DataFrame:
    """groups, key, estimate: the least of a key's cells, by an equi-join.

    One sketch has depth * width cells at most: broadcast where that is small and there is one, joined otherwise.
    """
    groups = groups or []
    small = not groups and shape.depth * shape.width <= 2_000_000
    cells = _cells_of(keys.select(*groups, key).where(F.col(key).isNotNull()).distinct(), key, shape, hashes)
    joined = cells.join(F.broadcast(sketch) if small else sketch, [*groups, "d", "w"], "left")
    return joined.groupBy(*groups, key).agg(saturate_uint(F.min(F.coalesce("cnt", F.lit(0)))).alias("estimate"))


def exact_counts(events: DataFrame, key: str, n: str) -> DataFrame:
    """items, unique: net items, and keys with a net count above 0 (what a sketch without collisions reports)."""
    net = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.col(n).cast("bigint")).alias("n"))
    return net.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count_if(F.col("n") > 0).alias("unique"))


class Conservative:
    """The sketch with conservative updates and deletions; counters stop at 2**32 - 1."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.cells = np.zeros((shape.depth, shape.width), np.int64)
        self.items = self.unique = 0
        self._rows = np.arange(shape.depth)

    def _spots(self, key: bytes) -> np.ndarray:
        h1, h2 = xxhash.xxh32_intdigest(key, 1), xxhash.xxh32_intdigest(key, 2)
        return (h1 + self._rows * h2 + self._rows**2) % 2**32 % self.shape.width

    def query(self, key: bytes) -> int:
        return int(self.cells[self._rows, self._spots(key)].min())

    def update(self, key: bytes, n: int) -> int:
        """Adds n of a key (n < 0: takes away as many as there seem to be); the new estimate."""
        spots = self._spots(key)
        values = self.cells[self._rows, spots]
        before = int(values.min())
        if n > 0:
            after = min(before + n, UINT_MAX)
            self.cells[self._rows, spots] = np.maximum(values, after)
            self.unique += before == 0
            self.items += n
            return after
        if n < 0 and before:
            gone = min(-n, before)
            self.cells[self._rows, spots] = values - gone
            self.unique -= gone == before
            self.items -= gone
            return before - gone
        return before


#: d of the rows that hold a conservative sketch's totals: w 0 net items, w 1 unique keys.
TOTALS = -1


class _ConservativeFold:
    """Updates in; out come the cells that are not 0, and the totals."""

    def __init__(self, shape: Shape):
        self.sketch = Conservative(shape)

    def add(self, key, n):
        return (self.sketch.update(bytes(key), int(n)),)

    def rows(self):
        s = self.sketch
        d, w = np.nonzero(s.cells)
        return [*zip(d.tolist(), w.tolist(), s.cells[d, w].tolist(), strict=True), (TOTALS, 0, int(s.items)), (TOTALS, 1, int(s.unique))]


def updates(events: DataFrame, key: str, n: str) -> DataFrame:
    """events with key__ (binary) and n__ (bigint); rows without either are no updates."""
    return events.where(F.col(key).isNotNull() & F.col(n).isNotNull()).withColumn("key__", F.col(key).cast("binary")).withColumn("n__", F.col(n).cast("bigint"))


def conservative_sketch(events: DataFrame, key: str, n: str, order: str, shape: Shape, groups: list[str] | None = None) -> DataFrame:
    """groups, d, w, cnt after all updates in order: the cells that are not 0, and two rows of totals (d = TOTALS). The state is as large as the sketch, however many keys there are."""
    return ordered_fold(updates(events, key, n), groups or [], [order], ["key__", "n__"], lambda: _ConservativeFold(shape), "d int, w int, cnt bigint")


def conservative_query(sketch: DataFrame, keys: DataFrame, key: str, shape: Shape, groups: list[str] | None = None) -> DataFrame:
    """groups, key, estimate."""
    return linear_query(sketch, keys, key, shape, "xxh32", groups)


def conservative_totals(sketch: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """groups, items, unique."""
    total = lambda w: F.max(F.when(F.col("w") == w, F.col("cnt")))
    return sketch.where(F.col("d") == TOTALS).groupBy(*(groups or [])).agg(total(0).alias("items"), total(1).alias("unique"))


def distinct_exact(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.count_distinct(x).alias("unique"))


def distinct_hll(df: DataFrame, x: str, keys: list[str] | None = None, log2_registers: int = 12) -> DataFrame:
    """keys, unique by a mergeable HyperLogLog sketch of constant size."""
    return df.groupBy(*(keys or [])).agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(x), F.lit(log2_registers))).alias("unique"))
