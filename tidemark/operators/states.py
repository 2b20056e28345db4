"""States out and in: summaries as binary columns in their stored layouts, and folds that go on from them.

A state table has one row per key. Written as Parquet it outlives a session; a fold over new events that is given such a table
continues each key where it stood, and keys without a state begin anew. Reading checks every state (functions.codecs).
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from .folds import ordered_fold
from .matrices import Matrix
from .p2 import Histogram, Quantile, _finite
from .rings import Ring
from .sketches import Conservative, Shape, updates


class _Resumed:
    """A summary that may begin with a stored state; rows() gives its state."""

    def __init__(self, summary: object, feed: Callable, pack: Callable, unpack: Callable):
        self.summary, self.feed, self.pack, self.unpack = summary, feed, pack, unpack

    def add(self, state, *values) -> tuple:
        if state is not None:
            self.summary = self.unpack(bytes(state))
        else:
            self.feed(self.summary, *values)
        return ()

    def rows(self):
        return [(self.pack(self.summary),)]


def _fold(events: DataFrame, keys: list[str], order: str, columns: list[str], make: Callable, states: DataFrame | None) -> DataFrame:
    """keys, state. A key's stored state comes before its events: its order is null, and nulls sort first."""
    rows = events.select(*keys, F.col(order).alias("order__"), F.lit(None).cast("binary").alias("state__"), *columns)
    if states is not None:
        kinds = dict(events.dtypes)
        begun = states.select(*keys, F.lit(None).cast(kinds[order]).alias("order__"), F.col("state").alias("state__"), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns))
        rows = begun.unionByName(rows)
    return ordered_fold(rows, keys, ["order__"], ["state__", *columns], make, "state binary")


def quantile_state(df: DataFrame, x: str, order: str, p: float, keys: list[str], states: DataFrame | None = None) -> DataFrame:
    make = lambda: _Resumed(Quantile(p), lambda q, v: q.add(v), codecs.pack_quantile, lambda b: codecs.unpack_quantile(b, p))
    return _fold(_finite(df, x), keys, order, ["x__"], make, states)


def histogram_state(df: DataFrame, x: str, order: str, buckets: int, keys: list[str], states: DataFrame | None = None) -> DataFrame:
    make = lambda: _Resumed(Histogram(buckets), lambda h, v: h.add(v), codecs.pack_histogram, lambda b: codecs.unpack_histogram(b, buckets))
    return _fold(_finite(df, x), keys, order, ["x__"], make, states)


def sketch_state(df: DataFrame, key: str, n: str, order: str, shape: Shape, groups: list[str], states: DataFrame | None = None) -> DataFrame:
    make = lambda: _Resumed(Conservative(shape), lambda s, k, m: s.update(bytes(k), int(m)), codecs.pack_sketch, lambda b: codecs.unpack_sketch(b, shape))
    return _fold(updates(df, key, n), groups, order, ["key__", "n__"], make, states)


def markers(states: DataFrame, keys: list[str], unpack: Callable) -> DataFrame:
    """keys, marker, estimate, n of quantile or histogram states; unpack reads one."""
    schema = states.select(*keys).schema.add("marker", "integer").add("estimate", "double").add("n", "long")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = unpack(bytes(row["state"]))
                columns = [*([row[k]] * m.size for k in keys), list(range(m.size)), [m.estimate(i) for i in range(m.size)], [m.count(i) for i in range(m.size)]]
                kinds = [*(batch.schema.field(k).type for k in keys), pa.int32(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return states.select(*keys, "state").mapInArrow(run, schema)


def ring_state(cells: DataFrame, ring: Ring) -> DataFrame:
    """keys, state: all rows of a ring, unwritten ones as 0, by slot."""
    whole = ring.range(cells, None, ring.rows).groupBy(*ring.keys).agg(F.max("bucket").alias("newest"), F.map_from_entries(F.collect_list(F.struct(F.pmod("bucket", F.lit(ring.rows)).alias("s"), "v"))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(ring.rows - 1)), lambda s: F.element_at("m", s.cast("bigint")))

    @F.pandas_udf("binary")
    def pack(newest: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([codecs.pack_ring(int(n) * ring.ns_per_row, ring.ns_per_row, [int(x) for x in v]) for n, v in zip(newest, values, strict=True)])

    return whole.select(*ring.keys, "newest", slots.alias("values")).select(*ring.keys, pack("newest", "values").alias("state"))


def ring_from_state(states: DataFrame, ring: Ring) -> DataFrame:
    """keys, bucket, v, newest: the ring that a state holds; zeros are unwritten rows."""
    schema = states.select(*ring.keys).schema.add("bucket", "long").add("v", "integer").add("newest", "long")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, values = codecs.unpack_ring(bytes(row["state"]), ring.rows, ring.ns_per_row)
                newest = at // ring.ns_per_row
                rows = [(b, values[b % ring.rows], newest) for b in range(newest - ring.rows + 1, newest + 1) if values[b % ring.rows]]
                rows = rows or [(newest, 0, newest)]
                columns = [*([row[k]] * len(rows) for k in ring.keys), *map(list, zip(*rows, strict=True))]
                kinds = [*(batch.schema.field(k).type for k in ring.keys), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return states.select(*ring.keys, "state").mapInArrow(run, schema)


def matrix_state(cells: DataFrame, matrix: Matrix) -> DataFrame:
    """state: one row; the matrix is as large as its dimensions say, whatever it was built from."""
    kind, start = (np.int32, 0) if matrix.kind == "int" else (np.float32, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.full((matrix.rows, matrix.cols), start, kind)
        for batch in batches:
            r, c, v = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            values[r, c] = v
        yield pa.RecordBatch.from_arrays([pa.array([codecs.pack_matrix(values)], pa.binary())], ["state"])

    return cells.select("r", "c", "v").repartition(1).mapInArrow(run, "state binary")


def matrix_from_state(states: DataFrame, matrix: Matrix) -> DataFrame:
    """r, c, v of a stored matrix."""
    kind = pa.int32() if matrix.kind == "int" else pa.float32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column(0).to_pylist():
                values = codecs.unpack_matrix(bytes(state), matrix.rows, matrix.cols, matrix.kind)
                r, c = np.indices(values.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(values.ravel(), kind)], ["r", "c", "v"])

    return states.select("state").mapInArrow(run, f"r int, c int, v {matrix.kind}")
