"""Ordered folds: one small state per key, fed in arrival order, for summaries that depend on it.

A fold is an object with add(*values) and rows(); the same class serves batch (here) and streaming. Keys are dealt out by
hash and sorted within partitions, and a task holds the state of one key at a time: memory is bounded by
one state, whatever the key's rows are. Such folds are not mergeable, so a key is one task's work; use the linear or
mergeable variants where one key holds much of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable[..., object], schema: str, emit_each: bool = False, with_key: bool = False) -> DataFrame:
    """keys and what the fold's rows() gives, for each key: tuples by `schema` (of the columns after the keys).

    emit_each: instead, what add() returns for each row. Without keys, all rows are one group. with_key: make() gets the key.
    """
    fields = T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(fields)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out = None, None, []

        def ready() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[:n]
                if fold is None or key != now:
                    if fold is not None and not emit_each:
                        out += [now + tuple(r) for r in fold.rows()]
                    now, fold = key, make(*key) if with_key else make()
                got = fold.add(*row[n:])
                if emit_each:
                    out.append(key + tuple(got))
                if len(out) >= 8192:
                    yield ready()
        if fold is not None and not emit_each:
            out += [now + tuple(r) for r in fold.rows()]
        if out:
            yield ready()

    chosen = df.select(*keys, *columns, *[c for c in order if c not in columns and c not in keys])
    dealt = (chosen.repartition(*keys) if keys else chosen.repartition(1)).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    return dealt.mapInArrow(run, fields)
