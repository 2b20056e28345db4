"""A key's rows of one micro-batch in order, in bounded memory: an external merge sort within the task.

Structured Streaming has no sort before a stateful operator. Rows are sorted by runs of some bytes; if there is more than one,
runs go to unnamed files in Spark's local folder and are merged, so many at once that their blocks are as large as one run.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator
from itertools import count, islice
from typing import BinaryIO

import pandas as pd

#: Bytes of rows, as pandas counts them, that are sorted at once; runs that are merged at once.
RUN_BYTES, FAN = 8 << 20, 64


def in_order(parts: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[tuple]:
    """The columns' values of all rows by `order`: nulls last, equal ones as they came."""
    used = list(dict.fromkeys([*order, *columns]))
    levels: list[list[BinaryIO]] = []
    rows: list[tuple] = []
    number, size = count(), 0
    for part in parts:
        rows += zip(*(k for c in order for k in _comparable(part[c])), number, *(part[c].tolist() for c in columns))
        size += int(part[used].memory_usage(index=False, deep=True).sum())
        if size >= RUN_BYTES:
            rows.sort()
            _keep(levels, 0, rows, max(1, len(rows) // FAN))
            rows, size = [], 0
    rows.sort()
    first = 2 * len(order) + 1
    for row in heapq.merge(*(_read(f) for level in levels for f in level), rows):
        yield row[first:]


def _comparable(c: pd.Series) -> tuple[list, list]:
    """Whether a value is null, and the value, which counts among those that are not."""
    null = c.isna().tolist()
    values = c.tolist()
    return null, [0 if n else x for n, x in zip(null, values, strict=True)] if True in null else values


def _keep(levels: list[list[BinaryIO]], level: int, rows: Iterator[tuple] | list[tuple], block: int) -> None:
    """Writes a sorted run by blocks; FAN runs of a level become one of the next."""
    f = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    rows = iter(rows)
    while some := list(islice(rows, block)):
        pickle.dump(some, f, pickle.HIGHEST_PROTOCOL)
    f.seek(0)
    if level == len(levels):
        levels.append([])
    levels[level].append(f)
    if len(levels[level]) == FAN:
        full, levels[level] = levels[level], []
        _keep(levels, level + 1, heapq.merge(*map(_read, full)), block)


def _read(f: BinaryIO) -> Iterator[tuple]:
    with f:
        while True:
            try:
                some = pickle.load(f)
            except EOFError:
                return
            yield from some
