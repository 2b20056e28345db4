"""Binary states: little-endian layouts of each summary, with checks on reading.

Layouts (fixed values): running statistics: f64 count, mean, M2. Quantile: u16 markers still to fill, f32 p, five f64
heights, positions and desired positions. Histogram: u16 still to fill, f64 heights and positions. Count-min: u64 items,
u64 unique, u32 cells by row. Matrix: i32 rows, i32 cols, 4 bytes a cell by row. Ring: u64 newest row's start, u64 ns per row, i32
rows, i32 values, 4 bytes of padding. Reading raises StateError with a code: 1 for a wrong length, 2 and 3
for header fields that do not match what was asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.p2 import Histogram, Quantile
from ..operators.sketches import Conservative, Shape


class StateError(ValueError):
    """invalid serialization; code says what is wrong."""

    def __init__(self, code: int):
        super().__init__("invalid serialization")
        self.code = code


def _need(ok: bool, code: int) -> None:
    if not ok:
        raise StateError(code)


def pack_stats(count: float, mean: float, m2: float) -> bytes:
    return struct.pack("<3d", count, mean, m2)


def unpack_stats(data: bytes) -> tuple[float, float, float]:
    _need(len(data) == 24, 1)
    count, mean, m2 = struct.unpack("<3d", data)
    _need(count >= 0, 2)
    return count, mean, m2


def pack_quantile(q: Quantile) -> bytes:
    left = 5 - len(q.heights)
    heights = q.heights if q.ready else [0.0] * left + q.heights[::-1]
    return struct.pack("<Hf15d", left, q.p, *heights, *q.positions, *q.wanted)


def unpack_quantile(data: bytes, p: float) -> Quantile:
    _need(len(data) == 126, 1)
    left, stored, *rest = struct.unpack("<Hf15d", data)
    _need(left <= 5, 2)
    q = Quantile(p)
    _need(stored == q.p, 3)
    q.heights = rest[:5] if left == 0 else rest[left:5][::-1]
    q.positions, q.wanted = rest[5:10], rest[10:]
    return q


def pack_histogram(h: Histogram) -> bytes:
    left = h.size - len(h.heights)
    heights = h.heights if h.ready else [0.0] * left + h.heights[::-1]
    return struct.pack(f"<H{2 * h.size}d", left, *heights, *h.positions)


def unpack_histogram(data: bytes, buckets: int) -> Histogram:
    h = Histogram(buckets)
    _need(len(data) == 2 + 16 * h.size, 1)
    left, *rest = struct.unpack(f"<H{2 * h.size}d", data)
    _need(left <= h.size, 2)
    h.heights = rest[: h.size] if left == 0 else rest[left : h.size][::-1]
    h.positions = rest[h.size :]
    return h


def pack_sketch(s: Conservative) -> bytes:
    return struct.pack("<2Q", s.items, s.unique) + s.cells.astype("<u4").tobytes()


def unpack_sketch(data: bytes, shape: Shape) -> Conservative:
    _need(len(data) == 16 + 4 * shape.depth * shape.width, 1)
    s = Conservative(shape)
    s.items, s.unique = struct.unpack_from("<2Q", data)
    s.cells = np.frombuffer(data, "<u4", offset=16).astype(np.int64).reshape(shape.depth, shape.width)
    return s


def pack_matrix(values: np.ndarray) -> bytes:
    kind = "<i4" if values.dtype.kind == "i" else "<f4"
    return struct.pack("<2i", *values.shape) + values.astype(kind).tobytes()


def unpack_matrix(data: bytes, rows: int, cols: int, kind: str = "int") -> np.ndarray:
    _need(len(data) == 8 + 4 * rows * cols, 1)
    r, c = struct.unpack_from("<2i", data)
    _need(r == rows, 2)
    _need(c == cols, 3)
    return np.frombuffer(data, "<i4" if kind == "int" else "<f4", offset=8).reshape(rows, cols).copy()


def pack_ring(newest_ns: int, ns_per_row: int, values: list[int]) -> bytes:
    """values: by slot (time row modulo rows)."""
    return struct.pack(f"<2Qi{len(values)}i", newest_ns, ns_per_row, len(values), *values) + bytes(4)


def unpack_ring(data: bytes, rows: int, ns_per_row: int) -> tuple[int, list[int]]:
    _need(len(data) == 24 + 4 * rows, 1)
    newest, width, n = struct.unpack_from("<2Qi", data)
    _need(width == ns_per_row, 2)
    _need(n == rows, 3)
    return newest, list(struct.unpack_from(f"<{rows}i", data, 20))


def error_code(read: Callable[[], object]) -> int:
    """0 if a state can be read, else the error's code."""
    try:
        read()
    except StateError as e:
        return e.code
    return 0


def stats_binary(count: Column, mean: Column, m2: Column) -> Column:
    """pack_stats() over Arrow batches."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([pack_stats(*x) for x in zip(a, b, c, strict=True)])

    return run(count, mean, m2)


def binary_stats(state: Column) -> Column:
    """unpack_stats() over Arrow batches: count, mean, m2, and error, which is 0 for a state that can be read."""

    @F.pandas_udf("count double, mean double, m2 double, error int")
    def run(states: pd.Series) -> pd.DataFrame:
        rows = []
        for s in states:
            try:
                rows.append((*unpack_stats(bytes(s or b"")), 0))
            except StateError as e:
                rows.append((0.0, 0.0, 0.0, e.code))
        return pd.DataFrame(rows, columns=["count", "mean", "m2", "error"])

    return run(state)
