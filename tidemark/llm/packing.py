"""Sum-of-squares online packing of token streams into fixed windows.

Each task packs the documents of its partition as they come. A document's ids are cut into full windows
and a remainder; the remainder goes to the fill level (or a new window) that makes the sum over levels
of squared counts of partially filled windows least, ties to the fullest. The counts are one
array with an entry a level. A remainder may also be cut, so that its head fills a window and its tail begins another one; that is
weighed by the same sum, plus `cut_price`. So levels whose complements do not come cannot pile up: a level has some
cut_price / 2 windows at most, whatever the lengths and however many documents a task has.
When the partition ends, the open windows' pieces are put end to end and cut anew: full windows, then sequences
whose lengths are powers of two, which need no padding. No id is lost.

Defined results: a null or empty text has the closing id alone. Repeated rows are packed as often as
they occur. An empty table gives no rows. Sequence ids hold the partition's number in their upper bits:
a task that is run again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import CHUNK, encoder_of
from .kernel import batch_of, chunks
from .store import text_map

NEVER = np.iinfo(np.int64).max

Piece = tuple[int | None, int, bytes, int]  # document, ids before it, its ids, the document's ids


@dataclass
class Packer:
    """Windows of `size` ids; take() and close() give finished sequences, each a list of pieces."""

    size: int
    cut_price: int = 16
    counts: np.ndarray = field(init=False)
    windows: list[list[list[Piece]]] = field(init=False)

    def __post_init__(self):
        self.counts = np.zeros(self.size + 1, np.int64)
        self.windows = [[] for _ in range(self.size)]

    def take(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        total, step = len(ids) // 4, self.size * 4
        whole = total // self.size
        for i in range(whole):
            yield [(doc, i * self.size, ids[i * step : (i + 1) * step], total)]
        if total % self.size:
            yield from self._place((doc, whole * self.size, ids[whole * step :], total))

    def level_for(self, n: int) -> tuple[int, bool]:
        """The fill level that n ids go to (0: a new window), and whether they are cut there because they are too many."""
        c, size = self.counts, self.size
        last = size - n
        change = 2 * c[n : size + 1] + 1  # the level that gains a window, for levels 0 to last
        change[-1] = 0  # a full window is not counted
        change[1:] -= 2 * c[1 : last + 1] - 1
        change[1:][c[1 : last + 1] == 0] = NEVER
        best = last - int(change[::-1].argmin())
        least = change[best]
        if n > 1 and least > self.cut_price + 2 - 2 * int(c.max()):  # less no cut can be
            cut = 2 * (c[1:n] - c[last + 1 : size]) + 2 + self.cut_price  # level last + r is filled, and level r gains the tail
            cut[c[last + 1 : size] == 0] = NEVER
            r = n - 2 - int(cut[::-1].argmin())
            if cut[r] < least:
                return last + 1 + r, True
        return best, False

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        n = len(piece[2]) // 4
        level, cut = self.level_for(n)
        window = self._take_out(level) if level else []
        if cut:
            piece, tail = _cut(piece, self.size - level)
            self._put([tail])
        window.append(piece)
        if cut or level + n == self.size:
            yield window
        else:
            self._put(window)

    def _take_out(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        return self.windows[level].pop()

    def _put(self, window: list[Piece]) -> None:
        level = sum(len(p[2]) for p in window) // 4
        self.windows[level].append(window)
        self.counts[level] += 1

    def _recut(self):
        """Yields full windows of all that is open; returns the pieces left over, fewer ids than a window."""
        pieces = [p for level in self.windows for window in level for p in window]
        self.__post_init__()
        window: list[Piece] = []
        room = self.size
        for piece in pieces:
            while piece:
                head, piece = _cut(piece, room)
                window.append(head)
                room -= len(head[2]) // 4
                if not room:
                    yield window
                    window, room = [], self.size
        return window

    def close(self) -> Iterator[list[Piece]]:
        """What is open: full windows, then sequences of falling powers of two."""
        rest = yield from self._recut()
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                head, tail = _cut(rest.pop(0), room)
                window.append(head)
                room -= len(head[2]) // 4
                if tail:
                    rest.insert(0, tail)
            yield window


def _cut(piece: Piece, room: int) -> tuple[Piece, Piece | None]:
    doc, start, ids, total = piece
    if len(ids) <= room * 4:
        return piece, None
    return (doc, start, ids[: room * 4], total), (doc, start + room, ids[room * 4 :], total)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, cut_price: int = 16, with_ids: bool = True, added: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (little-endian unsigned 32-bit).

    added: the file's added tokens are found in texts, as its library does; else their strings are ordinary text.
    """
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data
    longs = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([*((c, pa.int64()) for c in longs), *([("ids", pa.binary())] if with_ids else [])])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of("json", data.value, added)
        packer = Packer(size, cut_price)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def add(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at, *([ids] if with_ids else [])))
                at += n
            sequence += 1

        def ready() -> pa.RecordBatch:
            out = batch_of(schema, *zip(*rows, strict=True))
            rows.clear()
            return out

        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([t.decode() for t in texts]), strict=True):
                    for window in packer.take(doc, ids + end):
                        add(window)
                        if len(rows) >= 1000:
                            yield ready()
        for window in packer.close():
            add(window)
        if rows:
            yield ready()

    kinds = ", ".join(f"`{c}` bigint" for c in longs) + (", ids binary" if with_ids else "")
    return text_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, kinds)
