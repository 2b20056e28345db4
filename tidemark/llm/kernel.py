"""Vectorised text primitives that the operators share: Arrow chunking, word spans, span hashes.

Texts are handled as concatenated UTF-8 bytes, a chunk of documents at a time, with one ``\\n``
after every document, so that no word or line spans two of them. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 400_000

_rng = np.random.Generator(np.random.PCG64(20240601))
C1, C2, C3, C4, C5 = (U64(int(x) | 1) for x in _rng.integers(0, 2**63, 5, dtype=np.uint64))
#: The lowest i bytes of a lane.
LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Bytes of ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Lanes:
    """Spans of bytes as 8-byte lanes: the first one of each span, and all further ones of the spans that have some."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        self._at = np.ndarray(len(buf) + 1, np.uint64, padded, 0, (1,))
        self.starts, self.lengths = starts, ends - starts
        self.first = self._at[starts] & LANE_MASK[np.minimum(self.lengths, 8)]
        self.long = np.flatnonzero(self.lengths > 8)
        self.many = (self.lengths[self.long] - 1) >> 3
        total = np.cumsum(self.many)
        self.begin = total - self.many
        self.place = np.arange(total[-1] if len(total) else 0) - np.repeat(self.begin, self.many) + 1
        self._left = LANE_MASK[np.minimum(np.repeat(self.lengths[self.long], self.many) - 8 * self.place, 8)]
        self.rest = self.further(starts)

    def further(self, starts: np.ndarray) -> np.ndarray:
        """The further lanes, with the spans moved to other starts."""
        return self._at[np.repeat(starts[self.long], self.many) + 8 * self.place] & self._left

    def hashes(self) -> np.ndarray:
        """Every lane is mixed by itself with its place before they are added, so that nothing cancels between places."""
        out = mix(self.first ^ C3)
        if len(self.long):
            out[self.long] += np.add.reduceat(mix(self.rest ^ mix(self.place.astype(U64) * C1)), self.begin)
        return mix(out ^ self.lengths.astype(U64) * C2)

    def equal(self, other: np.ndarray) -> bool:
        """Whether each span i has the bytes of span other[i]."""
        starts = self.starts[other]
        if (self.lengths[other] != self.lengths).any() or (self.first[other] != self.first).any():
            return False
        return bool((self.further(starts) == self.rest).all())


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span of bytes."""
    return Lanes(buf, starts, ends).hashes()


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A span for each distinct string of bytes, and the number of its string for each span.

    Exact: spans of one hash are compared byte by byte; should two differ, the strings themselves tell them apart.
    """
    lanes = Lanes(buf, starts, ends)
    _, at, which = np.unique(lanes.hashes(), return_index=True, return_inverse=True)
    if not lanes.equal(at[which]):
        raw, index = buf.tobytes(), {}
        which = np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        at = np.unique(which, return_index=True)[1]
    return at, which


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about `most` bytes of text, one row at least, with their texts as UTF-8 (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.cast(pa.large_binary()).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield batch.slice(at, i - at), [x or b"" for x in texts[at:i]]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield batch.slice(at), [x or b"" for x in texts[at:]]


class Words:
    """The words of a chunk of documents: spans, and which belong to which document.

    buf: the bytes, a ``\\n`` after every document; doc_at: where each document begins, with the
    end as last; starts, ends: the spans of the words; first: the index of each document's first
    word, with the number of words as last.
    """

    def __init__(self, texts: list[bytes], spaces: np.ndarray = IS_SPACE, fold: np.ndarray | None = None):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.doc_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.doc_at[1:])
        self.raw = self.buf
        if fold is not None:
            self.buf = fold[self.buf]
        space = spaces[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.space, self.starts, self.ends = space, edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.doc_at)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def ids(self) -> np.ndarray:
        """A number for each word: equal ones for equal words of these texts, and for no others."""
        return distinct_spans(self.buf, self.starts, self.ends)[1]

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each document."""
        return ranges(mask, self.doc_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ranges(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], 0 where the range is empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return np.isin(keys, np.unique(twice))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
