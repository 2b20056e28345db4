"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes. Runs of one symbol become one symbol; then deterministic coin tossing turns each symbol, by
the lowest bit in which it differs from the next one, into ever smaller labels, until at most ten are left; local maxima of
the labels begin phrases, and a phrase's name is a hash of its symbols. The names are the next level's symbols. A boundary
depends on a few neighbours only, so equal substrings have equal phrases but for a few at their ends, wherever they stand.

A fingerprint holds, for each of three levels, the number of phrases and a one-permutation sketch of their names. Two
fingerprints are compared on the coarsest level of which both have enough phrases.

Defined results: null and empty texts are the empty text, which is like itself (1.0) and nothing else. Equal texts have
equal fingerprints. Rows that share a doc_id follow each other by text; rows without doc_id come last. A table of
one row has itself as next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import C1, U64, batch_of, mix
from .store import text_map

LEVELS = 3
BINS = 64
ENOUGH = 16
SEP = 0xFF  # no byte of UTF-8
TOP = 31  # the label of a separator

_rng = np.random.Generator(np.random.PCG64(20240605))
#: A random odd name for each byte.
BYTE_CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            x = np.full(size, base & (2**64 - 1), U64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def phrase_names(names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of names[start:end] for each phrase: a polynomial modulo 2**64, mixed.

    Phrases lie between local maxima of at most ten labels, so that none is longer than some twenty symbols; sequences
    on which such polynomials collide whatever their base are of a thousand and more.
    """
    n = len(names)
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(names * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


LOW_BIT = np.array([x & -x for x in range(256)], np.uint8)
LOW_INDEX2 = np.array([2 * ((x & -x).bit_length() - 1) if x else 14 for x in range(256)], np.uint8)
_DEBRUIJN = 0x03F79D71B4CB0A89
INDEX64 = np.zeros(64, np.uint8)
for _i in range(64):
    INDEX64[((_DEBRUIJN << _i) & (2**64 - 1)) >> 58] = 2 * _i


def _toss(a: int, b: int) -> int:
    """The label of a before b: twice the lowest differing bit's index, and that bit of a."""
    if a == TOP:
        return TOP
    low = (a ^ b) & -(a ^ b)
    return 2 * max(low.bit_length() - 1, 0) + bool(a & low)


TOSS = np.array([[_toss(a, b) for b in range(32)] for a in range(32)], np.uint8).ravel()


def _begins(symbols: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Where phrases begin, for small symbols of which neighbours differ; sep: the separators' places."""
    n = len(symbols)
    label = np.empty(n, np.uint8)
    x = symbols[:-1] ^ symbols[1:]
    label[:-1] = LOW_INDEX2[x] | ((symbols[:-1] & LOW_BIT[x]) != 0)
    label[-1] = TOP
    label[sep] = TOP
    for _ in range(3):
        label[:-1] = TOSS[(label[:-1].astype(np.uint16) << 5) | label[1:]]
    begin = np.zeros(n, bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[sep] = True
    begin[sep[sep + 1 < n] + 1] = True
    begin[0] = True
    return begin


def parse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: the phrases' names of all texts, and where each text's begin, with their number as last."""
    buf = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)
    small, names = buf, None
    sep = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    out = []
    for _ in range(LEVELS):
        n = len(small if names is None else names)
        source = small if names is None else names
        keep = np.empty(n, bool)
        keep[0] = True
        np.not_equal(source[1:], source[:-1], out=keep[1:])
        keep[sep] = True
        if not keep.all():  # runs become one symbol
            heads = np.flatnonzero(keep)
            length = np.diff(np.append(heads, n))
            sep = np.searchsorted(heads, sep)
            source = source[heads]
            names = BYTE_CODES[source] if names is None else source.copy()
            runs = np.flatnonzero(length > 1)
            names[runs] = mix(names[runs] + length[runs].astype(U64) * C1)
        elif names is None:
            names = BYTE_CODES[source]
        if source.dtype != np.uint8:
            x = names[:-1] ^ names[1:]
            low = x & (~x + U64(1))
            small = np.empty(len(names), np.uint8)
            small[:-1] = INDEX64[(low * U64(_DEBRUIJN)) >> U64(58)] | ((names[:-1] & low) != 0)
            small[sep] = SEP
        else:
            small = source
        starts = np.flatnonzero(_begins(small, sep))
        names = phrase_names(names, starts, np.append(starts[1:], len(names)))
        sep = np.searchsorted(starts, sep)
        names[sep] = 0
        own = np.ones(len(names), bool)
        own[sep] = False
        out.append((names[own], sep - np.arange(len(sep))))
        small = None
    return out


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[text, level] numbers of phrases, and [text, level, bin] sketches: 0 for an empty bin, else 1 to 255."""
    counts = np.zeros((len(texts), LEVELS), np.int64)
    sketches = np.zeros((len(texts) * BINS, LEVELS), np.uint8)
    for k, (names, at) in enumerate(parse(texts)):
        counts[:, k] = np.diff(at)
        doc = np.repeat(np.arange(len(texts), dtype=U64), counts[:, k])
        keys = (doc << U64(6) | names & U64(63)) << U64(40) | names >> U64(24)
        keys.sort()
        first = np.ones(len(keys), bool)
        np.not_equal(keys[1:] >> U64(40), keys[:-1] >> U64(40), out=first[1:])
        keys = keys[first]
        sketches[(keys >> U64(40)).astype(np.int64), k] = (keys & U64((1 << 40) - 1)) % U64(255) + U64(1)
    return counts, sketches.reshape(len(texts), BINS, LEVELS).transpose(0, 2, 1)


def likeness(counts: np.ndarray, sketches: np.ndarray, other_counts: np.ndarray, other_sketches: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of phrase sets, row by row."""
    both = np.minimum(counts, other_counts) >= ENOUGH
    level = np.where(both.any(1), LEVELS - 1 - both[:, ::-1].argmax(1), 0)
    rows = np.arange(len(counts))
    a, b = sketches[rows, level], other_sketches[rows, level]
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    equal = (counts == other_counts).all(1) & (sketches == other_sketches).all((1, 2))
    return np.where(equal, 1.0, same / np.maximum(used, 1))


def as_strings(counts: np.ndarray, sketches: np.ndarray) -> list[str]:
    flat = np.ascontiguousarray(np.concatenate([counts.astype(">u4").view(np.uint8).reshape(len(counts), -1), sketches.reshape(len(sketches), -1)], 1))
    return [row.tobytes().hex() for row in flat]


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return raw[: 4 * LEVELS].view(">u4").astype(np.int64)[None, :], raw[4 * LEVELS :].reshape(1, LEVELS, BINS)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _places(splits: list[int]):
    """A column of the buckets that a doc_id goes to: its own, which ends at the first split that isn't less, and as a copy the next one if it is a split itself."""
    at = np.array(splits, np.int64)
    size = max(len(at), 1)

    @F.pandas_udf("array<struct<bucket:int,copy:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        x = ids.where(known, 0).astype("int64").to_numpy()
        bucket = np.where(known, np.searchsorted(at, x), 0)  # none is above the last split
        copied = (known & (at[np.minimum(bucket, size - 1)] == x)) if len(at) else np.ones(len(x), bool)
        return pd.Series([[{"bucket": b, "copy": False}, {"bucket": (b + 1) % size, "copy": True}] if c else [{"bucket": b, "copy": False}] for b, c in zip(bucket.tolist(), copied.tolist(), strict=True)])

    return places


#: Bytes of text that are worth a bucket.
BUCKET_BYTES = 64 << 20


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in runs of descending doc_id: bucket, copy, doc_id, text, sorted within partitions.

    A bucket is a range of ids between quantiles that are ids themselves; the document that follows a bucket's last one
    comes along as a copy (copy: true), the first document of all after the last. There are as many buckets as shuffle partitions, or as
    many as BUCKET_BYTES go into the texts if that is more; only the quantiles come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    n = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.max("doc_id").alias("top")).first()
    splits = sorted({*(found["q"] or []), found["top"]} - {None})
    rows = rows.select("doc_id", "text", F.explode(_places(splits)("doc_id")).alias("place"))
    rows = rows.select(F.col("place.bucket").alias("bucket"), F.col("place.copy").alias("copy"), "doc_id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), "text")


MOST = 400_000


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def work(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """All rows but the last, which follows them."""
        texts = [t for _, t in rows]
        edits = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
        counts, sketches = fingerprints([t.encode() for t in texts] + edits)
        n = len(edits)
        mine, other, edit = (counts[:n], sketches[:n]), (counts[1 : n + 1], sketches[1 : n + 1]), (counts[n + 1 :], sketches[n + 1 :])
        return batch_of(schema, [i for i, _ in rows[:n]], [len(t) for t in texts[:n]], [hashlib.sha256(e).hexdigest() for e in edits], as_strings(*mine), as_strings(*edit), likeness(*mine, *edit), likeness(*mine, *other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, now = 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                for bucket, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(lo, 128).columns), strict=True):
                    if bucket != now:
                        now, held, size = bucket, [], 0
                    if copy and not held:
                        continue  # a further copy, or nothing to follow
                    held.append((doc_id, text))
                    size += len(text)
                    if copy or size > MOST and len(held) > 1:
                        yield work(held)
                        held = [] if copy else held[-1:]
                        size = len(text)

    return text_map(with_next(docs), run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
