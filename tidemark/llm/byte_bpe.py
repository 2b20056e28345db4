"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-tokenisation uses no regex. Each code point gets a class from an array; a symbol adds what the
pattern looks ahead for (does white space end here, does a contraction begin here). Every symbol is
a function from automaton states to automaton states, and functions compose associatively, so a
blocked prefix scan over a small table of composed functions gives the state before every code point,
and with it every boundary. The slices between boundaries are looked up in a bounded cache; slices that
are new to it are merged together, as rows of a matrix, lowest rank first and leftmost first.

Defined results: null and empty texts have no ids; equal texts have equal ids; special-token strings are
ordinary text, unless an encoder is asked for the added tokens of its file: then texts are cut at them, and what lies
between is encoded by itself. Ties of rank go to the leftmost pair.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of, chunks, distinct_spans
from .store import text_map

# Classes of code points. Fixed value: the code points that \s stands for.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, WHITESPACE, BREAK = range(5)

# Symbols: a class with what follows it.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE_LAST, S_WHITE_LAST, S_WHITE, S_BREAK = range(9)

# States: what stands before a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, HAS_SPACE, IN_WHITE, NEEDS_1, NEEDS_2 = range(8)
N_STATES, N_SYMBOLS = 8, 9


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this code point."""
    if symbol == S_BREAK:
        return FRESH, True
    if symbol in (S_SPACE_LAST, S_WHITE_LAST):
        return (HAS_SPACE if symbol == S_SPACE_LAST else FRESH), True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LETTER:
        if state in (NEEDS_1, NEEDS_2):
            return (FRESH if state == NEEDS_1 else NEEDS_1), False
        return IN_LETTERS, state not in (IN_LETTERS, HAS_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, HAS_SPACE)
    joined = state in (IN_OTHERS, HAS_SPACE)
    if symbol in (S_QUOTE1, S_QUOTE2) and not joined:
        return (NEEDS_1 if symbol == S_QUOTE1 else NEEDS_2), True
    return IN_OTHERS, not joined


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to: products [f * N_SYMBOLS + s] (f, then s), values [f, state]; products of two [f, g]."""
    step = [tuple(_step(q, s)[0] for q in range(N_STATES)) for s in range(N_SYMBOLS)]
    found = [tuple(range(N_STATES))]
    index = {found[0]: 0}
    product: list[list[int]] = []
    for f in found:
        row = []
        for s in range(N_SYMBOLS):
            g = tuple(step[s][q] for q in f)
            if g not in index:
                index[g] = len(found)
                found.append(g)
            row.append(index[g])
        product.append(row)
    assert len(found) < 256
    both = np.array([[index[tuple(g[q] for q in f)] for g in found] for f in found], np.uint8)
    return np.array(product, np.uint8).ravel(), np.array(found, np.uint8), both


PRODUCT, VALUE, COMPOSED = _monoid()
STARTS = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(N_STATES)]).ravel()

# Letters and numbers that Unicode 16 added. Python 3.13 has Unicode 15.1; both libraries go by Unicode 16.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point under Unicode 16; built once a process."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE] = WHITESPACE
        for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
            for a, b in ranges:
                table[a : b + 1] = kind
        _classes.append(table)
    return _classes[0]


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """codes: code points, with one at each of `breaks` that belongs to no text (so that look-ahead ends there)."""
    kind = classes()[codes]
    kind[breaks] = BREAK
    out = kind.copy()
    out[kind == BREAK] = S_BREAK
    white = np.flatnonzero(kind == WHITESPACE)
    after = kind[np.minimum(white + 1, len(kind) - 1)]
    last = (after != WHITESPACE) & (after != BREAK)
    out[white] = np.where(last, np.where(codes[white] == 0x20, S_SPACE_LAST, S_WHITE_LAST), S_WHITE)
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[kind[quote] != BREAK]
    if len(quote):
        end = len(codes) - 1
        a, b = codes[np.minimum(quote + 1, end)], codes[np.minimum(quote + 2, end)]
        free = kind[np.minimum(quote + 1, end)] == LETTER
        free2 = free & (kind[np.minimum(quote + 2, end)] == LETTER)
        # Fixed values of the pattern: 's 't 'm 'd, 're 've 'll.
        one = np.isin(a, [ord(c) for c in "stmd"]) & free
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & free2
        out[quote] = np.where(one, S_QUOTE1, np.where(two, S_QUOTE2, S_OTHER))
    return out


def states(sym: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked prefix scan of composed functions."""
    n = len(sym)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    padded = np.full(rows * width, S_BREAK, np.uint8)
    padded[:n] = sym
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)  # a column of `rows` blocks at each place in a block
    before = np.empty((width, rows), np.uint8)
    f = np.zeros(rows, np.uint16)
    for i in range(width):  # within all blocks at once
        before[i] = f
        f = PRODUCT[f * N_SYMBOLS + grid[i]].astype(np.uint16)
    entry = np.empty(rows, np.uint8)
    q = FRESH
    for b, g in enumerate(f.tolist()):  # across blocks
        entry[b] = q
        q = VALUE[g, q]
    return VALUE[before, entry[None, :]].T.ravel()[:n]


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where slices begin, the breaks among them."""
    sym = symbols(codes, breaks)
    return np.flatnonzero(STARTS[states(sym) * np.uint8(N_SYMBOLS) + sym])


NO_PAIR = np.int64(2**62)


class Pairs:
    """Hash table from pairs of ids to rank << 32 | id of the merge."""

    BITS = 20
    FREE = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        values = (rank.astype(np.int64) << 32) | merged.astype(np.int64)
        size = 1 << self.BITS
        self.keys = np.full(size + 64, self.FREE)
        self.values = np.full(size + 64, NO_PAIR)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.reach = 0
        while len(todo):
            at = slot[todo] + self.reach
            _, firsts = np.unique(at, return_index=True)
            take = np.zeros(len(todo), bool)
            take[firsts] = True
            take &= self.keys[at] == self.FREE
            won = todo[take]
            self.keys[at[take]], self.values[at[take]] = keys[won], values[won]
            todo = todo[~take]
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        there = self.keys[at]
        hit = there == keys
        out = np.where(hit, self.values[at], NO_PAIR)
        left_over = np.flatnonzero(~hit & (there != self.FREE))
        for d in range(1, self.reach):
            if not len(left_over):
                break
            to = at[left_over] + d
            there = self.keys[to]
            hit = there == keys[left_over]
            out[left_over[hit]] = self.values[to[hit]]
            left_over = left_over[~hit & (there != self.FREE)]
        return out


#: Bytes of text that are cut and looked up at once.
CHUNK = 1_000_000
#: Slices of more bytes than this are merged one by one, by a heap.
LONG = 64


class Vocabulary:
    """Ids of bytes, pairs that merge, and the bytes of each id with their offsets."""

    def __init__(self, tokens: dict[bytes, int], pairs: Iterable[tuple[bytes, bytes, int]], whole: bool, added: dict[str, int] | None = None):
        """pairs: left, right and rank of each merge; whole: a slice that is a token needs no merging; added: tokens at which texts are cut."""
        self.added = added or {}
        self.ids = tokens if whole else {}
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = list(pairs)
        self.pairs = Pairs(*(np.array(x, np.int64) for x in zip(*((tokens[a], tokens[b], r, tokens[a + b]) for a, b, r in pairs), strict=True)))
        self.pair_rank = {(tokens[a], tokens[b]): (r, tokens[a + b]) for a, b, r in pairs}
        by_id = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.added.items()}
        size = max(by_id) + 1
        self.lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    @classmethod
    def from_ranks(cls, data: bytes) -> Vocabulary:
        """The text of a .tiktoken file: a token (base64) and its rank a line. Any two tokens that together are a token merge."""
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        pairs = ((t[:i], t[i:], r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens)
        return cls(tokens, pairs, whole=True)

    @classmethod
    def from_json(cls, data: bytes, added: bool = False) -> Vocabulary:
        """The text of a byte-level BPE tokenizer.json: its vocabulary and its list of merges; added: its added tokens, too."""
        file = json.loads(data)
        model = file["model"]
        extra = (file.get("added_tokens") or []) if added else []
        if any(t.get(k) for t in extra for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        to_byte = {}
        spare = 0
        for b in range(256):  # printable bytes stand for themselves, the rest for code points from 256
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
                to_byte[chr(b)] = b
            else:
                to_byte[chr(256 + spare)] = b
                spare += 1
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"] if all(c in to_byte for c in t)}
        tokens = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(raw[a], raw[b], r) for r, (a, b) in enumerate(merges)]
        tokens = {t: i for t, i in tokens.items() if not (t.startswith(b"<|") and t.endswith(b"|>") and len(t) > 4)} | {bytes([b]): tokens[bytes([b])] for b in range(256)}
        return cls(tokens, pairs, whole=False, added={t["content"]: t["id"] for t in extra})

    def merge_long(self, slice_: bytes) -> list[int]:
        """One slice, by a heap of pairs over a linked list."""
        import heapq

        ids = self.byte_ids[np.frombuffer(slice_, np.uint8)].tolist()
        n = len(ids)
        after, prior = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.pair_rank[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                prior[after[i]] = i
            for x, y in ((prior[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.pair_rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge(self, slices: list[bytes]) -> list[bytes]:
        """The ids of each slice, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(slices)
        todo = []
        for i, s in enumerate(slices):
            if (whole := self.ids.get(s)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(s) > LONG:
                out[i] = np.array(self.merge_long(s), "<u4").tobytes()
            else:
                todo.append(i)
        length = [*map(len, slices)].__getitem__
        for at in range(0, len(todo), 8192):
            part = sorted(todo[at : at + 8192], key=length)
            for lo in range(0, len(part), 1024):
                rows = part[lo : lo + 1024]
                for i, ids in zip(rows, self._merge_rows([slices[i] for i in rows]), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, slices: list[bytes]) -> list[bytes]:
        """Rows of ids and, for each adjacent pair, rank << 32 | merged id (NO_PAIR: none); every round merges the least pair of each row that has one."""
        lengths = np.array([len(s) for s in slices])
        width = int(lengths.max())
        ids = np.full((len(slices), width + 1), -1, np.int32)
        inside = np.arange(width + 1)[None, :] < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(slices), np.uint8)]
        pairs = np.full((len(slices), width), NO_PAIR, np.int64)
        at = inside[:, 1:]
        pairs[at] = self.pairs.find(ids[:, :-1][at], ids[:, 1:][at])
        done_ids, done_rows = [], []
        rows = np.arange(len(slices))
        places = np.arange(width + 1, dtype=np.int32)
        while len(rows):
            best = pairs.argmin(1)
            line = np.arange(len(rows))
            top = pairs[line, best]
            more = top != NO_PAIR
            if not more.all():  # rows that are ready leave
                done_ids.append(ids[~more])
                done_rows.append(rows[~more])
                ids, pairs, rows, best, top = ids[more], pairs[more], rows[more], best[more], top[more]
                line = line[: len(rows)]
                if not len(rows):
                    break
            ids[line, best] = (top & 0xFFFFFFFF).astype(np.int32)
            # everything right of the pair moves one place left
            moved = places[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            moved[line, best] = True
            pairs[:, :-1] = np.where(moved[:, :-1], pairs[:, 1:], pairs[:, :-1])
            pairs[:, -1] = NO_PAIR
            r, s = np.concatenate((line[best > 0], line)), np.concatenate((best[best > 0] - 1, best))
            a, b = ids[r, s], ids[r, s + 1]
            new = self.pairs.find(a, b)
            new[b < 0] = NO_PAIR
            pairs[r, s] = new
        out: list[bytes] = [b""] * len(slices)
        for ids, rows in zip(done_ids, done_rows, strict=True):
            got = ids >= 0
            flat = ids[got].astype("<u4").tobytes()
            at = 0
            for row, n in zip(rows.tolist(), (got.sum(1) * 4).tolist(), strict=True):
                out[row] = flat[at : at + n]
                at += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered by the offsets of the vocabulary."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


class Encoder:
    """Whole texts to ids. The cache holds `most` slices in each of two generations."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        added = sorted(vocabulary.added, key=len, reverse=True)  # the leftmost, and of those that begin there the longest
        self.cuts = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _ids(self, slices: list[str]) -> list[bytes]:
        """The ids of distinct slices, from the cache or merged now."""
        found = list(map(self.young.get, slices))
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            if (known := self.old.get(slices[i])) is not None:
                found[i] = known
            else:
                new.append(i)
        for i, x in zip(new, self.vocabulary.merge([slices[i].encode() for i in new]), strict=True):
            found[i] = x
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((slices[i], found[i]) for i in missing)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.cuts is None:
            return self._encode_plain(texts)
        parts = [self.cuts.split(t) for t in texts]  # plain text and added tokens by turns
        plain = iter(self._encode_plain([x for p in parts for x in p[::2]]))
        return [b"".join(self.vocabulary.added[x].to_bytes(4, "little") if i % 2 else next(plain) for i, x in enumerate(p)) for p in parts]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """encode() of texts in which no added token is looked for. Slices that occur again in these texts are looked up once."""
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = boundaries(codes, breaks)
        ends = np.append(starts[1:], len(codes))
        stops = np.searchsorted(starts, breaks)  # the breaks are no slices
        own = np.ones(len(starts), bool)
        own[stops] = False
        starts, ends = starts[own], ends[own]
        first = np.concatenate(([0], stops - np.arange(len(texts))))
        at, which = distinct_spans(codes.view(np.uint8), starts * 4, ends * 4)
        found = self._ids([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) >> 2 for x in found], np.int64)
        offset = np.cumsum(size) - size
        many = size[which]
        total = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(offset[which] - total[:-1], many) + np.arange(total[-1])].tobytes()
        cut = (total[first] * 4).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


_encoders: dict[tuple, Encoder] = {}


def encoder_of(kind: str, data: bytes, added: bool = False) -> Encoder:
    """One encoder for each vocabulary in a Python worker. added: with the added tokens of a JSON file."""
    key = (kind, added, hashlib.sha256(data).digest())
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary.from_ranks(data) if kind == "ranks" else Vocabulary.from_json(data, added))
    return _encoders[key]


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit), decoded (binary)."""
    return _run(docs, ranks_path, digest=False)


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encode_decode(), with only the digests leaving the workers."""
    return _run(docs, ranks_path, digest=True)


def _run(docs: DataFrame, ranks_path: str, digest: bool) -> DataFrame:
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of("ranks", data.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                ids = encoder.encode([t.decode() for t in texts])
                decoded = [encoder.vocabulary.decode(np.frombuffer(x, "<u4")) for x in ids]
                if digest:
                    yield batch_of(schema, part.column(0), [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x) for x in decoded])
                else:
                    yield batch_of(schema, part.column(0), ids, decoded)

    return text_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids binary, decoded binary")
