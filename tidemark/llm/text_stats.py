"""Rule statistics of whole texts, exact and vectorised; quality rules and the quality classifier share them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernel import C1, LOWER, U64, Words, batch_of, chunks, mix, ranges, repeated

#: Fixed values of the contract: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_PUNCT = np.zeros(256, bool)
IS_PUNCT[list(b".,;:!?\"'()[]-")] = True
IS_HEAD = (np.arange(256) & 0xC0) != 0x80

BASE_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_FIELDS = ["n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_exclaim", "n_unique_words", "longest_word", "n_unique_lower", "n_short_words"]
FIELDS = BASE_FIELDS + MORE_FIELDS


def line_stats(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def distinct_per_doc(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct keys of each document; sorts once, the document in the top bits' place."""
    keys = (keys & U64((1 << 44) - 1)) | (doc.astype(U64) << U64(44))
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> U64(44)).astype(np.int64), minlength=n_docs)


def window_repeats(words: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a window of five words found twice or more in it. words: a number for each, equal for equal words only.

    Windows of one hash are compared word by word; should two differ, the windows themselves tell them apart.
    """
    n = len(words)
    if n < 5:
        return np.zeros(len(first) - 1, np.int64)
    m = n - 4
    keys = doc[:m].astype(U64)
    for k in range(5):
        keys = mix(keys * C1 + words[k : m + k].astype(U64))
    inside = np.flatnonzero(doc[:m] == doc[4:])
    twice = inside[repeated(keys[inside])]
    order = twice[np.argsort(keys[twice], kind="stable")]
    a, b = order[:-1], order[1:]
    a, b = a[keys[a] == keys[b]], b[keys[a] == keys[b]]
    if (doc[a] != doc[b]).any() or any((words[a + k] != words[b + k]).any() for k in range(5)):
        exact = [(int(doc[i]), *words[i : i + 5].tolist()) for i in inside.tolist()]
        many = Counter(exact)
        twice = inside[[many[x] > 1 for x in exact]]
    cover = np.bincount(twice, minlength=n + 1)
    cover -= np.bincount(twice + 5, minlength=n + 1)
    return ranges(np.cumsum(cover)[:n] > 0, first)


def stats(texts: list[bytes], more: bool = True) -> dict[str, np.ndarray]:
    """FIELDS (or BASE_FIELDS) for each text, as whole numbers."""
    w = Words(texts)
    n_docs = len(texts)
    doc = w.doc_of_word()
    words = w.ids()
    head = IS_HEAD[w.buf]
    dup = np.array([line_stats(t) for t in texts], np.int64).reshape(n_docs, 2)
    out = {
        "n_words": np.diff(w.first),
        "word_chars": w.per_doc(head & ~w.space),
        "n_symbols": w.per_doc(IS_SYMBOL[w.buf]),
        "n_dup_lines": dup[:, 1],
        "n_repeat_words": window_repeats(words, w.first, doc),
    }
    if more:
        chars = np.zeros(len(head) + 1, np.int64)
        np.cumsum(head, out=chars[1:])
        length = chars[w.ends] - chars[w.starts]
        longest = np.zeros(n_docs, np.int64)
        some = np.flatnonzero(np.diff(w.first))
        if len(some):
            longest[some] = np.maximum.reduceat(length, w.first[some])
        lower = Words(texts, fold=LOWER)
        out |= {
            "n_chars": w.per_doc(head) - 1,
            "n_lines": dup[:, 0],
            "n_upper": w.per_doc(IS_UPPER[w.buf]),
            "n_digits": w.per_doc(IS_DIGIT[w.buf]),
            "n_punct": w.per_doc(IS_PUNCT[w.buf]),
            "n_exclaim": w.per_doc(w.buf == 33),
            "n_unique_words": distinct_per_doc(words.astype(U64), doc, n_docs),
            "longest_word": longest,
            "n_unique_lower": distinct_per_doc(lower.hashes(), doc, n_docs),
            "n_short_words": ranges(length <= 2, w.first),
        }
    return out


def mapper(fields: list[str]):
    """For mapInArrow over (doc_id, text): doc_id and the statistics named."""
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.int64()) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                got = stats(texts, more=any(f in MORE_FIELDS for f in fields))
                yield batch_of(schema, part.column(0), *(got[f] for f in fields))

    return run, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in fields)
