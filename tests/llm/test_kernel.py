"""Words on which polynomial hashes modulo 2**64 collide whatever their base, and collisions by force."""

import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from test_classifiers import brute
from test_near_dedup import shingles
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, kernel, near_dedup, text_stats

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
TOKENIZER = Tokenizer.from_file(JSON)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def base_counts(texts):
    got = text_stats.stats([t.encode() for t in texts], more=False)
    return [tuple(int(got[f][i]) for f in text_stats.BASE_FIELDS) for i in range(len(texts))]


def check_all(texts: list[str]) -> None:
    assert base_counts(texts) == [brute(t) for t in texts]
    for k in (3, 5):
        sets = near_dedup.shingle_sets([t.encode() for t in texts], k)
        plain = [shingles(t, k) for t in texts]
        for i in range(len(texts)):
            for j in range(i + 1):
                assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])
    ranks = byte_bpe.encoder_of("ranks", open(RANKS, "rb").read())
    for t, ids in zip(texts, ranks.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(t)
        assert ranks.vocabulary.decode(np.frombuffer(ids, "<u4")).decode() == t
    json = byte_bpe.encoder_of("json", open(JSON, "rb").read(), added=True)
    for t, ids in zip(texts, json.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
@pytest.mark.parametrize(("a", "b"), [("a", "b"), ("x", "Z"), ("é", "ü")])
def test_thue_morse_words(n, a, b):
    one, two = thue_morse(n, a, b), thue_morse(n, b, a)
    check_all([one, two, f"{one} 1 2 3 4 {two} 1 2 3 4", f"w {one} 1 2 3 w {two} 1 2 3 w {one} 1 2 3", f"{one} {two}"])


@settings(max_examples=15, deadline=None)
@given(st.integers(10, 12), st.sampled_from("abcxyz"), st.sampled_from("defuvw"), st.lists(st.sampled_from(["1", "2", "one", "two"]), max_size=12))
def test_thue_morse_words_among_others(log, a, b, words):
    one, two = thue_morse(1 << log, a, b), thue_morse(1 << log, b, a)
    check_all([" ".join([one, *words, two, *words]), " ".join([two, *words, one]), one + two, two + one])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\0é"), min_size=1, max_size=40), min_size=1, max_size=60))
def test_equal_words_and_no_others_have_equal_hashes(words):
    w = kernel.Words([" ".join(words).encode()])
    for keys in (w.hashes(), w.ids()):
        assert len(set(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))


def test_collisions_change_nothing(monkeypatch):
    """Hashes that nearly always collide: what is exact stays exact."""
    texts = ["a b c d e f a b c d e", "one two three four five six", "x y x y x y x y x y", "a longer word than eight bytes", ""]
    expected, ids = base_counts(texts), byte_bpe.Encoder(byte_bpe.Vocabulary.from_ranks(open(RANKS, "rb").read())).encode(texts)
    few = lambda x: x & np.uint64(1)
    for module in (kernel, text_stats):
        monkeypatch.setattr(module, "mix", few)
    assert base_counts(texts) == expected == [brute(t) for t in texts]
    assert byte_bpe.Encoder(byte_bpe.Vocabulary.from_ranks(open(RANKS, "rb").read())).encode(texts) == ids
