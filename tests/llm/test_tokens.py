import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe as bb
from tidemark.llm import packing
from tidemark.llm.queries import op7_byte_bpe, op10_packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def mine():
    return bb.Encoder(bb.Vocabulary.from_ranks(open(RANKS, "rb").read()), most=500)


@pytest.fixture(scope="module")
def mine_json():
    return bb.Encoder(bb.Vocabulary.from_json(open(JSON, "rb").read(), added=True), most=500)


REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
TOKENIZER = Tokenizer.from_file(JSON)

ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "-", "　", "\x85", "\x1c", "中", "́", "١", "'s", "'ll", "<|endoftext|>", "\0", "\U000135e7", "🙂"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET) | st.characters(exclude_categories=["Cs"]), max_size=25).map("".join), min_size=1, max_size=6))
def test_like_the_libraries(texts):
    v = _cached("ranks")
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(t)
        assert v.vocabulary.decode(np.frombuffer(ids, "<u4")).decode() == t
    for t, ids in zip(texts, _cached("json").encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_every_code_point():
    """Each code point between letters, digits and signs, in both vocabularies."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}, {chr(c)}{chr(c)}b " for c in points[lo : lo + 2000]) for lo in range(0, len(points), 2000)]
    for v, plain in ((_cached("ranks"), REFERENCE.encode_ordinary), (_cached("json"), lambda t: TOKENIZER.encode(t, add_special_tokens=False).ids)):
        for t, ids in zip(texts, v.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(t)


def _cached(kind):
    return bb.encoder_of(kind, open(RANKS if kind == "ranks" else JSON, "rb").read(), added=kind == "json")


@pytest.mark.parametrize("t", ["a" * 5000, "!" * 3000, " " * 3000, "xyz" * 2000, "é" * 700, "\n" * 100 + "x", ""])
def test_long_slices(mine, mine_json, t):
    assert np.frombuffer(mine.encode([t])[0], "<u4").tolist() == REFERENCE.encode_ordinary(t)
    assert np.frombuffer(mine_json.encode([t])[0], "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing(mine):
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = REFERENCE.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, odd_docs):
    got = bb.encode_decode(odd_docs, RANKS).collect()
    texts = sorted((r["text"] or "").encode() for r in odd_docs.collect())
    assert sorted(bytes(r["decoded"]) for r in got) == texts
    assert bb.encode_digests(odd_docs.limit(0), RANKS).collect() == []


# ---- packing


def check_packing(rows, docs, size=1024):
    """docs: [(id, ids)], an id once."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, ids in docs:
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packs_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], TOKENIZER.encode(r["text"], add_special_tokens=False).ids + [0]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(op10_packing(spark, sf).collect(), docs) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(0, 20))
def test_packer_loses_nothing(lengths, cut_price):
    packer = packing.Packer(16, cut_price)
    docs = [(i, list(range(i, i + n))) for i, n in enumerate(lengths)]
    windows = []
    for i, ids in docs:
        windows += packer.take(i, np.array(ids, "<u4").tobytes())
    windows += packer.close()
    rows = []
    for s, window in enumerate(windows):
        at = 0
        for doc, start, ids, total in window:
            rows.append({"doc_id": doc, "start": start, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "doc_tokens": total, "sequence_id": s, "offset": at})
            at += len(ids) // 4
    assert check_packing(rows, docs, 16) == 0


def test_level_is_the_one_of_least_sum_of_squares():
    rng = np.random.default_rng(0)
    p = packing.Packer(32, 6)
    cuts = 0
    for _ in range(600):
        p.counts = rng.integers(0, 7, 33)
        p.counts[0] = p.counts[32] = 0
        n = int(rng.integers(1, 32))

        def after(level, cut):
            c = p.counts.copy()
            if level:
                c[level] -= 1
            if cut:
                c[level + n - 32] += 1
            elif level + n < 32:
                c[level + n] += 1
            return int((c**2).sum()) + 6 * cut

        able = [(0, False), *((h, h + n > 32) for h in range(1, 32) if p.counts[h])]
        level, cut = p.level_for(n)
        cuts += cut
        assert (level, cut) in able and after(level, cut) == min(after(*x) for x in able)
    assert cuts > 20


@pytest.mark.parametrize("kind", ["one length", "two lengths", "few lengths", "long ones", "any"])
def test_few_windows_stay_open(kind):
    """Lengths whose complements never come: a level has never more than some cut_price / 2 windows, however many documents there are."""
    rng = np.random.default_rng(1)
    size = 64
    draws = {"one length": [[n] for n in range(1, size)], "two lengths": [[n, m] for n in range(33, size, 5) for m in range(1, size, 7)], "few lengths": [rng.integers(33, size, 4) for _ in range(20)], "long ones": [range(33, size)], "any": [range(1, size)]}[kind]
    for lengths in draws:
        packer = packing.Packer(size)
        for i, n in enumerate(rng.choice(list(lengths), 2500).tolist()):
            for _ in packer.take(i, bytes(4 * n)):
                pass
            assert packer.counts.max() <= 10


def test_packs_odd_rows(spark, odd_docs):
    got = packing.pack(odd_docs, JSON, added=True).collect()
    assert sum(r["length"] for r in got) == sum(len(TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(odd_docs.limit(0), JSON).collect() == []


def test_queries_find_the_added_tokens(spark, tmp_path):
    """The unmodified library: its file's added tokens count inside texts, even with add_special_tokens=False."""
    import corpus_pipeline

    library = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "it's  <|endoftext|>'s\n", "<|endoftext|", "<|<|endoftext|>|>", "", "plain words only", "wörter <|endoftext|> 中文 " * 400]
    docs = [(i, library.encode(t, add_special_tokens=False).ids + [0]) for i, t in enumerate(texts)]
    assert docs[0][1] == [64, 220, 50256, 275, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert check_packing(op10_packing(spark, str(tmp_path)).collect(), docs) == 0
    assert check_packing(corpus_pipeline.pack(spark, df, str(tmp_path)).collect(), docs) == 0
    encoder = bb.encoder_of("json", open(JSON, "rb").read(), added=True)
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert encoder.vocabulary.decode(np.frombuffer(ids, "<u4")).decode() == t
