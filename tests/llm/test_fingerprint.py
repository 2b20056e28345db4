import hashlib
import random

import numpy as np

from tidemark.llm import fingerprint as fp
from tidemark.llm.queries import op5_fingerprint


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op5_fingerprint(spark, sf).collect()}
    ids = sorted(docs, reverse=True)
    assert sorted(got) == sorted(docs)
    for i, k in enumerate(ids):
        text, following = docs[k], docs[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        counts, sketches = fp.fingerprints([t.encode() for t in (text, edit, following)])
        mine, edited, other = ((counts[j : j + 1], sketches[j : j + 1]) for j in range(3))
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(fp.as_strings(counts[:2], sketches[:2]))
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(*mine, *edited)[0], fp.likeness(*mine, *other)[0])
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert all(r["near_edited"] > r["near_next"] for r in long) and 0.28 < np.mean([r["near_edited"] for r in long]) < 0.4


def test_equal_substrings_share_phrases_at_any_offset():
    """The names of a passage's inner phrases are the same wherever it stands."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij ", k=3000))
    passage = word()
    alone = [set(n.tolist()) for n, _ in fp.parse([passage.encode()])]
    for shift in (1, 2, 3, 17, 1000):
        moved = [set(n.tolist()) for n, _ in fp.parse([(word()[:shift] + passage + word()[:shift]).encode()])]
        for a, b in zip(alone, moved, strict=True):
            assert len(a & b) >= len(a) - 12


def test_neighbours_in_a_batch_do_not_matter():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é", k=rng.randint(0, 400))) for _ in range(30)] + ["", "", "a", "a" * 1000, "ab" * 500, "\n"]
    together = fp.as_strings(*fp.fingerprints([t.encode() for t in texts]))
    assert together == [fp.as_strings(*fp.fingerprints([t.encode()]))[0] for t in texts]
    assert all(hashlib.sha256(x.encode()) for x in together)
    assert together[30] == together[31] != together[32]


def test_phrases_are_short_and_symbols_differ():
    rng = random.Random(3)
    for text in ("".join(rng.choices("abc", k=5000)), "ab" * 3000, "the cat sat on the mat " * 200):
        sizes = [len(n) for n, _ in fp.parse([text.encode()])]
        assert sizes[0] <= len(text) / 2 + 2 and sizes[1] <= sizes[0] / 2 + 2 and sizes[2] <= sizes[1] / 2 + 2


def test_strings_can_be_read_again():
    counts, sketches = fp.fingerprints([b"some text that is long enough to have phrases " * 5])
    c, s = fp.from_string(fp.as_strings(counts, sketches)[0])
    assert (c == counts).all() and (s == sketches).all()


def test_odd_rows(spark, odd_docs):
    got = fp.compare_with_edits(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[6]) == 2 and {r["near_next"] for r in by[6]} >= {1.0}
    assert by[3][0]["fingerprint"] == by[2][0]["fingerprint"] and by[2][0]["near_edited"] == 1.0
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}) == 1
    assert fp.compare_with_edits(odd_docs.limit(0)).collect() == []
    one = fp.compare_with_edits(odd_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    nulls = fp.compare_with_edits(odd_docs.where("doc_id is null")).collect()
    assert len(nulls) == 2
