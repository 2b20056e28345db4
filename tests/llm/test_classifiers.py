import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_gbt, quality_rules, text_stats, toxicity
from tidemark.llm.queries import op3_toxicity, op4_quality_rules, op8_quality

SF = "/root/testdata/sf0.1"


def brute(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def held_out(spark, query, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    return [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]


def test_toxicity_held_out(spark):
    rows = held_out(spark, op3_toxicity, "toxic")
    assert np.mean([p for y, p, _ in rows if y]) >= 0.82
    assert np.mean([p for y, p, _ in rows if not y]) <= 0.006


def test_quality_held_out(spark):
    rows = held_out(spark, op8_quality, "quality")
    assert np.mean([y == p for y, p, _ in rows]) >= 0.99


def test_quality_rules_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op4_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, dup, repeated = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    able = [r for r in got if not r["base_failed"] and r["doc_id"] in good]
    assert np.mean([r["kept"] for r in able if good[r["doc_id"]]]) >= 0.99
    assert np.mean([r["kept"] for r in able if not good[r["doc_id"]]]) <= 0.4


@pytest.mark.parametrize("t", ["", " ", "a", "a b c d e a b c d e", "a b c d e f a b c d e f a", "x\n\nx\n \nx", "é\x1cü z #|", "w " * 4000])
def test_statistics(t):
    got = text_stats.stats([b"other text here and there", t.encode(), b""])
    assert tuple(int(got[f][1]) for f in text_stats.BASE_FIELDS) == brute(t)
    assert int(got["n_chars"][1]) == len(t)


def test_toxicity_features_against_a_plain_list():
    texts = ["You, IDIOT! you", "", "one", "É a b c d"]
    found, first = toxicity.features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        f1, a1 = toxicity.features([t.encode()])
        for k in range(3):
            assert found[k][toxicity._span(k, first[k], i)].tolist() == f1[k][toxicity._span(k, a1[k], 0)].tolist()
    words = re.findall(r"[a-z0-9\x80-\xff]+", texts[0].lower())
    assert len(toxicity.features([texts[0].encode()])[0][0]) == len(words) == 3


def test_toxicity_scores_against_dense_sums():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 12)) for _ in range(5)] + [""]
    dense = np.where(rng.random(1 << toxicity.BITS) < 0.5, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    hit = np.flatnonzero(dense)
    model = toxicity.ToxicityModel(hit, dense[hit], -0.5)
    got = model.score([t.encode() for t in texts], model.table())
    for t, s in zip(texts, got, strict=True):
        f, a = toxicity.features([t.encode()])
        own = np.unique(np.concatenate([f[k][toxicity._span(k, a[k], 0)] for k in range(3)]))
        assert s == pytest.approx(1 / (1 + np.exp(0.5 - dense[own].sum())), rel=1e-5)


def test_trees_against_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality_gbt.Trees.fit(x, y, trees=40, depth=3)
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        total = t.base
        for c, th, leaf in zip(t.column, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(c):
                node = 2 * node + 1 + bool(row[c[node]] > th[node])
            total += leaf[node - len(c)]
        assert t.score(row[None, :])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_isolation_forest_finds_the_odd_one():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    f = quality_rules.IsolationForest.fit(x, 60, 128, 1)
    s = f.score(x)
    assert s.argmax() == 500 and ((s > 0) & (s < 1)).all()


def test_odd_rows(spark, odd_docs, odd_labels):
    n = odd_docs.count()
    for labels in (odd_labels, odd_labels.limit(0), odd_labels.where("quality = 1 and toxic = 0")):
        tox = toxicity.toxicity_held_out(odd_docs, labels).collect()
        qual = quality_gbt.quality_held_out(odd_docs, labels).collect()
        rules = quality_rules.quality_rules(odd_docs, labels).collect()
        assert len(tox) == len(qual) == len(rules) == n
        for rows in (tox, qual):
            assert all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (1, 6)}) == 1
        empty = [r for r in rules if r["doc_id"] in (2, 3, 4)]
        assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty)
    none = odd_docs.limit(0)
    assert toxicity.toxicity_held_out(none, odd_labels).collect() == quality_gbt.quality_held_out(none, odd_labels).collect() == quality_rules.quality_rules(none, odd_labels).collect() == []


def test_scores_use_the_text_alone(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels)
    a = toxicity.score(docs, model, ["doc_id"]).orderBy("doc_id").collect()
    b = toxicity.score(docs.withColumn("lang", F.lit("?")).withColumn("source", F.lit("?")), model, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A labelled id of very many rows counts once; rows and bytes that come to the driver are bounded."""
    docs = spark.range(100_000).selectExpr("cast(if(id % 10 = 0, id, 5) as bigint) as doc_id", "concat('words of row ', id, ' and more') as text")
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 20 = 0 or id = 5 as int) as toxic")
    steps = []
    monkeypatch.setattr(toxicity.Ftrl, "step", lambda self, at, x, target, weight=1.0: steps.append((target, len(at))))
    toxicity.train(docs, labels, per_class=50, epochs=1)
    assert sum(y for y, _ in steps) <= 50 and len(steps) <= 100
    steps.clear()
    toxicity.train(docs, labels, per_class=50, most_bytes=400, epochs=1)
    for k in (0, 1):
        assert 0 < sum(4 * n for y, n in steps if y == k) <= 400
