import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language as lg
from tidemark.llm.ftrl import Ftrl
from tidemark.llm.queries import op2_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op2_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.98


def test_predictions_use_the_text_alone(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = lg.train(docs)
    a = lg.predict(docs, model, ["doc_id"]).orderBy("doc_id").collect()
    b = lg.predict(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("?")), model, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b


def test_grams_against_a_plain_count():
    texts = ["Ab, c!", "", "é", "..", "x  y"]
    found, at, has = lg.grams([t.encode() for t in texts])
    assert has.tolist() == [True, False, True, False, True]
    alone = [lg.grams([t.encode()]) for t in texts]
    for i, (f, a, _) in enumerate(alone):
        assert sorted(lg.doc_grams(found, at[i], at[i + 1]).tolist()) == sorted(lg.doc_grams(f, a[0], a[1]).tolist())
    same = [lg.grams([t])[0].tolist() for t in (b"Hello World", b"hello, world")]
    assert same[0] == same[1]


def test_odd_rows(spark, odd_docs):
    got = lg.identify_held_out(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (2, 3, 4, 5):
        assert (by[i][0]["lang_pred"], by[i][0]["score"]) == ("und", 0.0)
    assert by[1][0]["lang_pred"] in ("en", "de", "fr") and by[6][0]["lang_pred"] == by[6][1]["lang_pred"] == by[1][0]["lang_pred"]
    assert lg.identify_held_out(odd_docs.limit(0)).collect() == []
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lg.identify_held_out(nothing).collect()} == {"und"}
    one = odd_docs.withColumn("lang", F.lit("xx"))
    assert {r["lang_pred"] for r in lg.identify_held_out(one).collect()} == {"und", "xx"}


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    m = Ftrl(50, 1, 0.5, 1.0, 1.0, 0.01)
    for _ in range(800):
        at = rng.choice(np.arange(2, 50), 5, replace=False)
        y = int(rng.integers(2))
        m.step(np.append(at, y), np.ones(6), y)
    w = m.weights(slice(0, 50))[:, 0]
    assert w[1] > 0.5 > 0 > w[0] and (w[2:] == 0).mean() > 0.5


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    target = rng.integers(0, 3, 400)
    logits = np.eye(3)[target] * 2 + rng.normal(size=(400, 3))
    assert abs(lg._temperature(logits * 10, target) / lg._temperature(logits, target) - 10) < 2


def test_the_sample_is_bounded_and_of_all_languages(spark, monkeypatch):
    """One id or none for very many rows, unlike or equal: the driver takes no more than the bound, and each language is learned."""
    many = 20_000
    same = spark.range(many).selectExpr("cast(7 as bigint) as doc_id", "concat('the cat sat on mat number ', id % 5000, ' and slept') as text", "'en' as lang")
    none = spark.range(many).selectExpr("cast(null as bigint) as doc_id", "concat('le chat dort sur la table ', id, ' du jardin') as text", "'fr' as lang")
    equal = spark.range(many).selectExpr("cast(null as bigint) as doc_id", "'die katze sitzt auf dem tisch und schaut' as text", "'de' as lang")
    steps = []
    monkeypatch.setattr(Ftrl, "step", lambda self, at, x, target, weight=1.0: steps.append(target))
    model = lg.train(same.union(none).union(equal), per_language=10, epochs=1)
    assert model.languages == ["de", "en", "fr"]
    assert len(steps) == 21 - 21 // 5 and set(steps) <= {0, 1, 2}  # 1 + 10 + 10, a fifth held out
    steps.clear()
    lg.train(same, per_language=10, epochs=1, most_bytes=1000)
    assert 1 <= len(steps) <= 8
