import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_tokens import TOKENIZER, check_packing

import corpus_pipeline as cp
from tidemark.llm.store import table


def test_stages_on_a_small_corpus(spark):
    """Each stage on all that its predecessor kept, held against a plain version of its decision."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == cp.COLUMNS
        rows = {r["doc_id"]: r for r in out.collect()}
        before = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[i] == r for i, r in rows.items())
        kept[name] = (before, rows)
        docs = spark.createDataFrame(list(rows.values()), docs.select(*cp.COLUMNS).schema)
    before, rows = kept["language_id"]
    assert len(rows) >= 0.995 * len(before)
    before, rows = kept["toxicity"]
    clean = [i for i in before if labels.get(i) == 0]
    toxic = [i for i in before if labels.get(i) == 1]
    assert np.mean([i in rows for i in clean]) >= 0.99 and np.mean([i not in rows for i in toxic]) >= 0.93
    before, rows = kept["near_dedup"]
    expected = brute({i: r["text"] for i, r in before.items()}, 5, 80)
    assert set(rows) == {i for i, (_, c) in expected.items() if c == i}
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert check_packing(packed, [(i, TOKENIZER.encode(r["text"], add_special_tokens=False).ids + [0]) for i, r in rows.items()]) == 0
    assert {r["doc_id"] for r in cp.run(spark, sf).select("doc_id").distinct().collect()} == set(rows)


def test_odd_rows(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "score as lang_pred")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in cp.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.select(*cp.COLUMNS).schema)
        ids = [r["doc_id"] for r in now.collect()]
        assert len(ids) == len(set(ids))
        pieces = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r["doc_id"] for r in pieces} == set(ids)
    assert not {2, 3, 4, 5} & set(ids or [])


def test_rows_without_or_with_clashing_ids_are_deduplicated_by_text(spark):
    text = lambda seed: " ".join(random.Random(seed).choices("abcdefghij", k=60))
    near = text(1) + " z"
    rows = [(None, text(1)), (None, text(1)), (None, near), (None, text(2)), (4, near), (3, text(3)), (3, text(4)), (3, text(4)), (5, text(4)), (6, None), (6, text(5)), (None, text(6)), (None, text(6) + " z"), (8, None), (9, text(7)), (7, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, "").collect()]
    one = [x for x in got if x[0] is None and x[1].startswith(text(6))]
    assert len(one) == 1
    got.remove(one[0])
    assert sorted(got, key=repr) == sorted([(None, text(2)), (4, near), (3, text(3)), (3, text(4)), (6, None), (6, text(5)), (8, None), (7, text(7))], key=repr)


@pytest.mark.parametrize("learned", [["en"], ["de"], ["de", "en"], ["de", "en", "es"]])
def test_languages_that_were_not_learned_are_dropped(spark, learned):
    rng = random.Random(1)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(*cp.COLUMNS)
    junk = [(-1 - i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=rng.randint(2, 9))) for _ in range(80)), None, "s", 1) for i in range(50)]
    finnish = [(-100 - i, "Valiokunta kokoontuu jälleen torstaina keskustelemaan ehdotuksesta, joka koskee uutta kirjastoa kaupungin keskustassa.", None, "s", 1) for i in range(3)]
    rows = docs.withColumn("lang", F.when(F.col("lang").isin(learned), F.col("lang"))).unionByName(spark.createDataFrame(junk + finnish, docs.schema))
    kept = {r["doc_id"] for r in cp.language_id(spark, rows, "").collect()}
    real = docs.collect()
    own = [r["doc_id"] in kept for r in real if r["lang"] in learned and r["n_chars"] > 0]
    foreign = [r["doc_id"] in kept for r in real if r["lang"] not in learned]
    assert np.mean(own) >= 0.995 and np.mean(foreign) <= 0.03
    assert not [i for i in kept if i < 0]


def test_where_no_language_is_named_documents_stay(spark, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    assert sorted(r["doc_id"] or 0 for r in cp.language_id(spark, docs, "").collect()) == [0, 1, 6, 6, 7, 8, 9]
