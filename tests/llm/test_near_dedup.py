import random
import re

import numpy as np
import pytest

from tidemark.llm import near_dedup as nd
from tidemark.llm import components as cc
from tidemark.llm.components import components
from tidemark.llm.queries import op6_near_dedup


def shingles(t, k):
    if t is None:
        return set()
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs: dict, k: int, percent: int) -> dict:
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(rows, docs, k, percent):
    expected = brute(docs, k, percent)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op6_near_dedup(spark, sf).collect(), docs, 3, 85)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_chains_and_groups(spark, k, percent):
    """Copies with more and more edits, so that many pairs lie near the threshold, and a group larger than a block."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = {}, 0
    for size, copies in ((60, 40), (150, 30), (30, 20), (200, 160)):
        base = rng.choices(vocabulary, k=size)
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            docs[n] = " ".join(text)
            n += 1
            if c % 3 == 0:
                base = text
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    check(nd.near_duplicates(df, words=k, percent=percent).collect(), docs, k, percent)


def test_exactly_at_the_threshold(spark):
    """17 of 20 shingles: 85 of 100."""
    shared = [f"s{i}" for i in range(19)]
    docs = {1: " ".join(shared + ["x"]), 2: " ".join(["y", "z"] + shared)}
    docs = {1: " ".join(shared), 2: " ".join(shared + ["a", "b", "c"]), 3: " ".join(shared + ["a", "b", "c", "d"])}
    check(nd.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), 3, 85).collect(), docs, 3, 85)


def test_odd_rows(spark, odd_docs):
    got = nd.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[2] == by[3][:0] + [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert by[1][0][1:] == (1, True) and [x[1:] for x in by[6]] == [(1, False), (1, False)]
    assert all(x[1] is None and x[2] for x in by[None])
    assert by[8] == [(1, 8, True)]
    assert nd.near_duplicates(odd_docs.limit(0)).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    text = lambda seed: " ".join(random.Random(seed).choices("abcdefghij", k=40))
    rows = [(5, text(1)), (5, text(2)), (3, text(1)), (9, text(2)), (7, text(3))]
    got = {(r["doc_id"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)))
    n = 352
    assert abs((nd.signature(a, n) == nd.signature(b, n)).mean() - 2 / 3) < 0.12


def test_pruning_misses_few_at_the_threshold():
    """Binomial agreement at the threshold itself: pruned with probability near `miss` per look."""
    rng = np.random.default_rng(5)
    n, pairs = 352, 4000
    left = np.zeros((pairs, n), np.uint32)
    right = (rng.random((pairs, n)) > 0.85).astype(np.uint32)
    kept, _ = nd.survivors(left, right, np.column_stack([np.arange(pairs)] * 2), 85, 1e-6)
    assert len(kept) == pairs
    low = (rng.random((pairs, n)) > 0.5).astype(np.uint32)
    kept, _ = nd.survivors(left, low, np.column_stack([np.arange(pairs)] * 2), 85, 1e-6)
    assert len(kept) == 0
    assert nd.n_bands(85, 1e-6) * nd.ROWS <= 400


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(50)) and got[301] == 300 and 3 in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_stars_of_edges():
    rng = random.Random(5)
    for n in (1, 10, 300):
        edges = [(rng.randrange(n) * 7 - 50, rng.randrange(n) * 7 - 50) for _ in range(n)]
        least = {x: x for e in edges for x in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        got = cc.stars(*np.array(edges, np.int64).T)
        assert dict(zip(*(x.tolist() for x in got), strict=True)) == {x: y for x, y in least.items() if x != y}
        assert len(got[0]) == len(set(got[0].tolist()))


@pytest.mark.parametrize("edges_of_task", [1, 40, 1 << 17])
def test_components_whatever_a_task_contracts(spark, monkeypatch, edges_of_task):
    """Rounds of the steps between tasks, and one task for all, give the same."""
    monkeypatch.setattr(cc, "EDGES_OF_TASK", edges_of_task)
    monkeypatch.setattr(cc, "COLD", 8)
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    least = {x: x for u, v in edges if u is not None and u != v for x in (u, v)}
    for _ in least:
        for u, v in edges:
            if u is not None and u != v:
                least[u] = least[v] = min(least[u], least[v])
    rows = components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)).collect()
    assert len(rows) == len(least) and {r["node"]: r["component"] for r in rows} == least


def test_few_edges_take_few_tasks(spark):
    """Rounds over many shuffle partitions fill the driver with tasks and plans: in rounds, these edges took 214 tasks by this count."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u bigint, v bigint").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("64", "false"), strict=True):
        spark.conf.set(k, v)
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "")
    try:
        rows = components(edges).collect()
        stages = {i for j in sc.statusTracker().getJobIdsForGroup("few-edges") for i in sc.statusTracker().getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(sc.statusTracker().getStageInfo, stages) if x)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in rows} == {(i, 0) for i in range(21)}
    print(f"{tasks} tasks")
    assert tasks < 150


def test_large_groups_and_hot_keys(spark, monkeypatch):
    """The plans for large groups, with what counts as large made small: the same rows."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "COLD", 8)
    monkeypatch.setattr(cc, "COLD", 8)
    monkeypatch.setattr(cc, "HOT_KEYS", 1 << 20)
    rng = random.Random(11)
    docs = {}
    for size, copies, edits in ((100, 160, 8), (60, 40, 2)):
        base = rng.choices([f"w{i}" for i in range(300)], k=size)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(size)] = rng.choice("abcdefgh")
            docs[len(docs)] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    check(nd.near_duplicates(df, 3, 85).collect(), docs, 3, 85)


def linked_by_matrix(kept: np.ndarray, percent: int) -> list[int]:
    """Components of copies whose sets have as many shingles each, of which only those kept of the base are shared."""
    n, size = kept.shape
    kept = kept.astype(np.float32)
    least, before = np.arange(n), None
    while before is None or (least != before).any():
        before = least.copy()
        for lo in range(0, n, 500):
            common = kept[lo : lo + 500] @ kept.T
            least[lo : lo + 500] = np.minimum(least[lo : lo + 500], np.where(100 * common >= percent * (2 * size - common), least, n).min(1))
    return least.tolist()


@pytest.mark.parametrize(("copies", "most_edits", "bound"), [(10_000, 3, 1.5), (3_000, 9, 8)])
def test_a_large_cluster_shuffles_little(spark, copies, most_edits, bound):
    """Copies of a text with few edits, or so many that most pairs lie just below the threshold: exact, and a few times the input shuffled."""
    rng = random.Random(8)
    base = [f"word{i}" for i in range(330)]
    texts, kept = [], np.ones((copies, 328), bool)
    for n in range(len(kept)):
        words = list(base)
        for at in rng.sample(range(2, 328, 3), rng.randint(most_edits // 3, most_edits)):
            words[at] = f"x{n}x{at}"
            kept[n, at - 2 : at + 1] = False
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    store = spark._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    rows = nd.near_duplicates(df, 3, 85).collect()
    written = store.executorSummary("driver").totalShuffleWrite() - before
    expected = linked_by_matrix(kept, 85)
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(expected))
    assert len(set(expected)) == 1 if most_edits == 3 else len(set(expected)) > 50
    print(f"{len(set(expected))} components, shuffled {written / sum(map(len, texts)):.2f} x input")
    assert written < bound * sum(map(len, texts))
