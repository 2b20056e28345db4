import random
from collections import Counter

import pytest

from tidemark.operators import sketches
from tidemark.operators.hitters import MisraGries
from tidemark.operators import hitters

UPDATES = [(b"a", -10), (b"c", 6), (b"a", 1), (b"b", 2), (b"c", -3), ((5).to_bytes(4, "little"), 1)]


def test_shapes():
    assert [(s.width, s.depth) for s in (sketches.Shape(0.1, 0.1), sketches.Shape(0.01, 0.01), sketches.Shape(1e-5, 0.01))] == [(28, 3), (272, 5), (271829, 5)]
    for e, d in ((-1, 0.1), (0.1, 1)):
        with pytest.raises(ValueError):
            sketches.Shape(e, d)


def test_conservative_golden(spark):
    s = sketches.Conservative(sketches.Shape(0.1, 0.1))
    for k, n in UPDATES:
        s.update(k, n)
    assert (s.items, s.unique) == (7, 4) and [s.query(k) for k in (b"a", b"b", b"c")] == [1, 2, 3]
    s.update(b"c", -4)
    assert (s.items, s.unique, s.query(b"c")) == (4, 3, 0)
    df = spark.createDataFrame([(i, bytearray(k), n) for i, (k, n) in enumerate(UPDATES)], "seq int, k binary, n int")
    shape = sketches.Shape(0.1, 0.1)
    cells = sketches.conservative_sketch(df, "k", "n", "seq", shape)
    assert {bytes(r["k"]): r["estimate"] for r in sketches.conservative_query(cells, df, "k", shape).collect()} == {b"a": 1, b"b": 2, b"c": 3, (5).to_bytes(4, "little"): 1}
    assert tuple(sketches.conservative_totals(cells).collect()[0]) == (7, 4)


def test_true_conservative_linear(spark):
    """True count <= conservative estimate <= linear estimate, and linear sketches merge."""
    rng = random.Random(2)
    keys = [f"k{int(rng.paretovariate(1))}" for _ in range(3000)]
    true = Counter(keys)
    shape = sketches.Shape(0.2, 0.2)
    df = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "seq int, k string, n int")
    cons = {r["k"]: r["estimate"] for r in sketches.conservative_query(sketches.conservative_sketch(df, "k", "n", "seq", shape), df, "k", shape).collect()}
    for h in ("xxh32", "md5"):
        whole = sketches.linear_sketch(df, "k", "n", shape, h)
        lin = {r["k"]: r["estimate"] for r in sketches.linear_query(whole, df, "k", shape, h).collect()}
        if h == "xxh32":
            assert all(true[k] <= cons[k] <= lin[k] for k in true)
        assert all(true[k] <= lin[k] for k in true)
        merged = sketches.merge_sketches(*(sketches.linear_sketch(df.where(f"seq % 3 = {i}"), "k", "n", shape, h) for i in range(3)))
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_counts_and_distinct(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("b", -1), (None, 4)], "k string, n int")
    assert tuple(sketches.exact_counts(df, "k", "n").collect()[0]) == (2, 1)
    many = spark.range(50000).selectExpr("id % 20000 as x")
    exact, near = sketches.distinct_exact(many, "x").collect()[0]["unique"], sketches.distinct_hll(many, "x").collect()[0]["unique"]
    assert exact == 20000 and abs(near - exact) < 0.05 * exact


def test_misra_gries_bounds(spark):
    rng = random.Random(3)
    values = [str(int(rng.paretovariate(0.8))) for _ in range(5000)]
    true, size = Counter(values), 20
    m = MisraGries(size)
    for v in values:
        m.add(v)
    assert all(true[v] - len(values) / (size + 1) <= m.weights.get(v, 0) <= true[v] for v in true)
    df = spark.createDataFrame(list(enumerate(values)), "seq int, v string")
    assert {r["value"]: r["weight"] for r in hitters.heavy_hitters(df, "v", "seq", size).collect()} == m.weights


def test_sets_duplicates_paths(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "x", 1), (4, None, 1)], "seq int, v string, slot int")
    assert sorted((r["v"], r["cnt"], r["idx"]) for r in hitters.set_counts(df, "v", "seq").collect()) == [("x", 2, 1), ("y", 1, 2)]
    pct = hitters.duplicate_pct(spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "c"), (2, "d")], "s int, v string"), "v", __import__("pyspark").sql.functions.col("s"), exact=True)
    assert sorted((r["interval"], r["duplicate_pct"], r["other_min"], r["other_max"]) for r in hitters.duplicate_range(pct, []).collect()) == [(0, 50.0, 0.0, 0.0), (1, 0.0, 0.0, 50.0), (2, 0.0, 0.0, 50.0)]
    paths = spark.createDataFrame([("a", "b"), ("a", None), ("c", "b")], "p string, q string")
    assert {(r["p"], r["q"], r["level"]): r["cnt"] for r in hitters.path_counts(paths, ["p", "q"]).collect()} == {("a", "b", 2): 1, ("a", "NIL", 2): 1, ("c", "b", 2): 1, ("a", None, 1): 2, ("c", None, 1): 1}
