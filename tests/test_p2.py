import numpy as np
import pytest
from fixtures import P2N, P2OBS, P2Q

from tidemark.operators import p2


def fed(markers, values):
    for v in values:
        markers.add(v)
    return markers


def test_golden():
    for m in (fed(p2.Quantile(0.5), P2OBS), fed(p2.Histogram(4), P2OBS)):
        assert [m.estimate(i) for i in range(5)] == pytest.approx(P2Q, abs=1e-4)
        assert [m.count(i) for i in range(5)] == P2N


def test_before_it_is_ready():
    q = p2.Quantile(0.5)
    assert [q.add(x) for x in (1.0, 2.0, 3.0, 4.0)] == [None] * 4 and q.estimate(2) is None and q.count(2) == 0
    assert q.add(9.0) == 3.0
    assert fed(p2.Quantile(0.5), [10.0, 20.0, 30.0, 40.0]).add(50.0, compat=True) == 3.0
    assert fed(p2.Quantile(0.5), [10.0, 20.0, 30.0, 40.0]).add(50.0) == 30.0


def test_parameters():
    for make in (lambda: p2.Quantile(-1), lambda: p2.Quantile(1.1), lambda: p2.Quantile(0), lambda: p2.Histogram(3), lambda: p2.Histogram(65535)):
        with pytest.raises(ValueError):
            make()


def test_fold_in_arrival_order_by_key(spark):
    rows = [(k, i, x) for k in "ab" for i, x in enumerate(P2OBS)] + [("a", 99, float("nan")), ("a", 98, None), ("c", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, seq int, x double").repartition(3)
    got = {(r["k"], r["marker"]): (r["estimate"], r["n"]) for r in p2.quantile(df, "x", "seq", 0.5, ["k"]).collect()}
    for k in "ab":
        assert [got[k, i][0] for i in range(5)] == pytest.approx(P2Q, abs=1e-4)
    assert got["c", 2] == (None, 0)
    h = p2.histogram(df.where("k = 'a'"), "x", "seq", 4).orderBy("marker").collect()
    assert [r["n"] for r in h] == P2N


def test_close_to_exact(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=3000))], "seq int, x double")
    est = p2.quantile(df, "x", "seq", 0.9).where("marker = 2").collect()[0]["estimate"]
    exact = p2.exact_percentiles(df, "x", [0.9]).collect()[0]["value"]
    near = p2.mergeable_percentiles(df, "x", [0.9]).collect()[0]["value"]
    assert abs(est - exact) < 0.05 and abs(near - exact) < 0.02
    prefix = p2.quantile_prefix(df, "x", "seq", 0.9).orderBy("seq").collect()
    assert len(prefix) == 3000 and prefix[3]["estimate"] is None and prefix[-1]["estimate"] == est
