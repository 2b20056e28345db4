import pytest
from fixtures import MP, MPDATA, MPI

from tidemark.operators import profile


def series(spark, values, key=None):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


@pytest.mark.parametrize("plan", ["relational", "blocked"])
def test_golden(spark, plan):
    s = series(spark, MPDATA)
    got = (profile.matrix_profile(s, 16, 4) if plan == "relational" else profile.matrix_profile_blocked(s, 16, 4, tasks=3)).orderBy("i").collect()
    assert [r["mp"] for r in got] == pytest.approx(MP, abs=1e-5)
    assert [r["mpi"] for r in got] == MPI


def test_anomalies(spark):
    p = profile.matrix_profile(series(spark, MPDATA), 16, 4)
    r = profile.anomaly(p).collect()[0]
    assert (r["at"], r["relative_pct"], r["distance"]) == (3, pytest.approx(68.356354, abs=1e-5), pytest.approx(1.078937, abs=1e-5))
    now = profile.anomaly(p, last=4).collect()[0]
    assert tuple(now) == (12, None, None)


def test_flat_series_has_no_anomaly(spark):
    for plan in (profile.matrix_profile, profile.matrix_profile_blocked):
        p = plan(series(spark, [0] * 17), 16, 4)
        assert {(r["mp"], r["mpi"]) for r in p.collect()} == {(float("inf"), 0)}
        assert profile.anomaly(p).count() == 0


def test_both_plans_agree_and_sampling_only_loses(spark):
    values = [(i * 7919 + i * i * 31) % 101 for i in range(80)]
    s = series(spark, values)
    a = {r["i"]: (round(r["mp"], 6), r["mpi"]) for r in profile.matrix_profile(s, 80, 8).collect()}
    b = {r["i"]: (round(r["mp"], 6), r["mpi"]) for r in profile.matrix_profile_blocked(s, 80, 8).collect()}
    assert a == b
    part = {r["i"]: r["mp"] for r in profile.matrix_profile(s, 80, 8, percent=30, seed=3).collect()}
    assert all(part[i] >= a[i][0] - 1e-6 for i in a)
    back = {r["i"]: r["mp"] for r in profile.matrix_profile(series(spark, values[::-1]), 80, 8).collect()}
    assert all(back[len(a) - 1 - i] == pytest.approx(a[i][0], abs=1e-6) for i in a)


def test_parameters():
    for n, m, percent in ((16, 3, 100), (15, 4, 100), (16, 4, 0), (16, 4, 101)):
        with pytest.raises(ValueError):
            profile.check_parameters(n, m, percent)
