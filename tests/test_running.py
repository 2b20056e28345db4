import math

import pytest

from tidemark.operators import running


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([1.0, 2.0, 3.0], (3, 2, 1, 1, 0.816497)),
        ([float("inf"), float("nan"), float("-inf"), None], (0, 0, 0, 0, 0)),
        ([float(i) for i in range(1, 11)], (10, 5.5, 9.16667, 3.02765, 2.87228)),
        ([7.0], (1, 7, 0, 0, 0)),
        ([], (0, 0, 0, 0, 0)),
    ],
)
def test_golden(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert tuple(one(running.running_stats(df, "x"))) == pytest.approx(expected, abs=1e-5)


def test_prefix_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0)], "seq int, x double")
    got = [(r.count_so_far, r.mean_so_far) for r in running.running_prefix(df, "x", "seq").orderBy("seq").collect()]
    assert got == [(1, 1.0), (1, 1.0), (2, 3.0)]


def test_merged_parts_equal_the_whole(spark):
    df = spark.range(1, 500).selectExpr("id % 7 as part", "cast(id * id % 101 as double) as x")
    whole = one(running.running_stats(df, "x"))
    merged = one(running.merge_stats(running.as_state(running.running_stats(df, "x", ["part"])), []))
    assert merged["count"] == whole["count"] and math.isclose(merged["mean"], whole["avg"]) and math.isclose(merged["m2"] / (merged["count"] - 1), whole["variance"])
