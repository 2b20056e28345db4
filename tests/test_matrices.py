import pytest
from fixtures import PCC

from tidemark.operators.matrices import Matrix

NAN = float("nan")


def cells(spark, rows, kind="int"):
    flat = [(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(flat, f"r int, c int, v {'int' if kind == 'int' else 'float'}")


@pytest.mark.parametrize("kind", ["int", "float"])
def test_pcc(spark, kind):
    m = Matrix(4, 4, kind)
    rows = PCC if kind == "int" else [[float(v) for v in row] for row in PCC]
    if kind == "float":
        rows[1][0] = rows[2][1] = NAN
    x = m.build(cells(spark, rows, kind))
    top, low = m.best_match(x, 3).collect()[0], m.best_match(x, 3, "min").collect()[0]
    assert top["pcc"] == pytest.approx(1.0, abs=1e-9) and top["closest"] == 1
    assert low["pcc"] == pytest.approx(0.90765069670774, abs=1e-9) and low["closest"] == 2
    cleared = m.best_match(m.clear_row(x, 1), 3).collect()[0]
    assert cleared["pcc"] == pytest.approx(0.95831484749991, abs=1e-9) and cleared["closest"] == 0


def test_pcc_of_large_values_and_of_none(spark):
    m = Matrix(2, 5)
    got = m.best_match(m.build(cells(spark, [[4000000, 0, 0, 0, 0], [8000000, 0, 0, 0, 0]])), 1).collect()
    assert [(round(r["pcc"], 9), r["closest"]) for r in got] == [(1.0, 0)]
    f = Matrix(2, 5, "float")
    assert f.best_match(f.build(cells(spark, [[NAN] * 5] * 2, "float")), 1).count() == 0
    assert m.best_match(m.build(cells(spark, [[1] * 5, [1, 2, 3, 4, 5]])), 1, "min", compat=True).count() == 0


def test_sum_set_and_bounds(spark):
    m = Matrix(1, 5)
    x = m.build(spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (-1, 2, 9), (1, -2, 9), (2, 1, 9), (0, 5, 9), (None, 1, 9), (0, 1, None)], "r int, c int, v int"))
    assert m.sum(x, 0).collect()[0]["sum"] == 10
    assert m.sums(x).collect()[0]["sum"] == 10
    assert m.row(x, 0).collect()[0]["values"] == [1, 2, 3, 4, 0]
    assert m.get(x, 0, 4).collect()[0]["value"] == 0
    for bad in (lambda: m.sum(x, 1), lambda: m.get(x, 0, 9), lambda: Matrix(0, 1), lambda: Matrix(1, 1, "text"), lambda: m.best_match(x, 0, "mean")):
        with pytest.raises(ValueError):
            bad()
    f = Matrix(3, 1, "float")
    kept = f.set(spark.createDataFrame([(0, 0, 0, 33.0), (1, 1, 0, float("inf")), (2, 2, 0, 1.0), (3, 2, 0, 44.0)], "seq int, r int, c int, v float"))
    assert [r["values"] for r in f.rows_as_arrays(kept).orderBy("r").collect()] == [[33.0], [float("inf")], [44.0]]


def test_saturation_and_merges(spark):
    m, small = Matrix(3, 3), Matrix(2, 2)
    x = m.build(cells(spark, [[2147483647, 1, 1], [1, 1, 1], [1, 1, 1]]))
    y = small.build(cells(spark, [[1, 2], [3, 4]]))
    added = {(r["r"], r["c"]): r["v"] for r in m.merge_add(x, y, small).collect()}
    assert added[0, 0] == 2147483647 and added[1, 1] == 5 and added[2, 2] == 1
    set_ = {(r["r"], r["c"]): r["v"] for r in m.merge_set(x, y, small).collect()}
    assert set_[0, 0] == 1 and set_[1, 0] == 3 and set_[2, 0] == 1
    with pytest.raises(ValueError):
        m.merge_add(x, y, Matrix(2, 2, "float"))
    f = Matrix(1, 2, "float")
    a, b = f.build(cells(spark, [[1.5, NAN]], "float")), f.build(cells(spark, [[NAN, 2.5]], "float"))
    assert sorted((r["c"], r["v"]) for r in f.merge_add(a, b, f).collect()) == [(0, 1.5), (1, 2.5)]
