import duckdb
import pytest

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


#: Queries that SQL can't express or not at their size, and the tests that hold what they do against something else.
ELSEWHERE = {
    "mp_profile_long": "test_entry.py::test_against_sql[mp_profile_blocked]",  # the same operator over a shorter series
    "distinct_hll": "test_sketches.py::test_counts_and_distinct",
    "monitor_schema": "test_monitor.py::test_batch_monitor_and_report",
    "monitor_drift": "test_monitor.py::test_pcc_alert",
    "monitor_report_json": "test_monitor.py::test_batch_monitor_and_report",
    "stream_monitor": "test_streaming.py::test_monitor",
}


def test_drift_query_raises_alerts(spark, data):
    assert e.queries()["monitor_drift"](spark, data).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, data, name):
    df = e.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in e.oracle_sql():
        assert name in ELSEWHERE
        return
    assert name not in ELSEWHERE
    r = duck.execute(e.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in r.fetchall())
