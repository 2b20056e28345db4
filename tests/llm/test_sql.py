import duckdb
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    expected = sorted(repr(tuple(x[names.index(k)] for k in sorted(names))) for x in r.fetchall())
    df = queries.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(x[k] for k in sorted(names))) for x in df.collect()) == expected
