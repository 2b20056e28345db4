"""Queries against their SQL over tables that have what the scale of test_entry.py has not."""

import duckdb

import __spark_entry__ as e


def differing(spark, folder, name: str, events: str) -> tuple[list, list]:
    """Rows of the query and of its SQL over an events table that DuckDB makes."""
    duck = duckdb.connect()
    duck.execute(f"copy ({events}) to '{folder}/events.parquet' (format parquet)")
    duck.execute(f"create view events as select * from '{folder}/events.parquet'")
    want = duck.execute(e.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = e.queries()[name](spark, str(folder)).select(*(f"`{c}`" for c in columns))
    return sorted(repr(tuple(r)) for r in got.collect()), sorted(repr(r) for r in want.fetchall())


#: 300 users of type a, whose first 255 events have 100 of them twice or more; 400 of type b, of whom few come twice early.
USERS = """select i as event_id, timestamp '2024-01-01' + to_seconds(i * 60) as ts, case when i % 2 = 0 then (case when i < 600 then i // 2 % 100 else i // 2 % 300 end) else (case when i < 60 then 7 else i // 2 % 400 end) end as user_id,
 case when i % 2 = 0 then 'a' else 'b' end as event_type, i / 100 as value, '{}' as props from range(3000) t(i)"""


def test_sets_that_overflow_are_counted_whole(spark, tmp_path):
    got, want = differing(spark, tmp_path, "monitor_set_counts", USERS)
    assert got == want and len(want) == 300 + 300 + 400


#: Three ids for each value of seq_late, with hours that lie far apart.
PEERS = """select i + 1000003 * j as event_id, timestamp '2024-01-01' + to_hours((i * 31 + j * 311) % 720) as ts, i % 15 as user_id, case when i % 2 = 0 then 'a' else 'b' end as event_type, (i + j) / 100 as value, '{}' as props
 from range(400) a(i), range(3) b(j)"""


def test_events_that_share_an_order_value_come_at_once_in_a_stream(spark, tmp_path):
    got, want = differing(spark, tmp_path, "stream_ring_keyed_late", PEERS)
    assert got == want and len(want) > 200


def test_adds_that_share_an_order_value_return_what_all_of_them_leave(spark, tmp_path):
    got, want = differing(spark, tmp_path, "ts_add_prefix", PEERS)
    assert got == want and len(want) == 1200
