import json

from tidemark.operators import p2, sketches
from tidemark.operators.rings import Ring
from tidemark.plans import monitor as mon
from tidemark.sources import messages
from tidemark.streaming import processors as ps

HOUR = 3_600_000_000_000


def stream(spark, data, files=1):
    e = spark.read.parquet(f"{data}/events.parquet")
    return e, spark.readStream.schema(e.schema).parquet(f"{data}/events.parquet*")


def test_ring(spark, data):
    from tidemark.functions.scalar import nanoseconds

    e, s = stream(spark, data)
    ring = Ring(48, HOUR, ("event_type",))
    batch = ring.add(e.withColumn("ns", nanoseconds("ts")), "ns", "user_id")
    got = ps.trim_ring(ps.to_present(ps.stream_ring(s, "ts", "user_id", ring), ["event_type", "bucket"]), ring)
    assert sorted(map(tuple, got.select("event_type", "bucket", "v", "newest").collect())) == sorted(map(tuple, batch.select("event_type", "bucket", "v", "newest").collect()))


def test_quantile_and_histogram(spark, data):
    e, s = stream(spark, data)
    for b, t in ((p2.quantile(e, "value", "event_id", 0.5, ["event_type"]), ps.stream_quantile(s, "value", "event_id", 0.5, ["event_type"])), (p2.histogram(e, "value", "event_id", 5, ["event_type"]), ps.stream_histogram(s, "value", "event_id", 5, ["event_type"]))):
        assert sorted(map(tuple, ps.to_present(t, ["event_type"]).collect())) == sorted(map(tuple, b.collect()))


def test_sketch(spark, data):
    e, s = stream(spark, data)
    shape = sketches.Shape(0.1, 0.1)
    one = lambda df: df.selectExpr("event_id", "event_type", "cast(user_id as string) as k", "1 as n")
    b = sketches.conservative_sketch(one(e), "k", "n", "event_id", shape, ["event_type"])
    t = ps.to_present(ps.stream_sketch(one(s), "k", "n", "event_id", shape, ["event_type"]), ["event_type"])
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, b.collect()))


def test_monitor(spark, data):
    e, s = stream(spark, data)
    settings = mon.Settings(max_set_size=30)
    batch = {(r["path"][0], r["kind"], r["name"]): (r["cnt"], r["subtype"], json.loads(r["report"])) for r in mon.monitor(messages.from_events(e), settings).collect()}
    got = ps.to_present(ps.stream_monitor(messages.from_events(s), settings), ["path", "kind", "name"])
    assert {(r["path"], r["kind"], r["name"]): (r["cnt"], r["subtype"], json.loads(r["report"])) for r in got.collect()} == batch


def alert_values(interval: int) -> list[str]:
    """Nearly all values of an interval are different, but for the 8th, 10th and 12th, where they are one."""
    return ["same" if interval in (8, 10, 12) else f"{interval}-{i}" if i > interval % 2 else "dup" for i in range(20)]


ALERTS = mon.Settings(samples=6, sample_interval_ns=1000, max_set_size=8, duplicate_change=0.5, many=10)


def test_alerts_are_counted_over_micro_batches(spark, tmp_path):
    """A report after each of several micro-batches, and the same reports from one entry: alerts that were shown widen the band of later ones."""
    schema = "key string, seq bigint, ns bigint, value string"
    one, expected = mon.Entry(ALERTS, "field"), []
    for n in range(14):
        rows = [("k", n * 100 + i, n * 1000 + i, v) for i, v in enumerate(alert_values(n))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
        for _, _, ns, v in rows:
            one.add(ns, v, 0, "json", False)
        expected.append(one.rows()[0][8])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").selectExpr("*", "0 as code", "'json' as representation", "false as repetition")
    folded = ps.stream_fold(s, ["key"], ["seq"], ["ns", "value", "code", "representation", "repetition"], lambda *k: mon.Entry(ALERTS, "field"), mon.ENTRY_SCHEMA)
    got = []
    q = folded.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, n: got.extend(r["report"] for r in b.collect())).start()
    q.awaitTermination()
    assert sorted(got) == sorted(expected)
    assert [json.loads(r)["alerted"] for r in expected[:7]] == [0] * 7 and json.loads(got[-1])["alerted"] >= 1 and "alert" not in json.loads(got[-1])


def test_reports_come_by_the_clock(spark, tmp_path):
    """Keys without new data are reported again and again."""
    import time

    spark.createDataFrame([("a", 1, 1.0), ("b", 2, 5.0)], "k string, seq bigint, x double").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema("k string, seq bigint, x double").parquet(f"{tmp_path}/in/*")
    folded = ps.stream_fold(s, ["k"], ["seq"], ["x"], lambda *k: p2._Rows(p2.Histogram(4)), "marker int, estimate double, n bigint", tick_seconds=0.5)
    seen = []
    q = ps.every(folded, 1, f"{tmp_path}/cp", lambda b, n: seen.append({r["k"] for r in b.collect()}))
    until = time.time() + 60
    while time.time() < until and sum(x == {"a", "b"} for x in seen) < 3:
        time.sleep(0.5)
    q.stop()
    assert sum(x == {"a", "b"} for x in seen) >= 3


def test_a_key_of_a_large_micro_batch_is_sorted_in_bounded_memory(spark, tmp_path):
    class InOrder:
        """Counts rows, how many came out of order, and the MB by which the process's peak memory rose meanwhile."""

        def __init__(self):
            self.before, self.last, self.n, self.wrong = self.peak(), -1, 0, 0

        @staticmethod
        def peak():
            import resource

            return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024

        def add(self, seq, text):
            self.wrong += seq <= self.last
            self.last, self.n = seq, self.n + 1

        def rows(self):
            return [(self.n, self.wrong, self.peak() - self.before)]

        def __reduce__(self):
            return dict, ()  # the state is not read again

    rows = spark.range(200_000).selectExpr("'k' as key", "id * 7919 % 200000 as seq", "concat(repeat('x', 1500), id) as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # PySpark itself holds 57 batches
    try:
        got = ps.to_present(ps.stream_fold(s, ["key"], ["seq"], ["seq", "text"], lambda *k: InOrder(), "n bigint, wrong bigint, mb bigint"), ["key"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["n"], r["wrong"]) for r in got] == [(200_000, 0)]
    assert got[0]["mb"] < 250


def test_order_over_runs(monkeypatch):
    """Nulls last and equal values as they came, whether or not there are runs of runs."""
    import random

    import pandas as pd

    from tidemark.streaming import ordering

    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randint(0, 5), i) for i in range(3000)]
    want = [r for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))]
    for size in (1 << 30, 4000, 1):
        monkeypatch.setattr(ordering, "RUN_BYTES", size)
        monkeypatch.setattr(ordering, "FAN", 4)
        parts = (pd.DataFrame(rows[i : i + 50], columns=["s", "x", "n"]) for i in range(0, 3000, 50))
        assert list(ordering.in_order(parts, ["s", "x"], ["s", "x", "n"])) == want
    assert list(ordering.in_order(iter([]), ["s"], ["x"])) == []
