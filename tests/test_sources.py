import json

from pyspark.sql import functions as F

from tidemark.plans import monitor as mon
from tidemark.sources import messages
from tidemark.streaming import processors as ps


def test_messages_as_tables_and_as_streams(spark, data, tmp_path):
    m = messages.from_events(spark.read.parquet(f"{data}/events.parquet")).limit(200)
    m.repartition(2).write.parquet(str(tmp_path / "in"))
    table = messages.read_messages(spark, str(tmp_path / "in"))
    assert table.count() == 200 and [f.name for f in table.schema][:2] == ["seq", "ns"]
    stream = messages.read_messages(spark, str(tmp_path / "in"), stream=True)
    got = []
    query = ps.every(ps.stream_monitor(stream), 1, ps.checkpoint_path(str(tmp_path), "monitor"), lambda batch, n: got.append({(r["path"], r["name"]): r["cnt"] for r in batch.collect()}))
    query.processAllAvailable()
    query.stop()
    total = {}
    for g in got:
        total.update(g)
    assert sum(v for (_, name), v in total.items() if name == "value") == 200


def test_reports_are_written(spark, data, tmp_path):
    m = messages.from_events(spark.read.parquet(f"{data}/events.parquet"))
    messages.write_reports(mon.reports(mon.monitor(m), m), str(tmp_path / "out"))
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(d["cnt"] for d in docs) == m.count()


def test_exclusion_and_missing_values(spark):
    field = "named_struct('name', '{n}', 'value_type', 3, 'representation', '', 'repetition', false, 'value', {v})"
    m = spark.range(3).selectExpr("id as seq", "id * 10 as ns", "'a' as Logger", "cast(null as string) as Hostname", "'t' as Type", "cast(null as string) as Payload", "'1' as EnvVersion", "cast(id as int) as Pid", "7 as Severity", f"array({field.format(n='x', v='cast(id as string)')}, {field.format(n='y', v='cast(null as string)')}) as Fields")
    m = m.unionByName(m.withColumn("Fields", F.lit(None).cast(m.schema["Fields"].dataType)).withColumn("seq", F.col("seq") + 10))
    names = lambda **k: sorted({(r["kind"], r["name"]) for r in messages.explode_entries(m, **k).collect()})
    assert names() == [("field", "x"), ("header", "EnvVersion"), ("header", "Pid"), ("header", "Severity"), ("header", "Type")]
    assert names(exclude=["Pid", "Fields[x]"], hierarchy=["Logger", "Type"]) == [("header", "EnvVersion"), ("header", "Severity")]
    assert {tuple(r["path"]) for r in messages.explode_entries(m, hierarchy=["Fields[x]"]).select("path").collect()} == {("0",), ("1",), ("2",), ("NIL",)}
    assert messages.explode_entries(m.limit(0)).count() == 0
