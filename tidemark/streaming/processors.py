"""Streams: event-time rings with a watermark, and the ordered summaries as per-key state.

The stateful summaries keep one pickled fold per key in the state store and feed it each micro-batch in arrival order; order
across micro-batches is the stream's. States are bounded like their batch counterparts, and a checkpoint location
preserves them. STATE_VERSION belongs in its path: a state of another version is not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import is_finite, nanoseconds
from ..operators.p2 import Histogram, Quantile, _Rows
from ..operators.rings import Ring, RingFold
from ..operators.sketches import Shape, _ConservativeFold, updates
from ..plans.monitor import ENTRY_COLUMNS, ENTRY_KEYS, ENTRY_SCHEMA, Entry, Settings
from ..sources.messages import explode_entries
from .ordering import in_order

STATE_VERSION = 1


def checkpoint_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}-v{STATE_VERSION}"


def stream_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable[..., object], schema: str, tick_seconds: float | None = None) -> DataFrame:
    """ordered_fold() for a stream: after each micro-batch, the rows of every key that it touched (update mode).

    tick_seconds: also the rows of every key that has emitted nothing for so long, whether or not there are new data: the
    timer of a periodic report. What emitting changes in a fold (alerts that it counts) is part of the state that is stored.
    A key's rows of one micro-batch are sorted by its task in bounded memory, and beyond it in files of Spark's local folder. PySpark holds
    up to 57 Arrow batches besides (itertools.tee keeps as many in a block): for wide rows lower spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    fields = T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string(schema).fields))
    names = [f.name for f in fields]
    wait = None if tick_seconds is None else int(tick_seconds * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make(*key)
        if not state.hasTimedOut:
            for row in in_order(parts, order, columns):
                fold.add(*(None if isinstance(x, float) and x != x else x for x in row))
        out = [(*key, *r) for r in fold.rows()]
        state.update((pickle.dumps(fold),))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=names)

    chosen = df.select(*keys, *columns, *[c for c in order if c not in columns and c not in keys])
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return chosen.groupBy(*keys).applyInPandasWithState(run, fields, "state binary", "update", timeout)


class _QuantileOf:
    def __init__(self, p: float):
        self.p = p

    def __call__(self, *key):
        return _Rows(Quantile(self.p))


class _HistogramOf:
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, *key):
        return _Rows(Histogram(self.buckets))


def stream_quantile(events: DataFrame, x: str, order: str, p: float, keys: list[str]) -> DataFrame:
    rows = events.where(is_finite(F.col(x).cast("double"))).withColumn("x__", F.col(x).cast("double"))
    return stream_fold(rows, keys, [order], ["x__"], _QuantileOf(p), "marker int, estimate double, n bigint")


def stream_histogram(events: DataFrame, x: str, order: str, buckets: int, keys: list[str]) -> DataFrame:
    rows = events.where(is_finite(F.col(x).cast("double"))).withColumn("x__", F.col(x).cast("double"))
    return stream_fold(rows, keys, [order], ["x__"], _HistogramOf(buckets), "marker int, estimate double, n bigint")


def stream_sketch(events: DataFrame, key: str, n: str, order: str, shape: Shape, groups: list[str]) -> DataFrame:
    """The sketch's cells and totals after each micro-batch."""
    return stream_fold(updates(events, key, n), groups, [order], ["key__", "n__"], lambda *k: _ConservativeFold(shape), "d int, w int, cnt bigint")


def stream_monitor(messages: DataFrame, settings: Settings = Settings(), hierarchy: list[str] = ["Logger"], exclude: list[str] | None = None, tick_seconds: float | None = None) -> DataFrame:
    """The monitor's entries after each micro-batch, and with tick_seconds whenever so long has passed; the path is joined with ``->``, as state keys are flat."""
    entries = explode_entries(messages, hierarchy, exclude).withColumn("path", F.array_join("path", "->"))
    return stream_fold(entries, ENTRY_KEYS, ["seq", "part"], ENTRY_COLUMNS, lambda path, kind, name: Entry(settings, kind), ENTRY_SCHEMA, tick_seconds)


def stream_ring(events: DataFrame, ts: str, v: str, ring: Ring) -> DataFrame:
    """Sums per time row (keys, bucket, total), for one series or series that advance together: rows behind the watermark of the ring's length are closed and later data for them dropped.

    The watermark moves with micro-batches and may keep more rows than the ring: trim_ring() removes those on reading. Series that
    lag behind the fastest one by more than the ring's length need per-key state instead.
    """
    seconds = -(-ring.rows * ring.ns_per_row // 1_000_000_000)
    width = f"{ring.ns_per_row // 1000} microseconds"
    stamped = events.withColumn("at__", F.col(ts).cast("timestamp")).withWatermark("at__", f"{seconds} seconds")
    sums = stamped.groupBy(*ring.keys, F.window("at__", width)).agg(F.sum(F.col(v).cast("bigint")).alias("total"))
    start = nanoseconds(F.col("window.start"))
    return sums.select(*ring.keys, F.call_function("div", start, F.lit(ring.ns_per_row).cast("bigint")).alias("bucket"), "total")


def stream_ring_keyed(events: DataFrame, ns: str, v: str, order: str, ring: Ring) -> DataFrame:
    """keys, bucket, v, newest, late after each micro-batch: a ring per key as state, exact for series that advance at their own pace.

    Events of a micro-batch that share an order value come at once: the newest moves the ring on before any of them is found late.
    """
    rows = events.where(F.col(ns).isNotNull() & (F.col(ns) >= 0)).withColumn("ns__", F.col(ns).cast("bigint")).withColumn("v__", F.col(v).cast("bigint")).withColumn("back__", -F.col("ns__"))
    return stream_fold(rows, list(ring.keys), [order, "back__"], ["ns__", "v__"], lambda *k: RingFold(ring), "bucket bigint, v int, newest bigint, late bigint")


def trim_ring(sums: DataFrame, ring: Ring) -> DataFrame:
    """What stream_ring() wrote, as a ring: the batch operator's columns."""
    from ..functions.scalar import saturate_int

    return ring._trim(sums.groupBy(*ring.keys, "bucket").agg(saturate_int(F.max("total")).alias("v")))


def every(df: DataFrame, seconds: int, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Starts a query that hands each micro-batch's result to a sink at intervals: the periodic report."""
    return df.writeStream.outputMode("update").trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def to_present(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a keyed stream in update mode over all that its source has now; the result after the last micro-batch.

    For checks and backfills: the sink is a Parquet table in the session's checkpoint folder, where each micro-batch has its number, and
    of each batch's keys the last state counts.
    """
    import tempfile
    import uuid

    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    root = root.rstrip("/")
    name = uuid.uuid4().hex
    path = f"{root}/stream-{name}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch__", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch__={number}")

    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/stream-checkpoint-{name}").foreachBatch(sink).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    fields = T.StructType([*stream.schema.fields, T.StructField("batch__", T.LongType())])
    # a key's rows of its last micro-batch; the watermark that follows the last data adds empty batches only
    rows = spark.read.schema(fields).parquet(path)
    last = rows.groupBy(*keys).agg(F.max("batch__").alias("batch__"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "batch__"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.alias("a").join(last.alias("b"), condition, "left_semi").drop("batch__")
