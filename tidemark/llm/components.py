"""Connected components of an edge table, contracted within tasks and then by alternating large-star and small-star steps, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of
from .store import dropped, written

#: A key with fewer rows than this is never hot, and tables of fewer rows have no hot keys.
COLD = 1024
#: Narrow rows that are worth a task, up to the session's number of shuffle partitions.
ROWS_OF_TASK = 10_000
#: Keys that can be hot at once: each has more than this part of all rows.
HOT_KEYS = 4096
#: Edges that a task contracts at once (16 bytes each).
EDGES_OF_TASK = 1 << 17


def join_sizes(rows: DataFrame, keyed: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """rows joined with keyed, which has one row a key and the number of its rows as `n`; total: all rows; most: those of the key that has most.

    Keys with more than max(COLD, total / HOT_KEYS) rows, HOT_KEYS of them at most, are broadcast, so that their rows stay where
    they are; only the rows of other keys are shuffled, and none of these keys fills a task. Tables that spread() dealt out are joined where they are.
    """
    cut = max(COLD, total // HOT_KEYS)
    if most <= cut:
        return rows.join(keyed.hint("merge"), key)
    hot = keyed.where(F.col("n") > cut)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col("n") <= cut).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def spread(rows: DataFrame, total: int, key: str) -> DataFrame:
    """rows dealt by a key to as many tasks as `total` narrow rows are worth, so that what is grouped and joined by it next needs no shuffle more."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(most, -(-total // ROWS_OF_TASK))), key)


def sizes_of(keyed: DataFrame) -> tuple[int, int]:
    """The sum and the greatest of `n`: what join_sizes() asks for."""
    return tuple(keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges but the least of each component, and beside each that least one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))
    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
    root = np.array(parent, np.int64)
    while (root[root] != root).any():
        root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """edges (u, v) -> u, v: the stars of `most` edges at a time, or a few more; no shuffle, and the same components."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            n += batch.num_rows
            if n >= most:
                yield batch_of(schema, *stars(*map(np.concatenate, zip(*held, strict=True))))
                held, n = [], 0
        if n:
            yield batch_of(schema, *stars(*map(np.concatenate, zip(*held, strict=True))))

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """edges (u, v bigint) -> node, component: every node with an edge to another one, and the least node that it can reach.

    Tasks contract what they read first: after that, EDGES_OF_TASK edges are one task's work, without a shuffle, and more of them are
    left to rounds. Each round is a table in the shared folder, so that lost executors cost one round at most. Rounds
    grow with the logarithm of the longest path. Null ends and loops are no edges; repeated edges are one.
    """
    first = written(_contracted(edges.where("u <> v").select("u", "v"), EDGES_OF_TASK), name)
    tasks = -(-first.count() // EDGES_OF_TASK)
    now = written(_contracted(first.coalesce(max(1, tasks)), EDGES_OF_TASK), name)
    dropped(first)
    return _stars_of(now if tasks <= 1 else _rounds(now, name, most))


def _stars_of(now: DataFrame) -> DataFrame:
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _rounds(now: DataFrame, name: str, most: int) -> DataFrame:
    """now (u, v), u > v, a table of written() -> the same with the least node of each component for v."""
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        total = 2 * state[0]
        largest = _largest_degree(now) if total > COLD else 0
        both = spread(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), total, "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_sizes(both.where("v > u"), least, "u", total, largest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = spread(large, total, "u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_sizes(large, low, "u", total, largest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        small = spread(small, total, "u").distinct()
        new = written(small, name)
        dropped(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _largest_degree(edges: DataFrame) -> int:
    return edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").count().agg(F.max("count")).first()[0] or 0
