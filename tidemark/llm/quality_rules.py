"""Quality rules: fixed base rules, then an isolation forest over rule statistics.

Short average paths over random splits mark a document as anomalous. Subsamples are small, so that the few bad documents
of one kind in them do not hide each other. The forest's trees are grown on
a bounded sample (``trees * sample`` rows at most, by hash of the id: a documented parameter, as the
method prescribes); the threshold is calibrated on *all* labelled rows, and every document is scored.

Defined results: null or empty text: all counts 0, base_failed true, kept false. Repeated rows and
ties get equal results, null ids stay, extra columns are not read. An empty table gives no rows. Without
labelled rows of both kinds no threshold can be calibrated, and every document that passes the base
rules is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of
from .store import by_hash, text_map, written
from .text_stats import BASE_FIELDS, mapper

#: Statistics that the forest's features need besides the base rules'.
FIELDS = [*BASE_FIELDS, "n_short_words"]
FEATURES = ["symbols_per_word", "chars_per_word", "repeat_share", "short_share"]


def features(n: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(n["n_words"], 1).astype(float)
    return np.column_stack([n[f] / words for f in ("n_symbols", "word_chars", "n_repeat_words", "n_short_words")])


def _harmonic_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    out[n == 2] = 1
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + 0.5772156649015329) - 2 * (n[big] - 1) / n[big]
    return out


@dataclass
class IsolationForest:
    """Flat arrays: node i of a tree splits at column[i] < value[i] to left[i], else left[i] + 1; leaves have left -1 and a path length."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, sample: int, seed: int) -> IsolationForest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        depth = max(1, math.ceil(math.log2(max(sample, 2))))
        grown = [cls._tree(x[rng.choice(len(x), sample, replace=False)], depth, rng) for _ in range(trees)]
        size = max(len(t) for t in grown)
        cols = np.zeros((4, trees, size))
        for i, t in enumerate(grown):
            cols[:, i, : len(t)] = np.array(t).T
        return cls(cols[0].astype(np.int64), cols[1], cols[2].astype(np.int64), cols[3], float(_harmonic_path(np.array([sample]))[0]) or 1.0)

    @staticmethod
    def _tree(x: np.ndarray, depth: int, rng) -> list[tuple]:
        nodes: list[tuple] = [()]
        todo = [(0, x, 0)]
        while todo:
            at, rows, d = todo.pop()
            low, high = rows.min(0), rows.max(0)
            free = np.flatnonzero(high > low)
            if d >= depth or len(rows) < 2 or not len(free):
                nodes[at] = (0, 0.0, -1, d + float(_harmonic_path(np.array([len(rows)]))[0]))
                continue
            c = int(rng.choice(free))
            v = float(rng.uniform(low[c], high[c]))
            side = rows[:, c] < v
            nodes[at] = (c, v, len(nodes), 0.0)
            todo += [(len(nodes), rows[side], d + 1), (len(nodes) + 1, rows[~side], d + 1)]
            nodes += [(), ()]
            for k in (-2, -1):  # an empty side is a leaf of no rows
                if not len(todo[k][1]):
                    nodes[todo[k][0]] = (0, 0.0, -1, float(d + 1))
            todo = [t for t in todo if len(t[1])]
        return nodes

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, left, path in zip(self.column, self.value, self.left, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                to = left[at]
                inner = to >= 0
                if not inner.any():
                    break
                at = np.where(inner, to + (x[rows, column[at]] >= value[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.left) / self.norm)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _scorer(model: IsolationForest, fields: list[str], out: list[str]):
    schema = pa.schema([*((f, pa.int64()) for f in out), ("anomaly", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {f: b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in fields}
            yield batch_of(schema, *(b.column(b.schema.get_field_index(f)).cast(pa.int64()) for f in out), model.score(features(n)))

    return run, ", ".join(f"{f} bigint" for f in out) + ", anomaly double"


#: Thresholds that are tried.
STEPS = 5000


def calibrate(scored: DataFrame, keep_good: float) -> float | None:
    """The threshold over which a document is dropped: of those that keep `keep_good` of the good labelled rows, the one that drops most bad ones.

    scored: quality, anomaly of all labelled rows; only STEPS counts per label come to the driver.
    """
    counts = scored.groupBy("quality", F.ceil(F.col("anomaly") * STEPS).cast("int").alias("step")).count().collect()
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for r in counts:
        (good if r["quality"] == 1 else bad)[r["step"]] += r["count"]
    if not good.sum() or not bad.sum():
        return None
    kept_good, kept_bad = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    able = np.flatnonzero(kept_good >= keep_good)
    best = able[np.argmin(kept_bad[able] * 1e6 - kept_good[able])]
    return float(best) / STEPS


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = 200, sample: int = 24, keep_good: float = 0.998, seed: int = 4) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly."""
    run, schema = mapper(FIELDS)
    stats = written(text_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema), "rule-stats")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    taken = by_hash(stats.where(~failed), ["doc_id", *FIELDS], seed, trees * sample).toPandas()
    counts = ["doc_id", *BASE_FIELDS]
    if not len(taken):
        return stats.select(*counts, failed.alias("base_failed"), (~failed).alias("kept"), F.lit(0.0).alias("anomaly"))
    model = IsolationForest.fit(features({f: taken[f].to_numpy() for f in FIELDS}), trees, sample, seed)
    scored = stats.mapInArrow(*_scorer(model, FIELDS, counts))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    limit = calibrate(scored.where(~failed).join(marks, "doc_id").select("quality", "anomaly"), keep_good)
    verdict = F.lit(True) if limit is None else F.col("anomaly") <= limit
    return scored.select(*counts, failed.alias("base_failed"), (~failed & verdict).alias("kept"), "anomaly")
