"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The trees are grown on a bounded sample of labelled rows (`most`, by a hash of the id: a documented parameter);
every document's statistics come from its whole text. A tree is complete, its nodes in level order, so that a
batch walks it by index arithmetic: node = 2 * node + 1 + (value > threshold).

Defined results: null and empty texts have all-zero statistics and a score like any other. Documents without
a label are scored, not learned from; of several labels the greatest counts. Without rows of both classes every
score is the share of label 1 (0 if there are none). Repeated rows and null ids stay; a null id is in fold 0. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of
from .store import by_hash, fold_of, text_map, written
from .text_stats import FIELDS, mapper


def features(n: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(n[f], 1).astype(float) for f in ("n_words", "n_chars", "n_lines"))
    return np.column_stack([
        np.log1p(n["n_words"]), np.log1p(n["n_chars"]), n["word_chars"] / words, n["n_symbols"] / words, n["n_dup_lines"] / lines, n["n_repeat_words"] / words, words / lines,
        n["n_upper"] / chars, n["n_digits"] / chars, n["n_punct"] / chars, n["n_exclaim"] / words, n["n_unique_words"] / words, n["longest_word"], n["n_unique_lower"] / words, n["n_short_words"] / words, np.log1p(n["n_dup_lines"]),
    ])


@dataclass
class Trees:
    column: np.ndarray  # [tree, inner node]
    threshold: np.ndarray
    leaf: np.ndarray  # [tree, leaf]
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: int = 20) -> Trees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], 1)  # bin b: edges[b-1] < x <= edges[b]
        inner = 2**depth - 1
        column, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        base = float(np.log(p / (1 - p)))
        f = np.full(n, base)
        least = min(least, max(1, n // 20))
        for t in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            node = np.zeros(n, np.int64)
            for d in range(depth):
                k, first = 2**d, 2**d - 1
                own = node - first
                best, best_c, best_b = np.full(k, 1e-9), np.zeros(k, np.int64), np.full(k, -1)
                for c in range(width):
                    if not len(edges[c]):
                        continue
                    m = len(edges[c]) + 1
                    key = own * m + binned[:, c]
                    G, H, N = (np.cumsum(np.bincount(key, weights=w, minlength=k * m).reshape(k, m), 1) for w in (g, h, None))
                    left, right = (G[:, :-1], H[:, :-1]), (G[:, -1:] - G[:, :-1], H[:, -1:] - H[:, :-1])
                    gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - G[:, -1:] ** 2 / (H[:, -1:] + penalty)
                    gain[(N[:, :-1] < least) | (N[:, -1:] - N[:, :-1] < least)] = -1
                    b = gain.argmax(1)
                    top = gain[np.arange(k), b]
                    better = top > best
                    best[better], best_c[better], best_b[better] = top[better], c, b[better]
                for i in range(k):
                    if best_b[i] >= 0:
                        column[t, first + i], threshold[t, first + i] = best_c[i], edges[best_c[i]][best_b[i]]
                node = 2 * node + 1 + (x[np.arange(n), column[t, node]] > threshold[t, node])
            at = node - inner
            leaf[t] = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + penalty)
            f += leaf[t][at]
        return cls(column, threshold, leaf, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.column.shape[1] if len(self.column) else 0
        for column, threshold, leaf in zip(self.column, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, column[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def train(stats: DataFrame, labels: DataFrame, most: int = 20_000, seed: int = 8, **parameters) -> Trees:
    """stats (doc_id, FIELDS), labels (doc_id, quality), of the rows to learn from."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    taken = by_hash(stats.join(marks, "doc_id").select("doc_id", "label", *FIELDS), ["doc_id", *FIELDS], seed, most).toPandas()
    y = taken["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 60.0 if len(y) and y[0] else -60.0)
    return Trees.fit(features({f: taken[f].to_numpy() for f in FIELDS}), y, **parameters)


def quality_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, cut: float = 0.3, **parameters) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted; learns from rows of the other folds only."""
    run, schema = mapper(FIELDS)
    stats = written(text_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema), "quality-stats")
    held = fold_of("doc_id", folds) == fold
    model = train(stats.where(~held), labels.where(~held), **parameters)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {f: b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FIELDS}
            yield batch_of(out, b.column(0), b.column(1), model.score(features(n)))

    scored = stats.select("doc_id", held.alias("held_out"), *FIELDS).mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
