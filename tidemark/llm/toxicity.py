"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of pairs of adjacent words and of pairs with one word between them, lower-cased
and without punctuation, hashed to 2**20 coordinates. L1 leaves few of them with a weight; those few are broadcast. The
weights are fitted on a sample of `per_class` labelled documents of each class at most, one row an id, and of `most_bytes` bytes of
coordinates of each class at most (in the order of a hash of the id; documented parameters), and the intercept is moved to
the classes' shares among all labelled rows.

Defined results: null and empty texts get the score of a text without any feature. Rows without a label
are scored, not learned from; a document with several labels counts as toxic if one says so. Without labels of both
classes every score is the share of toxic ones (0 if there are none); without a document of both, that of the labels. Repeated rows and null ids stay; a null id is in
fold 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl
from .kernel import C1, C2, C3, LOWER, U64, Words, batch_of, chunks, mix
from .store import brought, by_hash, dropped, fold_of, text_map, within, written

BITS = 20
#: Bytes between words: all of ASCII but letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Coordinates of words, pairs and skip-pairs of all texts, and where each text's begin in each of the three."""
    w = Words(texts, spaces=BETWEEN, fold=LOWER)
    h = w.hashes()
    cut = U64(64 - BITS)
    out, at = [(h >> cut).astype(np.int32)], [w.first]
    for gap, a, b in ((1, C1, C2), (2, C2, C3)):
        n = max(len(h) - gap, 0)
        pair = mix(h[:n] * a + h[gap:] * b)
        out.append((pair >> cut).astype(np.int32))
        at.append(w.first)
    return out, at


def _span(kind: int, first: np.ndarray, i: int) -> slice:
    """The features of one kind that lie within text i."""
    return slice(int(first[i]), max(int(first[i + 1]) - kind, int(first[i])))


@dataclass
class ToxicityModel:
    at: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.at] = self.weight
        return dense

    def score(self, texts: list[bytes], dense: np.ndarray) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        found, firsts = features(texts)
        docs, coordinates = [], []
        for kind, (f, first) in enumerate(zip(found, firsts, strict=True)):
            hit = np.flatnonzero(dense[f])
            doc = np.searchsorted(first, hit, side="right") - 1
            inside = hit + kind < first[doc + 1]
            docs.append(doc[inside])
            coordinates.append(f[hit[inside]])
        doc, f = np.concatenate(docs), np.concatenate(coordinates)
        key = np.unique(doc.astype(np.int64) << BITS | f)
        np.add.at(total, key >> BITS, dense[key & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary())])
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            found, first = features(texts)
            at = [np.unique(np.concatenate([f[_span(k, a, i)] for k, (f, a) in enumerate(zip(found, first, strict=True))])).tobytes() for i in range(len(texts))]
            yield batch_of(schema, part.column(0), part.column(1).cast(pa.int32()), at)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = 3000, most_bytes: int = 64 << 20, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.01, weight: float = 3.0, seed: int = 3) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, `column`), of the rows to learn from. weight: of a toxic document's error."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label")).cache()
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), 60.0 if n1 else -60.0)
    ids = by_hash(marks.where("label = 1"), ["doc_id"], seed, per_class).union(by_hash(marks.where("label = 0"), ["doc_id"], seed, per_class))
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = written(text_map(one.select("doc_id", "label", "text"), _extract, "doc_id bigint, label int, at binary"), "toxicity-sample")
    marks.unpersist()
    found = within(table, ["label"], F.xxhash64(F.lit(seed), "doc_id"), F.length("at"), per_class, most_bytes).select("label", "at")
    sample = sorted((r["label"], bytes(r["at"])) for r in brought(found, 2 * most_bytes))  # 2 * per_class rows, 2 * most_bytes at most
    dropped(table)
    taken = [sum(y == k for y, _ in sample) for k in (0, 1)]
    if not all(taken):  # documents of one class alone are here
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(n1 / n0)))
    rng = np.random.default_rng(seed)
    model = Ftrl(1 << BITS, 1, alpha, beta, l1, l2)
    for _ in range(epochs):
        for i in rng.permutation(len(sample)).tolist():
            at = np.frombuffer(sample[i][1], np.int32)
            model.step(at, np.ones(len(at)), sample[i][0], weight if sample[i][0] else 1.0)
    weights = model.weights(slice(0, 1 << BITS))[:, 0]
    hit = np.flatnonzero(weights)
    shift = np.log(n1 / n0) - np.log(taken[1] / taken[0])
    return ToxicityModel(hit, weights[hit].astype(np.float32), float(model.intercept()[0] + shift))


def score(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """docs -> the columns named (kept as they are), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 weights at most
    out = docs.select(*columns).schema.add("score", "double")
    names = [*columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.table()
        for batch in batches:
            for part, texts in chunks(batch, "text__"):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.array(shared.value.score(texts, dense))], names)

    return text_map(docs.select(*columns, F.col("text").cast("string").alias("text__")), run, out)


def toxicity_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, **parameters) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted; learns from rows of the other folds only."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = fold_of("doc_id", folds) == fold
    model = train(docs.where(~held), labels.where(~held), **parameters)
    out = score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
