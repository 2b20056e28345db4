"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams, temperature-calibrated.

Texts are folded to lower-case letters, everything else to single spaces. Features are hashed 1-, 2- and
3-grams; term frequencies are shares of a text's n-grams. Document frequencies are counted over *all* rows of
the training fold; the weights are fitted by FTRL-proximal with elastic-net penalties on a sample of `per_language`
training documents of each language at most, the first in the order of a hash of id and text, equal ones once, and of
`most_bytes` of counts (documented parameters), and a fifth of the sample sets the temperature.

Defined results: lang_pred is ``und`` with score 0 where the text is null or has no letter, or where nothing could be
learned. Ties go to the language that sorts first. Repeated rows and null ids stay; a null id is in fold 0. An empty
table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import Ftrl, softmax
from .kernel import batch_of, chunks
from .store import brought, dropped, fold_of, text_map, within, written

BITS = 16
SIZE = 1 << BITS
SCALE = 100.0
ORDERS = 3
M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]

_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter; built once a process."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (order by order within a text's span), where each text's begin, and whether each has a letter.

    Of each order, row i of the first array has the n-gram that begins at symbol i; n-grams do not span texts.
    """
    codes = np.frombuffer("\n".join([t.decode() for t in texts]).encode("utf-32-le") + "\n".encode("utf-32-le"), np.uint32)
    lengths = np.array([int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    s = folded()[codes]
    keep = s != 32
    letters = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=letters[1:])
    has = np.diff(letters[np.concatenate(([0], ends))]) > 0
    keep[1:] |= keep[:-1]  # the first of a run of spaces stays
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    at = kept[np.concatenate(([0], ends))]
    s = s[keep]
    n = len(s)
    out = np.empty((ORDERS, n), np.uint16)
    h = np.zeros(n, np.uint32)
    for k in range(ORDERS):
        h[: n - k] += (s[k:] + np.uint32(k * 7919 + 1)) * M[k]
        x = h ^ (h >> np.uint32(15))
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        x += np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF)
        out[k] = (x * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)
    return out, at, has


def doc_grams(all_grams: np.ndarray, a: int, b: int) -> np.ndarray:
    """The n-grams of the text in [a, b), of which none reaches beyond it."""
    return np.concatenate([all_grams[k, a : max(b - k, a)] for k in range(ORDERS)])


@dataclass
class LanguageModel:
    languages: list[str]
    values: np.ndarray  # idf times weight, [language, feature]
    intercept: np.ndarray
    temperature: float
    support: np.ndarray | None = None  # log of each feature's share of the language that has most of it
    usual: dict[str, tuple[float, float]] | None = None  # mean and deviation of evidence, each sample row judged by the others

    def logits(self, counted: np.ndarray) -> np.ndarray:
        return np.array([SCALE / max(len(counted), 1) * float(v[counted].sum(dtype=np.float64)) for v in self.values]) + self.intercept

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """predict(), and each text's evidence (mean support of its n-grams; 0 if the model has none) and number of n-grams."""
        evidence, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), evidence, many
        found, at, has = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for i in np.flatnonzero(has).tolist():
            own = doc_grams(found, at[i], at[i + 1])
            out[i] = self.logits(own)
            if self.support is not None:
                evidence[i], many[i] = self.support[own].mean(dtype=np.float64), len(own)
        p = softmax(out / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, p.max(1), 0.0), evidence, many


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, chosen, hash, text): document frequencies (bucket, n; bucket -1: documents) and the chosen rows' features, equal ones once a task."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("lang", pa.string()), ("hash", pa.int64()), ("at", pa.binary()), ("times", pa.binary())])
    df, docs = np.zeros(SIZE, np.int64), 0
    before: set[tuple[str, int]] = set()  # of the chosen
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            found, at, has = grams(texts)
            langs, chosen, hashes = (part.column(k).to_pylist() for k in range(3))
            rows = []
            for i in np.flatnonzero(has).tolist():
                seen = np.zeros(SIZE, bool)
                own = doc_grams(found, at[i], at[i + 1])
                seen[own] = True
                df += seen
                docs += 1
                if chosen[i] and (langs[i], hashes[i]) not in before:
                    before.add((langs[i], hashes[i]))
                    times = np.bincount(own, minlength=SIZE)
                    hit = np.flatnonzero(times)
                    rows.append((None, None, langs[i], hashes[i], hit.astype(np.uint16).tobytes(), times[hit].astype(np.int32).tobytes()))
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))
    hit = np.flatnonzero(df)
    none = [None] * (len(hit) + 1)
    yield batch_of(schema, [*hit.tolist(), -1], [*df[hit].tolist(), docs], none, none, none, none)


def train(docs: DataFrame, per_language: int = 1500, most_bytes: int = 256 << 20, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 2, evidence: bool = False) -> LanguageModel:
    """docs: text, lang of the rows to learn from (null lang: ignored), and doc_id for the sample's hash. evidence: learns what known() needs, too."""
    rows = docs.where("lang is not null and text is not null").withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}  # a row a language
    if not sizes:
        return LanguageModel([], np.zeros((0, SIZE), np.float32), np.zeros(0), 1.0)
    languages = sorted(sizes)
    # a cut at the hash below which somewhat more rows lie than are wanted; the exact limit comes after
    cut = {lang: int(-(2**63) + min(1.0, (1.1 * per_language + 4 * per_language**0.5 + 10) / n) * (2**64 - 1)) for lang, n in sizes.items()}
    bound = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(cut[lang], 2**63 - 1))))[F.col("lang")]
    table = written(text_map(rows.select("lang", (F.col("hash") <= bound).alias("chosen"), "hash", "text"), _counts, "bucket int, n bigint, lang string, hash bigint, at binary, times binary"), "language-counts")
    df = np.zeros(SIZE)
    total = 1
    for bucket, n in table.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 65,537 rows at most
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    index = {lang: i for i, lang in enumerate(languages)}
    sample = []  # as compact as it comes
    chosen = within(table.where("lang is not null").dropDuplicates(["lang", "hash"]), ["lang"], F.col("hash"), F.length("at") + F.length("times"), per_language, most_bytes // len(languages))
    for r in brought(chosen.select("lang", "at", "times"), most_bytes):  # per_language rows of each language and most_bytes at most
        sample.append((index[r["lang"]], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["times"], np.int32)))
    dropped(table)
    sample.sort(key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    model = Ftrl(SIZE, len(languages), alpha, beta, l1, l2)

    def row(i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Coordinates, TF-IDF values and class of a row of the sample."""
        target, at, times = sample[i]
        return at.astype(np.int64), times * (SCALE / times.sum()) * idf[at], target

    for _ in range(epochs):
        for i in rng.permutation(fit).tolist():
            model.step(*row(i))
    weights = model.weights(slice(0, SIZE))
    if len(languages) > 1 and len(held):
        logits = np.stack([x @ weights[at] for at, x, _ in map(row, held.tolist())]) + model.intercept()
        temperature = _temperature(logits, np.array([sample[i][0] for i in held.tolist()]))
    else:
        temperature = 1.0
    return LanguageModel(languages, np.ascontiguousarray((weights * idf[:, None]).T.astype(np.float32)), model.intercept(), temperature, *(_support(languages, sample) if evidence else ()))


def _support(languages: list[str], sample: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """From (language, features, times): LanguageModel's support and usual."""
    counts = np.zeros((len(languages), SIZE))
    for k, at, times in sample:
        counts[k, at] += times
    totals = counts.sum(1)
    share = np.log((counts + 0.5) / (totals[:, None] + 0.5 * SIZE))
    first = share.argmax(0)
    best = share.max(0)
    share[first, np.arange(SIZE)] = -np.inf
    second = share.max(0)
    found: dict[str, list[float]] = {}
    for k, at, times in sample:
        n = times.sum()
        own = np.log((counts[k, at] - times + 0.5) / (totals[k] - n + 0.5 * SIZE))
        found.setdefault(languages[k], []).append(float(np.maximum(np.where(first[at] == k, second[at], best[at]), own) @ times / n))
    return best.astype(np.float32), {k: (float(np.mean(v)), float(np.std(v))) for k, v in found.items()}


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The one of a geometric grid with the least log loss."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model: LanguageModel, columns: list[str], evidence: bool = False) -> DataFrame:
    """docs -> the columns named (kept as they are), lang_pred, score and, with evidence, evidence, n_grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language
    kept = docs.select(*columns)
    out = kept.schema.add("lang_pred", "string").add("score", "double")
    out = out.add("evidence", "double").add("n_grams", "long") if evidence else out
    more = ["evidence", "n_grams"] if evidence else []
    names = [*columns, "lang_pred", "score", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text__"):
                langs, score, *rest = shared.value.judge(texts)
                rest = [pa.array(rest[0], pa.float64()), pa.array(rest[1], pa.int64())] if evidence else []
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.array(langs, pa.string()), pa.array(score, pa.float64()), *rest], names)

    return text_map(docs.select(*columns, F.col("text").cast("string").alias("text__")), run, out)


def known(docs: DataFrame, model: LanguageModel, columns: list[str], deviations: float = 4.0, least: float = 1.0, short: float = 16.0) -> DataFrame:
    """The columns named of docs (text, lang) that have a letter and are in a language that was learned; of all with a letter, where none was.

    A text's evidence may lie below the mean of its language's labelled rows by `deviations` standard deviations, or
    `least` if that is more, and by `short` over the root of its number of n-grams (about three standard errors of their
    mean, so that a key or a name does not cost a short text its place). Mean and deviation are over all labelled
    rows, or as the model's sample has them with each row judged by the others, where that is looser: of few rows little
    can be said. The number of languages has no part in it.
    """
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*columns)
    labelled = predict(docs.where("lang is not null and text is not null"), model, ["lang"], evidence=True).where("n_grams > 0")
    rows = labelled.groupBy("lang").agg(F.avg("evidence").alias("mean"), F.stddev_pop("evidence").alias("sd")).collect()  # a row a language
    low = {}
    for r in rows:
        mean, sd = model.usual.get(r["lang"], (r["mean"], 0.0))
        low[r["lang"]] = min(mean, r["mean"]) - max(deviations * max(sd, r["sd"]), least)
    found = predict(docs, model, columns, evidence=True).where("lang_pred <> 'und'")
    if not low:
        return found.select(*columns)
    bound = F.create_map(*(F.lit(x) for pair in sorted(low.items()) for x in pair))[F.col("lang_pred")]
    return found.where(F.coalesce(F.col("evidence") >= bound - F.lit(short) / F.sqrt("n_grams"), F.lit(True))).select(*columns)


def identify(docs: DataFrame, learn: DataFrame, **parameters) -> DataFrame:
    """docs (doc_id, text), learn (doc_id, text, lang) -> doc_id, lang_pred, score."""
    return predict(docs, train(learn, **parameters), ["doc_id"])


def identify_held_out(docs: DataFrame, folds: int = 4, fold: int = 2, **parameters) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; learns from rows of the other folds only."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = fold_of("doc_id", folds) == fold
    model = train(docs.where(~held), **parameters)
    return predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
