"""Plain-Python versions of what the operators compute with arrays, one value at a time."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import fingerprint as fp
from tidemark.llm import language as lg
from tidemark.llm import quality_gbt, quality_rules, toxicity
from tidemark.llm.ftrl import Ftrl
from tidemark.llm.kernel import C1

MASK = 2**64 - 1


# ---- FTRL-proximal (language identification, toxicity)


def plain_ftrl(rows, size, k, alpha, beta, l1, l2):
    """rows: ({coordinate: value}, class, weight). Weights by coordinate and class, and the intercepts."""
    z = [[0.0] * k for _ in range(size + 1)]
    n = [[0.0] * k for _ in range(size + 1)]

    def weight(i, c):
        if i == size:
            return -z[i][c] * alpha / (beta + math.sqrt(n[i][c]))
        if abs(z[i][c]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i][c]) - z[i][c]) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for x, target, w in rows:
        full = {**x, size: 1.0}
        old = {i: [weight(i, c) for c in range(k)] for i in full}
        logits = [sum(v * old[i][c] for i, v in full.items()) for c in range(k)]
        if k == 1:
            error = [1 / (1 + math.exp(-logits[0])) - target]
        else:
            e = [math.exp(a - max(logits)) for a in logits]
            error = [a / sum(e) - (c == target) for c, a in enumerate(e)]
        for i, v in full.items():
            for c in range(k):
                g = v * error[c] * w
                sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                z[i][c] += g - sigma * old[i][c]
                n[i][c] += g * g
    return [[weight(i, c) for c in range(k)] for i in range(size)], [weight(size, c) for c in range(k)]


@pytest.mark.parametrize("k", [1, 3])
def test_ftrl(k):
    rng = np.random.default_rng(k)
    rows = [({int(i): float(rng.random()) + 0.1 for i in rng.choice(30, 6, replace=False)}, int(rng.integers(max(k, 2))), float(rng.integers(1, 4))) for _ in range(200)]
    model = Ftrl(30, k, 0.5, 1.0, 1.5, 0.05)
    for x, target, w in rows:
        model.step(np.array(list(x)), np.array(list(x.values())), target, w)
    weights, intercept = plain_ftrl(rows, 30, k, 0.5, 1.0, 1.5, 0.05)
    assert np.allclose(model.weights(slice(0, 30)), weights, atol=1e-9) and np.allclose(model.intercept(), intercept, atol=1e-9)
    assert 0 < sum(w == 0 for row in weights for w in row) < 30 * k, "l1 leaves some weights at 0"


# ---- language identification


def plain_grams(text: str) -> list[int]:
    s = []
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        x = ord(low) if c.isalpha() else 32
        if x != 32 or s and s[-1] != 32:
            s.append(x)
    if text and (not s or s[-1] != 32):  # a text ends with a space
        s.append(32)
    out = []
    for k in range(1, lg.ORDERS + 1):
        for i in range(len(s) - k + 1):
            h = 0
            for j in range(k):
                h += (s[i + j] + j * 7919 + 1) * int(lg.M[j])
            h &= 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            h ^= h >> 13
            h = h + ((k - 1) * 0x5BD1E995 & 0xFFFFFFFF) & 0xFFFFFFFF
            out.append((h * 0x297A2D39 & 0xFFFFFFFF) >> (32 - lg.BITS))
    return out


TEXTS = ["The cat sat on the mat, twice.", "Die Katze saß auf dem Tisch!", "le chat  dort", "a", "Ünïcödé text with ÀÉ", "one two three four five"]


def test_document_frequencies_and_features():
    schema = pa.schema([("lang", pa.string()), ("chosen", pa.bool_()), ("hash", pa.int64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(TEXTS)), pa.array([i % 2 == 0 for i in range(len(TEXTS))]), pa.array(range(len(TEXTS))), pa.array(TEXTS)], schema=schema)
    rows = [r for b in lg._counts(iter([batch])) for r in b.to_pylist()]
    plain = [Counter(plain_grams(t)) for t in TEXTS]
    df = Counter(g for c in plain for g in c)
    assert {r["bucket"]: r["n"] for r in rows if r["bucket"] is not None} == {**df, -1: len(TEXTS)}
    for r in rows:
        if r["lang"]:
            assert dict(zip(np.frombuffer(r["at"], np.uint16).tolist(), np.frombuffer(r["times"], np.int32).tolist(), strict=True)) == dict(plain[r["hash"]])


def test_language_scores(spark):
    docs = spark.createDataFrame([(i, f"{t} {i}", lang) for i in range(60) for t, lang in zip(TEXTS[:3], ("en", "de", "fr"), strict=True)], "doc_id bigint, text string, lang string")
    model = lg.train(docs, per_language=50)
    langs, score = model.predict([t.encode() for t in TEXTS])
    for t, lang, s in zip(TEXTS, langs, score, strict=True):
        own = plain_grams(t)
        logits = [lg.SCALE / len(own) * sum(float(v[g]) for g in own) + float(b) for v, b in zip(model.values, model.intercept, strict=True)]
        e = [math.exp((a - max(logits)) / model.temperature) for a in logits]
        assert lang == model.languages[int(np.argmax(logits))] and s == pytest.approx(max(e) / sum(e), rel=1e-4)
    assert langs[:3] == ["en", "de", "fr"]


# ---- toxicity


def test_toxicity_model(spark):
    """The fitted weights are those of plain FTRL over the same rows in the same order."""
    rng = np.random.default_rng(7)
    words = ["sun", "rain", "wind", "snow", "bad", "vile"]
    rows = [(i, " ".join(rng.choice(words[:4], 8)) + (" bad vile" if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    options = {"epochs": 2, "alpha": 1.0, "l1": 0.5}
    model = toxicity.train(docs, labels, per_class=1000, seed=3, **options)
    sample = []
    for i, t in rows:
        found, first = toxicity.features([t.encode()])
        at = np.unique(np.concatenate([f[toxicity._span(k, a, 0)] for k, (f, a) in enumerate(zip(found, first, strict=True))]))
        sample.append((int(i % 4 == 0), at.tobytes()))
    sample.sort()
    order = np.random.default_rng(3)
    names = sorted({c for _, at in sample for c in np.frombuffer(at, np.int32).tolist()})
    index = {c: i for i, c in enumerate(names)}
    fed = [({index[c]: 1.0 for c in np.frombuffer(sample[i][1], np.int32).tolist()}, sample[i][0], 3.0 if sample[i][0] else 1.0) for _ in range(2) for i in order.permutation(len(sample)).tolist()]
    weights, intercept = plain_ftrl(fed, len(names), 1, 1.0, 1.0, 0.5, 0.01)
    assert {int(a): pytest.approx(float(w), rel=1e-5) for a, w in zip(model.at, model.weight, strict=True)} == {c: w[0] for c, w in zip(names, weights, strict=True) if w[0]}
    assert model.intercept == pytest.approx(intercept[0])


# ---- gradient-boosted trees


def plain_trees(x, y, trees, depth, rate, bins, penalty, least):
    n, width = x.shape
    edges = [sorted({float(q) for q in np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])}) for c in range(width)]
    p = y.mean()
    f = [math.log(p / (1 - p))] * n
    out = []
    for _ in range(trees):
        q = [1 / (1 + math.exp(-a)) for a in f]
        g, h = [a - b for a, b in zip(q, y, strict=True)], [a * (1 - a) for a in q]
        nodes = {0: list(range(n))}
        splits = {}
        for d in range(depth):
            for node in range(2**d - 1, 2 ** (d + 1) - 1):
                rows = nodes.pop(node)
                G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
                best = (1e-9, 0, math.inf)
                for c in range(width):
                    top = None
                    for e in edges[c]:
                        low = [i for i in rows if x[i, c] <= e]
                        if least <= len(low) <= len(rows) - least:
                            a, b = sum(g[i] for i in low), sum(h[i] for i in low)
                            gain = a * a / (b + penalty) + (G - a) ** 2 / (H - b + penalty) - G * G / (H + penalty)
                            if top is None or gain > top[0] + 1e-12:
                                top = (gain, c, e)
                    if top and top[0] > best[0] + 1e-12:
                        best = top
                splits[node] = best[1:]
                nodes[2 * node + 1] = [i for i in rows if x[i, best[1]] <= best[2]]
                nodes[2 * node + 2] = [i for i in rows if x[i, best[1]] > best[2]]
        leaves = {}
        for node, rows in nodes.items():
            leaves[node] = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + penalty)
            for i in rows:
                f[i] += leaves[node]
        out.append((splits, leaves))
    return out, f


def test_boosted_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3)).round(2)
    y = ((x[:, 0] + x[:, 1] > 0.2) ^ (rng.random(150) < 0.1)).astype(float)
    t = quality_gbt.Trees.fit(x, y, trees=5, depth=3, bins=8, least=5)
    plain, f = plain_trees(x, y, 5, 3, 0.15, 8, 1.0, 5)
    for k, (splits, leaves) in enumerate(plain):
        for node, (c, v) in splits.items():
            assert (t.column[k, node], t.threshold[k, node]) == (c, v)
        assert np.allclose(t.leaf[k], [leaves[i] for i in sorted(leaves)])
    assert np.allclose(t.score(x), [1 / (1 + math.exp(-a)) for a in f])


# ---- isolation forest


def test_isolation_forest_and_threshold(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(200, 2)), rng.normal(6, 1, size=(12, 2))])
    forest = quality_rules.IsolationForest.fit(x, 30, 24, 1)
    path = lambda n: 0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    scores = forest.score(x)
    for row, s in list(zip(x, scores, strict=True))[::9]:
        total = 0.0
        for t in range(30):
            node = 0
            while forest.left[t, node] >= 0:
                node = int(forest.left[t, node]) + (row[forest.column[t, node]] >= forest.value[t, node])
            total += forest.path[t, node]
        assert s == pytest.approx(2 ** (-total / 30 / path(24)))
    quality = [1] * 200 + [0] * 12
    scored = spark.createDataFrame([(q, float(s)) for q, s in zip(quality, scores, strict=True)], "quality int, anomaly double")
    got = quality_rules.calibrate(scored, 0.97)
    steps = [k / quality_rules.STEPS for k in range(quality_rules.STEPS + 2)]
    kept = lambda limit, of: np.mean([s <= limit for q, s in zip(quality, scores, strict=True) if q == of])
    able = [t for t in steps if kept(t, 1) >= 0.97]
    least = min(kept(t, 0) for t in able)
    assert kept(got, 1) >= 0.97 and kept(got, 0) == least


# ---- locally consistent parsing


def plain_mix(x: int) -> int:
    for shift, prime in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * prime & MASK
    return x ^ x >> 31


def toss(a: int, b: int) -> int:
    """Twice the place of the lowest bit in which a and b differ, and that bit of a."""
    place = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * place + (a >> place & 1)


def plain_parse(text: bytes) -> list[list[int]]:
    """Names of the phrases of each level."""
    symbols, names, out = list(text), [int(fp.BYTE_CODES[b]) for b in text], []
    for level in range(fp.LEVELS):
        if not names:
            out.append([])
            continue
        heads = [i for i in range(len(names)) if i == 0 or symbols[i] != symbols[i - 1]]
        ends = heads[1:] + [len(names)]
        names = [plain_mix((names[i] + (j - i) * int(C1)) & MASK) if j - i > 1 else names[i] for i, j in zip(heads, ends, strict=True)]
        symbols = [symbols[i] for i in heads] if level == 0 else names
        n = len(names)
        end = fp.SEP  # stands behind the last symbol
        if level == 0:
            small = [*symbols, end]
        else:
            small = [toss(a, b) for a, b in zip(names, [*names[1:], 0], strict=True)] + [end]
        label = [toss(a, b) for a, b in zip(small, small[1:], strict=False)] + [fp.TOP]
        for _ in range(3):
            label = [fp._toss(a, b) for a, b in zip(label, label[1:], strict=False)] + [fp.TOP]
        starts = [i for i in range(n) if i == 0 or label[i - 1] < label[i] > label[i + 1]]
        phrases = [names[a:b] for a, b in zip(starts, starts[1:] + [n], strict=True)]
        names = [plain_mix(sum(x * pow(fp.BASE, k, 2**64) for k, x in enumerate(p)) & MASK) for p in phrases]
        symbols = names
        out.append(names)
    return out


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"abcabcabc", b"the cat sat on the mat " * 9, "süße Grüße über Straßen, ".encode() * 7, bytes(np.random.default_rng(1).integers(97, 101, 700, dtype=np.uint8))])
def test_locally_consistent_parsing(text):
    got = fp.parse([b"other text", text, b"more"])
    for (names, at), plain in zip(got, plain_parse(text), strict=True):
        assert names[at[1] : at[2]].tolist() == plain
    counts, sketches = fp.fingerprints([text])
    for k, plain in enumerate(plain_parse(text)):
        assert counts[0, k] == len(plain)
        least = {}
        for x in plain:
            least[x & 63] = min(least.get(x & 63, MASK), x >> 24)
        assert sketches[0, k].tolist() == [least[b] % 255 + 1 if b in least else 0 for b in range(64)]
