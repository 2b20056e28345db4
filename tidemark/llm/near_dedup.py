"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's set of word shingles gives a set key and a signature of one-byte minima; each eight bytes of it are a
   band. Documents with equal sets are one class.
2. Classes that share a band are candidates. In each bucket the least class is the hub, in a bucket of many the least of
   each of about sqrt(n) parts, with the least of all above them: nothing is emitted for pairs, and no hub has many.
3. Hubs first: batches of the signatures of hub and member are compared, and pairs whose posterior probability of
   reaching the threshold is too low are dropped. The sets of each class and of its most similar hub are compared exactly.
4. The rest: the buckets of one hub are a group. Groups that links have not made one component yet are dealt out
   in blocks. Signatures alone go to the blocks; pairs of different components that share a band are pruned by batches. The
   sets of classes in a surviving pair follow last and are compared exactly. A task emits a spanning forest of its links, never
   all pairs.
5. Components of the links give each document the least doc_id that it can reach.

Shingle sets are sets of 64-bit hashes of whole shingles (each word is mixed by its bytes, each shingle word after word), of which two
different ones are equal with probability 2**-64; sizes and intersections are counted on full sets. A link at exactly the threshold
shares no band with probability `miss` at most, and is pruned with posterior probability `miss` at most, added up over all batches.

Defined results: null or empty texts, and texts without a word, have n_shingles 0 and are linked with nothing. Rows
that share a doc_id are one document: they have one component. A row without doc_id has no component
and is kept. Repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import COLD, components, join_sizes, sizes_of
from .kernel import C1, LOWER, U64, Words, batch_of, chunks, mix
from .store import dropped, text_map, written

ROWS = 8
BATCH = 32
#: A block has about so many classes, or so many shingles if that is fewer classes.
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000


def n_bands(percent: int, miss: float) -> int:
    """Bands of ROWS rows of which a pair at the threshold shares one with probability 1 - miss."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS)))


@lru_cache
def hash_parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(6))
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """A byte of each of n minima of hash functions over the shingles."""
    a, b = hash_parameters(n)
    x = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (a * x[at : at + 512] + b).min(1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased; a text of fewer words is one shingle, none is an empty set."""
    w = Words(texts, fold=LOWER)
    h = w.hashes()
    n = max(len(h) - words + 1, 0)
    grams = h[:n].copy()
    for k in range(1, words):
        grams = mix(grams * C1 + h[k : n + k])
    out = []
    first = w.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:  # the whole sequence
            total = np.array([b - a], U64)
            for k in range(a, b):
                total = mix(total * C1 + h[k : k + 1])
            out.append(total)
        else:
            out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that, with its size, tell it from others."""
    return (int(np.bitwise_xor.reduce(s).astype(np.int64)), int(mix(s * C1).sum(dtype=U64).astype(np.int64))) if len(s) else (0, 0)


@lru_cache
def least_matches(percent: int, miss: float, most: int) -> list[int]:
    """For each number n of compared bytes (a multiple of BATCH): with fewer matches the posterior probability that the similarity reaches the threshold, under a uniform prior, is below miss / batches.

    Bytes of different minima agree once in 256, so that a similarity of t shows as t + (1 - t) / 256.
    """
    t, out = percent / 100, []
    t += (1 - t) / 256
    miss /= most // BATCH
    for n in range(BATCH, most + 1, BATCH):
        p, m = 0.0, 0
        while m <= n:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of left, of right) that no batch prunes, and the share of their bytes that agree."""
    n = left.shape[1] // BATCH * BATCH
    matches = np.zeros(len(pairs), np.int64)
    for k, need in enumerate(least_matches(percent, miss, n)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        for lo in range(0, len(pairs), 65536):
            p = pairs[lo : lo + 65536]
            matches[lo : lo + 65536] += (left[p[:, 0], at] == right[p[:, 1], at]).sum(1)
        ok = matches >= need
        pairs, matches = pairs[ok], matches[ok]
        if not len(pairs):
            break
    return pairs, matches / max(n, 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def candidates(bands: np.ndarray, sizes: np.ndarray, component: np.ndarray, blocks: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of one block, or between two if two are there, and how alike they are: of different components, and sharing a band."""
    low, high = blocks.min(), blocks.max()
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    signatures = np.ascontiguousarray(bands).view(np.uint8)
    found, alike = [], []
    step = max(1, 500_000 // len(b))
    for lo in range(0, len(a), step):
        i = a[lo : lo + step]
        able = component[i][:, None] != component[b][None, :]
        if low == high:
            able &= i[:, None] < b[None, :]
        able &= 100 * np.minimum(sizes[i][:, None], sizes[b][None, :]) >= percent * np.maximum(sizes[i][:, None], sizes[b][None, :])
        x, y = np.nonzero(able)
        pairs, share = survivors(signatures, signatures, np.column_stack((i[x], b[y])), percent, miss)
        ok = (bands[pairs[:, 0]] == bands[pairs[:, 1]]).any(1)
        found.append(pairs[ok])
        alike.append(share[ok])
    return np.concatenate(found), np.concatenate(alike)


def forest(sets: list[np.ndarray], pairs: np.ndarray, alike: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among these pairs that span all of them, given components that are linked already."""
    parent = {c: c for c in component.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in pairs[np.argsort(-alike, kind="stable")].tolist():
        x, y = root(int(component[i])), root(int(component[j]))
        if x != y and linked(sets[i], sets[j], percent):
            parent[x] = y
            links.append((i, j))
    return links


# ---- tasks


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column, all of one length, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows that follow each other and agree in some columns of whole numbers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        n = batch.num_rows
        if not n:
            continue
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _keys(words: int, bands: int):
    """mapInArrow over (doc_id, text): doc_id, n_shingles, k1, k2, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    salt = mix(np.arange(1, bands + 1, dtype=U64)).astype(np.int64)  # bytes agree with it where they do without

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, words)
                keys = [set_key(s) for s in sets]
                yield batch_of(schema, part.column(0), [len(s) for s in sets], [k for k, _ in keys], [k for _, k in keys], [signature(s, bands * ROWS).view(np.int64) ^ salt if len(s) else None for s in sets])

    return run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"


def _prune(percent: int, miss: float):
    """mapInArrow over (u, v, n_u, n_v, bands_u, bands_v): u, v and how alike they are, of the pairs that are not pruned."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("alike", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            left, right = (_matrix(at[f]).view(np.uint8) for f in ("bands_u", "bands_v"))
            small, large = (f(at["n_u"].to_numpy(), at["n_v"].to_numpy()) for f in (np.minimum, np.maximum))
            able = np.flatnonzero(100 * small >= percent * large)
            pairs, alike = survivors(left, right, np.column_stack((able, able)), percent, miss)
            out = pa.array(pairs[:, 0])
            yield batch_of(schema, at["u"].take(out), at["v"].take(out), alike)

    return run, "u bigint, v bigint, alike double"


def _sets(words: int):
    """mapInArrow over (cid, n, k1, k2, groups, text): a row (grp, cid, shingles) for each group, of texts that have the class's set."""
    schema = pa.schema([("grp", pa.int64()), ("cid", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                rows = part.select(["cid", "n", "k1", "k2", "groups"]).to_pylist()
                out = [(g, r["cid"], s.tobytes()) for r, s in zip(rows, shingle_sets(texts, words), strict=True) if (len(s), *set_key(s)) == (r["n"], r["k1"], r["k2"]) for g in r["groups"]]
                if out:
                    yield batch_of(schema, *zip(*out, strict=True))

    return run, "grp bigint, cid bigint, shingles binary"


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _hub_links(percent: int):
    """mapInArrow over rows of _sets(), a hub (cid = grp) before its members: u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 64):
                for grp, cid, raw in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    s = np.frombuffer(raw, U64)
                    if cid == grp:
                        now, hub = grp, s
                    elif grp == now and linked(hub, s, percent):
                        found.append((grp, cid))
            if found:
                yield batch_of(LINKS, *zip(*found, strict=True))

    return run, "u bigint, v bigint"


def _candidates_of(t: pa.Table, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    component = t["c1"].to_numpy()
    return *candidates(_matrix(t["bands"]), t["n"].to_numpy(), component, t["block"].to_numpy(), percent, miss), component


def _survivors_of_blocks(percent: int, miss: float):
    """mapInArrow over (b1, b2, block, cid, c1, n, bands) with all rows of a pair of blocks in a row: b1, b2, cid of the classes in surviving pairs."""
    schema = pa.schema([("b1", pa.int64()), ("b2", pa.int64()), ("cid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "b1", "b2"):
            pairs, _, _ = _candidates_of(t, percent, miss)
            if len(pairs):
                at = np.unique(pairs)
                yield batch_of(schema, [t["b1"][0].as_py()] * len(at), [t["b2"][0].as_py()] * len(at), t["cid"].to_numpy()[at])

    return run, "b1 bigint, b2 bigint, cid bigint"


def _links_of_blocks(percent: int, miss: float):
    """mapInArrow over the same rows of the classes in surviving pairs, with their sets: u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "b1", "b2"):
            pairs, alike, component = _candidates_of(t, percent, miss)
            if len(pairs):
                cid = t["cid"].to_numpy()
                found = forest([np.frombuffer(x, U64) for x in t["shingles"].to_pylist()], pairs, alike, component, percent)
                if found:
                    yield batch_of(LINKS, *(cid[np.array(x)] for x in zip(*found, strict=True)))

    return run, "u bigint, v bigint"


# ---- plans


def _members(classes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """A row (cid, top, hub, n) for each class in a bucket of n, two or more: the bucket's least class, and that of its part if the bucket has many."""
    member = classes.select(F.explode("bands").alias("bucket"), "cid")
    stars = written(member.groupBy("bucket").agg(F.min("cid").alias("top"), F.count("*").alias("n")).where("n > 1"), "near-stars")
    tables.append(stars)
    total, most = sizes_of(stars)
    rows = join_sizes(member, stars, "bucket", total, most)
    if most <= COLD:
        return rows.select("cid", "top", F.col("top").alias("hub"), "n")
    part = F.pmod(F.xxhash64("cid"), F.pow(F.lit(2), F.ceil(F.log2(F.sqrt("n")))).cast("bigint"))
    many = rows.where(F.col("n") > COLD).withColumn("hub", F.min("cid").over(Window.partitionBy("bucket", part)))
    return rows.where(F.col("n") <= COLD).select("cid", "top", F.col("top").alias("hub"), "n").union(many.select("cid", "top", "hub", "n"))


def _with_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """need (cid, rep, n, k1, k2, groups) -> rows of _sets(). Hashing what is needed spares a sort of the texts."""
    return text_map(docs.join(need.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("cid", "n", "k1", "k2", "groups", "text"), *_sets(words))


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (grp, cid, c1, n, bands) -> the same once for each pair of blocks (b1, b2) of its group that the class is in, with its block.

    A component of half a block or more has blocks of its own, which are not compared with each other; the others of a
    group share blocks, whole components together.
    """
    weight = F.greatest(F.sum(F.lit(1.0)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    parts = rows.groupBy("grp", "c1").agg(weight.alias("w"), F.count("*").alias("rows__"))
    own = F.col("w") >= 0.5
    shared = parts.where(~own).groupBy("grp").agg(F.ceil(F.sum("w")).alias("many"))
    shared = shared.select("grp", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("k")).select("grp", F.xxhash64("grp", F.lit(0), "k").alias("block"), F.lit(None).cast("bigint").alias("alone"))
    single = parts.where(own).select("grp", "c1", F.explode(F.sequence(F.lit(0), F.ceil("w") - 1)).alias("k")).select("grp", F.xxhash64("grp", "c1", "k").alias("block"), F.col("c1").alias("alone"))
    blocks = shared.union(single)
    others = blocks.select("grp", F.col("block").alias("other"), F.col("alone").alias("other_alone"))
    partner = blocks.join(others, "grp").where("alone is null or other_alone is null or alone <> other_alone")
    partner = partner.select("block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    many = parts.where(~own).groupBy("grp").agg(F.ceil(F.sum("w")).alias("many"))
    where = parts.join(many, "grp", "left").select(F.xxhash64("grp", "c1").alias("part"), "grp", "c1", own.alias("own"), F.ceil("w").alias("k"), "many", F.col("rows__").alias("n"))
    keyed = rows.withColumn("part", F.xxhash64("grp", "c1")).withColumnRenamed("n", "size__")
    placed = join_sizes(keyed, where.select("part", "own", "k", "many", "n"), "part", *sizes_of(where)).drop("n").withColumnRenamed("size__", "n")
    block = F.when(F.col("own"), F.xxhash64("grp", "c1", F.pmod(F.xxhash64("cid"), "k"))).otherwise(F.xxhash64("grp", F.lit(0), F.pmod(F.xxhash64("c1"), "many")))
    return placed.withColumn("block", block).join(partner, "block").select("b1", "b2", "block", "cid", "c1", "n", "bands")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of the shingle sets."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = n_bands(percent, miss)
    bands += -bands % (BATCH // ROWS)  # whole batches
    keys = written(text_map(docs, *_keys(words, bands)), "near-keys")
    real = keys.where("doc_id is not null and n_shingles > 0")
    same = ["k1", "k2", "n_shingles"]
    classes = written(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    tables: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, f"near-{name}"))
        return tables[-1]

    members = step(_members(classes, tables), "members")
    able = step(classes.join(members.select("cid").distinct(), "cid", "left_semi").withColumnRenamed("n_shingles", "n"), "able")
    of = lambda end: able.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("bands").alias(f"bands_{end}"))
    edges = members.select(F.col("hub").alias("u"), F.col("cid").alias("v")).union(members.select("top", "hub")).where("u <> v").distinct()
    pruned = step(edges.join(of("v"), "v").join(of("u"), "u").select("u", "v", "n_u", "n_v", "bands_u", "bands_v").mapInArrow(*_prune(percent, miss)), "pruned")

    # every class beside its most similar hub
    best = pruned.groupBy("v").agg(F.max_by("u", F.struct("alike", -F.col("u"))).alias("u"))
    groups = best.select(F.col("u").alias("grp"), F.col("v").alias("cid")).union(best.select("u", "u")).groupBy("cid").agg(F.collect_set("grp").alias("groups"))
    sets = _with_sets(docs, able.drop("bands").join(groups, "cid"), words)
    ordered = sets.repartition("grp").sortWithinPartitions("grp", F.col("cid") != F.col("grp"))
    links = step(text_map(ordered, *_hub_links(percent)), "links")
    found = components(links, "near-joined")
    tables.append(found)

    component = able.select("cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("c1"))
    component = step(component, "component")
    links = links.union(_links_between(docs, able, members, pruned, component, words, percent, miss, step))

    own = real.select("doc_id", *same).join(classes.select(*same, "cid"), same).select("doc_id", "cid")
    shared = own.groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("v")).where("u <> v")
    shared = own.join(shared.select("doc_id", "u"), "doc_id").select("u", F.col("cid").alias("v"))
    final = components(links.union(shared), "near-linked")
    tables += [final, classes, keys]

    placed = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select(*same, "rep", F.coalesce("component", "cid").alias("c"))
    placed = step(placed, "placed")
    labels = placed.groupBy("c").agg(F.min("rep").alias("label"), F.count("*").alias("n"))
    labels = join_sizes(placed.drop("rep"), labels, "c", *sizes_of(labels)).select(*same, "label")
    component_id = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    out = keys.drop("bands").join(labels, same, "left").select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))
    out = written(out, "near-result")
    for t in tables:
        dropped(t)
    return out


def _links_between(docs: DataFrame, able: DataFrame, members: DataFrame, pruned: DataFrame, component: DataFrame, words: int, percent: int, miss: float, step) -> DataFrame:
    """Links between components (cid, c1) that lie in one group: the classes of all buckets that have the same least class."""
    rows = members.select(F.col("top").alias("grp"), "cid").distinct().join(component, "cid")
    opened = rows.groupBy("grp").agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.count("*").alias("n")).where("low < high")
    # hub and member alone are settled if their pair was pruned
    alive = pruned.select(F.col("u").alias("grp"), F.lit(True).alias("alive")).distinct()
    opened = step(opened.join(alive, "grp", "left").where("n > 2 or alive").select("grp", "n"), "open")
    total, most = sizes_of(opened)
    if not total:
        return step(component.sparkSession.createDataFrame([], "u bigint, v bigint"), "no-links")
    rows = join_sizes(rows, opened, "grp", total, most).drop("n")
    grouped = step(rows.join(able.select("cid", "n", "bands"), "cid"), "grouped")
    dealt = step(_blocks(grouped), "blocks")
    order = ["b1", "b2", "block", "cid"]
    alive = step(dealt.repartition("b1", "b2").sortWithinPartitions(*order).mapInArrow(*_survivors_of_blocks(percent, miss)), "alive")
    need = able.drop("bands").join(alive.select("cid").distinct(), "cid", "left_semi").withColumn("groups", F.array("cid"))
    sets = _with_sets(docs, need, words).select("cid", "shingles")
    survivors_ = dealt.join(alive, ["b1", "b2", "cid"], "left_semi").join(sets, "cid").select(*order, "c1", "n", "bands", "shingles")
    return step(text_map(survivors_.repartition("b1", "b2").sortWithinPartitions(*order), *_links_of_blocks(percent, miss)), "more-links")
