"""MinHash near-duplicate groups with sequential Bayesian verification (op 10).

Words are runs of anything but ASCII white space, with A-Z lower-cased; a row's set holds its distinct
shingles of ``width`` words (fewer words: the whole sequence as one; none, or a null text: empty, linked with
nothing). Two rows link if their sets' Jaccard similarity is at least ``percent``/100.

1. One map over the texts gives each row its set's size, a hash of the set and a signature of 128 minima.
   Rows with equal sets form one node; from here on a group of copies is one row.
2. Nodes that agree in one of 32 bands of 4 minima are candidates. Within a band's group, signatures are
   compared in batches of 16 minima; after each a pair is dropped if, given its matches so far and a uniform
   prior, the probability of similarity >= the threshold is below ``MISS``. Pairs are never emitted: each group
   returns its survivors' connected classes as a star.
3. The stars' components are clusters. Every cluster gets its nodes' texts once, prunes again and verifies the
   survivors on the full shingle sets, by hash and then by their words, skipping pairs that verified links connect already.

Groups and clusters of more than ``BLOCK`` nodes are cut into blocks by hash and every pair of blocks is a task of its
own, so no task holds more than two blocks. A pair at the threshold is missed by all bands with probability
(1 - 0.8**4)**32 = 5e-8, and by the pruning with at most about ``MISS`` for each of eight looks.

Rows with a null id belong to their group but never name it; if all ids of a group are null, so is its
component. Rows that repeat an id keep their own texts. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

PERCENT, MISS = 80, 1e-6
HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS
BLOCK = 2048

_rng = np.random.Generator(np.random.PCG64(7919))
_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_A = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_factors = {"all": np.zeros(0, np.uint64)}


def _grow(n: int) -> np.ndarray:
    """A random factor for each place in a word; powers of one number would let words like Thue and Morse's collide."""
    if len(_factors["all"]) < n:
        _factors["all"] = np.random.Generator(np.random.PCG64(104729)).integers(0, 2**64, 1 << max(12, (n - 1).bit_length()), dtype=np.uint64)
    return _factors["all"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' distinct shingles, row by row and sorted, and the n + 1 bounds of the rows."""
    raw = [(t or "").encode().lower() + b" " for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    space = _SPACE[data]
    inside = np.diff(np.concatenate(([0], (~space).astype(np.int8))))  # every row ends in a space
    start, stop = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    size = stop - start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inner = np.flatnonzero(~space)
    first = np.cumsum(size) - size
    place = np.arange(len(inner)) - np.repeat(first, size)
    word = _mix(np.add.reduceat(_CODE[data[inner]] * _grow(int(size.max()))[place], first))
    row = np.searchsorted(ends, start, side="right")
    m = len(word)
    hashes, rows = [], []
    if m >= width:
        full = np.flatnonzero(row[: m - width + 1] == row[width - 1 :])
        h = np.zeros(len(full), np.uint64)
        for k in range(width):
            h += word[full + k] * _PLACE[k]
        hashes.append(_mix(h))
        rows.append(row[full])
    counts = np.bincount(row, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        w = word[first[i] : first[i] + counts[i]]
        hashes.append(_mix((w * _PLACE[32 : 32 + len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))))
        rows.append(np.array([i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(texts) + 1))


def shingle_words(text: str | None, width: int) -> set[bytes]:
    """The set itself: distinct shingles as their words with a space between."""
    words = _SPLIT.findall((text or "").encode().lower())
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of minima for each set that is not empty."""
    start = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.empty((len(start), HASHES), np.uint32)
    if len(start):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = _mix(h ^ (x[:, :, k] + _PLACE[40 + k]))
    return h.astype(np.int64)


def least_matches(percent: int, miss: float) -> list[int]:
    """After n = 16, 32, .. minima, the fewest matches m for which P(J >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        p, tail, m = (1 - t) ** (n + 1), 0.0, 0
        while True:
            tail += p
            if tail >= miss:
                break
            p *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        out.append(m)
    return out


def _pairs(block: np.ndarray, g: int):
    """Index pairs, some at a time: all of one block, or those between two."""
    one = block.min() == block.max()
    left = np.arange(g) if one else np.flatnonzero(block == block.min())
    right = left if one else np.flatnonzero(block != block.min())
    rows = max(1, 100_000 // max(1, len(right)))
    for k in range(0, len(left), rows):
        a = np.repeat(left[k : k + rows], len(right))
        b = np.tile(right, len(left[k : k + rows]))
        if one:
            a, b = a[a < b], b[a < b]
        if len(a):
            yield a, b


def survivors(sig: np.ndarray, block: np.ndarray, least: list[int]):
    """Pairs that no look at the signatures prunes, and their matches."""
    for a, b in _pairs(block, len(sig)):
        m = np.zeros(len(a), np.int32)
        for k, need in enumerate(least):
            cols = slice(k * STEP, (k + 1) * STEP)
            m += (sig[a, cols] == sig[b, cols]).sum(axis=1, dtype=np.int32)
            ok = m >= need
            a, b, m = a[ok], b[ok], m[ok]
            if not len(a):
                break
        if len(a):
            yield a, b, m


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches, keys: list[str]):
    """Tables of the rows with equal keys, from sorted record batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        cut[0] = tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        edges = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        if edges[0] > 0:
            held.append(batch.slice(0, edges[0]))
        for lo, hi in zip(edges, edges[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(lo, hi - lo)]
    if held:
        yield pa.Table.from_batches(held)


def _sig_matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)


def in_blocks(df: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Rows with ``lo, hi, block``: once for each pair of blocks that theirs is part of."""
    many = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64(node), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", size)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT, miss: float = MISS, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: its id, ``text_hash`` (xxhash64, null as empty), ``n_shingles, component_id, kept``.

    ``group`` names the component even where all its ids are null; it is null for empty sets.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    least = least_matches(percent, miss)
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h, bounds = shingle_sets(part.column("text").to_pylist(), width)
                n = np.diff(bounds)
                some = n > 0
                key = np.zeros(len(n), np.int64)
                if some.any():
                    key[some] = _mix(np.add.reduceat(_mix(h + _PLACE[60]), bounds[:-1][some]) ^ n[some].astype(np.uint64)).astype(np.int64)
                sig = signatures(h, bounds)
                blobs, bands = iter([s.tobytes() for s in sig]), iter(_bands(sig).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, mask=~some), pa.array([next(blobs) if s else None for s in some], pa.binary()), pa.array([next(bands) if s else None for s in some], pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n", "node", "sig", "bands"],
                )

    id_type = df.schema[id_col].dataType.simpleString()
    signed = scratch.cut(docs.mapInArrow(sign, f"id {id_type}, text_hash long, n long, node long, sig binary, bands array<long>"), "signed")

    # one row for each distinct set; the text is found again by its hash
    some = signed.where("node is not null")
    chosen = some.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    banded = some.select("node", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.cut(banded.join(shared, "band"), "members")
    sigs = scratch.cut(some.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig")).join(chosen, "node"), "sigs")
    grouped = in_blocks(members, "band", "size", "node").join(sigs.select("node", "sig"), "node")

    def prune(batches):
        for t in _runs(batches, ["band", "lo", "hi"]):
            sig, block, node = _sig_matrix(t), t.column("block").to_numpy(), t.column("node").to_numpy()
            found = [(a, b) for a, b, _ in survivors(sig, block, least)]
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            label = _classes(len(sig), a, b)
            other = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], names=["a", "b"])

    by = ["band", "lo", "hi"]
    stars = grouped.repartition(*by).sortWithinPartitions(*by).mapInArrow(prune, "a long, b long")
    clusters = connected_components(stars, scratch)
    sized = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("size")), "component")
    sized = scratch.cut(sized.join(sigs, "node"), "clusters")
    # a merge join at every size: neither side has a bound that would allow a broadcast
    texts = docs.select("text_hash", "text").join(sized.select("text_hash").hint("merge"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    loaded = in_blocks(sized, "component", "size", "node").join(texts, "text_hash")

    def verify(batches):
        for t in _runs(batches, ["component", "lo", "hi"]):
            sig, block, node = _sig_matrix(t), t.column("block").to_numpy(), t.column("node").to_numpy()
            found = list(survivors(sig, block, least))
            if not found:
                continue
            a, b, m = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(-m, kind="stable")
            texts = t.column("text").to_pylist()
            h, bounds = shingle_sets(texts, width)
            sets = [h[x:y] for x, y in zip(bounds, bounds[1:])]
            parent = list(range(len(node)))

            def linked(i, j):
                """On the words themselves; the hashes have only spared most of the pairs this."""
                x, y = shingle_words(texts[i], width), shingle_words(texts[j], width)
                both = len(x & y)
                return 100 * both >= percent * (len(x) + len(y) - both)

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(a[order].tolist(), b[order].tolist()):
                x, y = root(i), root(j)
                if x == y:
                    continue
                n = len(sets[i]) + len(sets[j])
                if 100 * min(len(sets[i]), len(sets[j])) < percent * max(len(sets[i]), len(sets[j])):
                    continue
                both = np.sort(np.concatenate((sets[i], sets[j])), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (n - inter) and linked(i, j):
                    parent[max(x, y)] = min(x, y)
            label = np.array([root(i) for i in range(len(node))])
            other = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], names=["a", "b"])

    by = ["component", "lo", "hi"]
    links = loaded.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify, "a long, b long")
    parts = connected_components(links, scratch)
    groups = some.groupBy("node").agg(F.min("id").alias("least")).join(parts, "node", "left")
    groups = groups.select("node", "least", F.coalesce("component", "node").alias("component"))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.cut(groups.join(names, "component").select("node", "component", "component_id"), "named")
    out = signed.join(named, "node", "left").select("id", "text_hash", "n", "component", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), "component_id", "kept", F.col("component").alias("group"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without near-duplicates: each group keeps its smallest id (null last; then by text hash)."""
    found = near_duplicates(df, id_col, text, width, percent)
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_hash"))
    best = found.where("group is not null").groupBy("group").agg(F.min(key).alias("k")).select("k.id", "k.text_hash")
    times = found.where("group is not null").groupBy(F.col(id_col).alias("id"), "text_hash").agg(F.count("*").alias("times"))
    empty = found.where("group is null").select(F.col(id_col).alias("id"), "text_hash").distinct().withColumn("times", F.lit(1))
    chosen = best.join(times, best["id"].eqNullSafe(times["id"]) & (best["text_hash"] == times["text_hash"])).select(best["id"], best["text_hash"], "times").union(empty)
    chosen = chosen.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "times")
    rows = df.withColumn("__hash0", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(chosen, (F.col("__hash0") == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id")))
    once = rows.where("times = 1").select(*df.columns)
    return once.union(rows.where("times > 1").dropDuplicates(["__id", "__hash"]).select(*df.columns))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("text_hash", "group")
