"""Byte-level BPE encoding and decoding (op 9).

A word's fold starts from its bytes and merges, at each step, the leftmost adjacent pair whose concatenation has the lowest
rank, until no pair has one. It runs over distinct words; decoding concatenates the pieces of the ids. There are two forms:

* ``encode_native`` keeps to Spark's higher-order functions. The rank file becomes literals of the plan: a map from piece to rank, as an
  array of small maps addressed by hash because a single Spark map is searched from end to end, and the array of pieces by rank.
  Distinct words of a bounded sample (``SAMPLE`` texts by hash order, the ``CACHED`` most frequent words) are folded once and become
  a third literal; a text looks its words up there and folds those that are missing. Which words the sample has changes speed
  alone. Texts with a run of ``LONG`` or more characters without a break, or with characters that Java's older Unicode tables leave
  unassigned, go to the tiktoken library.
* ``encode`` and ``decode`` are the same fold in Arrow batches, each worker keeping the words that it has folded. The query uses
  it because the native form takes several times the limit, by estimate (README).

Both are maps over the texts, without a shuffle. Null texts are empty.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLE, CACHED, LONG = 3000, 131_072, 96
SEED = 42  # of Spark's xxhash64
KEEP = 1_000_000  # words that a worker remembers


def load_ranks(path: str) -> list[bytes]:
    """Pieces by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(b) for _, b in pairs))
    for a, b in pairs:
        out[int(b)] = base64.b64decode(a)
    return out


def _buckets(entries: dict, many: int) -> list[dict]:
    import xxhash

    out: list[dict] = [{} for _ in range(many)]
    for k, v in entries.items():
        out[xxhash.xxh64_intdigest(k.encode(), SEED) & (many - 1)][k] = v
    return out


class Literals:
    """Expressions over a rank map and, once there are some, encoded words."""

    def __init__(self, pieces: list[bytes]):
        ranks = {p.hex().upper(): r for r, p in enumerate(pieces) if p}
        self.ranks = self._map(ranks, 1 << 16, "int")
        self.pieces = F.split(F.lit(",".join(p.hex().upper() for p in pieces)), ",")
        self.ids = F.split(F.lit(",".join(r.to_bytes(4, "little").hex() for r in range(len(pieces)))), ",")
        self.words = None

    @staticmethod
    def _map(entries: dict, many: int, kind: str):
        literal = F.from_json(F.lit(json.dumps(_buckets(entries, many), ensure_ascii=False)), f"array<map<string,{kind}>>")
        # many is a power of two, so the signed hash and the unsigned one have the same low bits
        return lambda key: F.try_element_at(F.element_at(literal, (F.xxhash64(key).bitwiseAND(F.lit(many - 1)) + 1).cast("int")), key)

    def remember(self, words: dict[str, list[int]]) -> None:
        self.words = self._map(words, 1 << max(4, (2 * len(words)).bit_length() - 1), "array<int>")

    def fold(self, word):
        """Ids of one word."""
        ranks = self.ranks
        let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
        code = F.hex(F.encode(word, "UTF-8"))
        size = (F.length(code) / 2).cast("int")
        start = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(code, i * 2 - 1, F.lit(2)))

        def merge(parts, _):
            def at(found):
                low = F.array_min(found)
                k = F.array_position(found, low).cast("int")
                joined = lambda k: F.concat(F.slice(parts, F.lit(1), k - 1), F.array(F.concat(F.element_at(parts, k), F.element_at(parts, k + 1))), F.slice(parts, k + 2, F.size(parts)))
                return F.when(low.isNull(), parts).otherwise(let(k, joined))

            n = F.size(parts)
            pairs = F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n - 1), lambda a, b: ranks(F.concat(a, b)))
            return F.when(n < 2, parts).otherwise(let(pairs, at))

        merged = F.when(size < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), size), start, merge))
        return F.when(ranks(code).isNotNull() & (size < 2), F.array(ranks(code))).otherwise(F.transform(merged, ranks))

    def encode(self, words):
        """Ids of an array of words, end to end."""
        one = self.fold if self.words is None else lambda w: F.coalesce(self.words(w), self.fold(w))
        return F.flatten(F.transform(words, one))

    def blob(self, ids):
        """Ids as little-endian 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(self.ids, i + 1)), ""))

    def decode(self, ids):
        """The bytes of the ids' pieces, end to end."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(self.pieces, i + 1)), ""))


def encode_native(df: DataFrame, path: str, pattern: str, text: str = "text", sample: int = SAMPLE, cached: int = CACHED) -> tuple[DataFrame, Literals]:
    """``df`` with an array column ``ids``; null texts have none. ``path``: a tiktoken rank file."""
    literals = Literals(load_ranks(path))
    value = F.coalesce(F.col(text), F.lit(""))
    # in Java, \\s is wider than ASCII only with this flag
    words = F.regexp_extract_all(F.col("__text"), F.lit("(?U)" + pattern), F.lit(0))
    hard = F.col("__text").rlike(rf"(?U)\S{{{LONG}}}|\s{{{LONG}}}|\p{{Cn}}")
    chosen = df.select(value.alias("__text")).where(~hard).orderBy(F.xxhash64("__text")).limit(sample)
    common = chosen.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(cached)
    known = common.select("word", literals.fold(F.col("word")).alias("ids")).collect()  # at most ``cached`` words
    literals.remember({r.word: r.ids for r in known})

    @F.pandas_udf("array<int>")
    def outside(texts):
        import pandas as pd
        import tiktoken

        ranks = {p: r for r, p in enumerate(load_ranks(path)) if p}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if texts.notna().any() else None
        return pd.Series([None if t is None else enc.encode_ordinary(t) for t in texts])

    ids = F.when(F.col("__hard").isNull(), literals.encode(words)).otherwise(F.col("__outside"))
    out = df.select(*[c for c in df.columns if c != "ids"], value.alias("__text"))
    out = out.withColumn("__hard", F.when(hard, F.col("__text"))).withColumn("__outside", outside("__hard"))
    return out.withColumn("ids", ids).drop("__text", "__hard", "__outside"), literals


class Folder:
    """Ranked merges over the bytes of distinct words."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import regex

        self.ranks = {p: r for r, p in enumerate(pieces) if p}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def fold(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 64:
            return self._fold_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        none = len(ranks) + 256
        found = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while found:
            low = min(found)
            if low == none:
                break
            k = found.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
            if k < len(found):
                found[k] = ranks.get(parts[k] + parts[k + 1], none)
        return [ranks[p] for p in parts]

    def _fold_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs: n log n."""
        ranks, n = self.ranks, len(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue  # one of the two has merged since
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get(word[a : end[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a, end[after[a]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        words, known = self.split(text or ""), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > KEEP:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = np.array(self.fold(w.encode()), "<u4").tobytes()
            return b"".join([known[w] for w in words])


def _mapped(df: DataFrame, source: str, target: str, make) -> DataFrame:
    """``df`` with a binary column that ``make()``, called once in a task, gives for each value of another."""
    columns = [c for c in df.columns if c != target]
    frame = df.select(*columns)
    out = frame.withColumn(target, F.lit(None).cast("binary")).schema

    def run(batches):
        f, at = make(), columns.index(source)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f(v) for v in part.column(at).to_pylist()], pa.binary())], names=out.names)

    return frame.mapInArrow(run, out)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", target: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as little-endian 32-bit integers. ``path``: a tiktoken rank file."""
    return _mapped(df, text, target, lambda: _folder(path, pattern).encode)


@lru_cache(1)
def _folder(path: str, pattern: str) -> Folder:
    """A worker's own, kept from task to task."""
    return Folder(load_ranks(path), pattern)


def decode(df: DataFrame, path: str, ids: str = "ids", target: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of each row stand for."""

    def make():
        pieces = load_ranks(path)
        return lambda blob: b"".join([pieces[i] for i in np.frombuffer(blob or b"", "<u4").tolist()])

    return _mapped(df, ids, target, make)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    tokens = (F.octet_length("ids") / 4).cast("long")
    return decode(df, path).select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
