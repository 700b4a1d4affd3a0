"""Packing token sequences by non-negative least squares (op 7).

1. A map over the texts gives each document's token ids with an end id, cut into full windows of ``WINDOW`` ids and a rest.
   Full windows are sequences of their own.
2. The rests' lengths, rounded up to units of 16, make a histogram of 256 bins. All combinations of one to three parts, and of one length
   several times with at most one other, that fill a window exactly are columns of a non-negative least squares problem, solved
   (Lawson-Hanson) for how often each is used; the counts are rounded, kept within the histogram, and what they leave over is solved
   for again while that helps. Pieces take the places of their bins by rank.
3. Pieces that the rounding or the shape of the histogram leaves over are packed greedily, best fit decreasing, in blocks.

The plan has a few hundred entries whatever the input's size. Ranks need no window over a whole bin: bins are salted, and a
salt's first rank follows from the counts of (bin, salt). Nothing is sampled; every id lies in one piece.

Tokens come from a public tokenizer file. Words are looked up in a cache of pieces already encoded; the library encodes
what is not there, and whole texts wherever a character is beyond Latin, where its normalisation is more than lower case.
Null texts are empty and yield the end id alone. Equal rows are packed as often as they occur.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, held, table

WINDOW, UNIT, DEPTH, END = 4096, 16, 3, 2
BLOCK, PER_SALT, CACHE = 20_000, 500_000, 800_000


class Words:
    """Exact token ids of texts for a lower-casing word BPE, by words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        known = [chr(c) for c in range(0xA1, 0x250)]
        letters = "".join(c for c in known if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in known if unicodedata.category(c)[0] == "N")
        # the characters for which lower-casing is all that the file's normaliser does
        self.plain = re.compile("[\t\n\r -~¡-ɏ]*")
        # the letters first, as most tries are for them; white space that is not plain is found too, so that it is noticed
        self.words = re.compile(f"[a-zA-Z{letters}]+|'(?:[stmd]|re|ve|ll)|[0-9{numbers}]|[^\\sa-zA-Z0-9{letters}{numbers}]+|[^\\S\t\n\r ]")
        self.known = _Known(self.tok, self.plain)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian 32-bit integers; names of special tokens in a text have their ids, as in the library."""
        out = []
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known.__getitem__
        for t in texts:
            t = t or ""
            ids = None
            if "<|" not in t and (t.isascii() or int(np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").max()) < 0x250):
                try:
                    ids = b"".join(map(known, self.words.findall(t.lower())))
                except TypeError:  # a word with characters that are not plain
                    pass
            out.append(array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes() if ids is None else ids)
        return out


class _Known(dict):
    """Ids of words, encoded when first asked for; None for words that only the library can judge within their text."""

    def __init__(self, tok, plain: re.Pattern):
        self.one, self.plain = tok.encode_batch_fast, plain

    def __missing__(self, word: str) -> bytes | None:
        self[word] = ids = array("I", self.one([word], add_special_tokens=False)[0].ids).tobytes() if self.plain.fullmatch(word) else None
        return ids


@lru_cache(1)
def _words(path: str) -> Words:
    """A worker's own, kept from task to task."""
    return Words(path)


held(_words.cache_clear)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing lengths with sum ``units``: at most ``depth`` parts, or one length several times and at most one shorter or longer part."""
    out = [tuple(sorted([p] * n + ([units - n * p] if units > n * p else []), reverse=True)) for p in range(1, units // depth + 1) for n in range(depth, units // p + 1)]

    def extend(parts: tuple, rest: int):
        if not rest:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(min(rest, parts[-1] if parts else units), 0, -1):
                extend((*parts, p), rest - p)

    extend((), units)
    return list(dict.fromkeys(out))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson-Hanson: x >= 0 with least ||a x - b||, or near it: after 3 steps a row it stops, and the plan made of x is only less full."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * m):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            x[at[low & (x[at] <= 1e-12)]] = 0
            x[k] = max(x[k], 0)
            passive &= x > 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray, units: int = WINDOW // UNIT, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in units, repeats) that the histogram (index 1 .. units) can serve."""
    combos, out = combinations(units, depth), {}
    left = histogram.astype(np.int64).copy()
    while left.sum():
        # rounding leaves a part over, which is solved for again as long as that places a twentieth of it
        live = [c for c in combos if all(left[p] for p in c)]
        if not live:
            break
        a = np.zeros((units + 1, len(live)))
        for k, c in enumerate(live):
            for p in c:
                a[p, k] += 1
        x, before = nnls(a, left.astype(float)), int(left.sum())
        for k in np.argsort(-x):
            need = {p: live[k].count(p) for p in set(live[k])}
            n = min(int(x[k] + 0.5), *(int(left[p]) // c for p, c in need.items()))
            if n > 0:
                out[live[k]] = out.get(live[k], 0) + n
                for p, c in need.items():
                    left[p] -= n * c
        if 20 * (before - int(left.sum())) < before:
            break
    return list(out.items())


def _greedy(rows: pa.Table, first: int) -> pa.Table:
    """Best fit decreasing: sequence and offset of each piece of a block."""
    from bisect import bisect_left, insort

    length = rows.column("length").to_pylist()
    order = sorted(range(len(length)), key=lambda i: -length[i])
    open_, made, seq, at = [], 0, [0] * len(length), [0] * len(length)
    for i in order:
        k = bisect_left(open_, (length[i], -1))
        if k < len(open_):
            room, s = open_.pop(k)
        else:
            room, s = WINDOW, made
            made += 1
        seq[i], at[i] = first + s, WINDOW - room
        if room > length[i]:
            insort(open_, (room - length[i], s))
    return rows.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(at, pa.int64()))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece: its place in its document and in its sequence; with ``keep_ids`` its ids too."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        give_back(but=_words.cache_clear)
        words = _words(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, start, length, crc, total, blobs = [], [], [], [], [], []
                for i, ids in enumerate(words.encode(part.column(1).to_pylist())):
                    ids += end
                    for at in range(0, len(ids), 4 * WINDOW):
                        piece = ids[at : at + 4 * WINDOW]
                        row.append(i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                        blobs.append(piece)
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if keep_ids:
                    columns.append(pa.array(blobs, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    unit = F.ceil(F.col("length") / UNIT).cast("int")
    pieces = scratch.cut(df.select(id_col, text).mapInArrow(cut, schema).withColumn("bin", F.when(F.col("length") == WINDOW, WINDOW // UNIT + 1).otherwise(unit)), "pieces")
    salts = max(16, -(-pieces.count() // PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = np.zeros((WINDOW // UNIT + 2, salts), np.int64)
    for b, s, n in salted.groupBy("bin", "salt").agg(F.count("*")).collect():  # bins x salts rows
        counts[b, s] = n
    first = np.cumsum(counts, axis=1) - counts
    strategies = plan(counts[:-1].sum(axis=1))
    # places[bin]: the ranks from `lo` on fill part `slot` of the sequences from `base` on
    places: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = int(counts[-1].sum())
    for lengths, n in strategies:
        for slot, p in enumerate(lengths):
            places.setdefault(p, []).append((taken.get(p, 0), base, slot))
            taken[p] = taken.get(p, 0) + n
        base += n
    tables = {p: np.array(v, np.int64) for p, v in places.items()}

    def place(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            bins, salt = t.column("bin").to_numpy(), t.column("salt").to_numpy()
            rank = first[bins, salt] + t.column("rank").to_numpy() - 1
            seq, slot, left = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.ones(len(rank), bool)
            full = bins == WINDOW // UNIT + 1
            seq[full], left[full] = rank[full], False
            for p in np.unique(bins[~full]):
                at = np.flatnonzero((bins == p) & (rank < taken.get(int(p), 0)))
                if len(at):
                    own = tables[int(p)]
                    k = np.searchsorted(own[:, 0], rank[at], side="right") - 1
                    seq[at], slot[at], left[at] = own[k, 1] + rank[at] - own[k, 0], own[k, 2], False
            t = t.drop_columns(["bin", "salt", "rank"]).append_column("sequence_id", pa.array(seq, mask=left)).append_column("slot", pa.array(slot))
            yield from t.combine_chunks().to_batches()

    order = Window.partitionBy("bin", "salt").orderBy(id_col, "start", "ids_crc32", "length", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long"))
    placed = scratch.cut(ranked.mapInArrow(place, schema + ", sequence_id long, slot long"), "placed")
    scratch.drop(pieces)
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    planned = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")
    rest = placed.where("sequence_id is null").drop("sequence_id", "slot")
    blocks = max(1, -(-rest.count() // BLOCK))
    rest = rest.withColumn("block", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(blocks)).cast("int"))

    def greedy(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in (id_col, "start", "ids_crc32")])
        return _greedy(rows.drop_columns(["block"]), base + (rows.column("block")[0].as_py() << 32))

    return planned.union(rest.groupBy("block").applyInArrow(greedy, schema + ", sequence_id long, offset long"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
