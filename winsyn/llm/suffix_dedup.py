"""Removal of long repeats by a logarithmic family of suffix arrays (op 1).

A byte goes if it is covered by a string of ``length`` bytes that also starts at another place, in the same row or another.

The arrays are sparse: they hold the suffixes that start at anchors. With k = ``length`` - ``length`` // 2, an anchor is the start of a
k-byte string whose hash is the least of all that lie in some string of ``length`` bytes. That depends on nothing but those bytes, so two
equal strings have anchors at the same distance from their starts, about one for fifty bytes of text. A repeat is found where two
anchors' suffixes agree to the right and the bytes before them to the left, together for at least ``length`` bytes.

1. Rows are written once in batches, as a bucketed table, so that no later step shuffles a text.
2. A filter: each batch sends the hashes of its anchors' k bytes to shards of hash ranges and hears which of them start at several
   places. All other suffixes can match nothing. (Hashes decide here only what is looked at more closely.)
3. Each batch sorts its remaining suffixes, as the bytes that can matter: ``length`` to the right and, reversed, ``length`` - k
   to the left. Equal ones are sent once. They are dealt to shards by the hash of the first k bytes, so that a match lies in one shard. A shard is a
   family: a new batch's array is merge-scanned against the existing levels by common prefixes, becomes a level itself, and levels of
   like sizes are merged, so that there are logarithmically many. The scan compares bytes, never hashes.
4. Each batch hears how far the matches of each suffix reach, and cuts its rows.

For a pair of suffixes that agrees in R bytes to the right and L to the left, R + L >= ``length``, the bytes from L before to R behind the
anchor go. All such ranges of a suffix contain its anchor, so the greatest L and the greatest R describe their union.

Texts of any length are worked on in parts of ``CHUNK`` bytes, each with the bytes around it. Null texts count as empty; equal rows count as different
places; the order of rows never matters. A column of the input that is named like a result column is replaced by it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, table

LENGTH = 200
BATCH_BYTES = 4 << 20
FILTER_BYTES = 64 << 20  # of text for each shard of the filter
SHARD_BYTES = 8 << 20  # of suffixes for each shard of the family
CHUNK = 1 << 18
STEP = 1 << 14  # suffixes compared at a time
SENT_BYTES = 8 << 20  # of suffixes sent to a worker at a time
MAX_SHARDS = 100_000
_SENT = "spark.sql.execution.arrow.maxBytesPerBatch"

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = 1 << max(19, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, w: int, op: np.ufunc, rest: int) -> np.ndarray:
    """op over x[i : i + w] for every i, from running results to both sides within blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, rest, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


class Shape:
    """The layout of a suffix: ``length`` bytes to the right, their number, ``w`` - 1 bytes to the left reversed, their number."""

    def __init__(self, length: int):
        self.length = length
        self.k = length - length // 2
        self.w = length - self.k + 1
        self.before = self.w - 1
        self.width = length + 2 + self.before + 2
        self.kind = np.dtype(f"V{self.width}")

    def right(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length
        return m[:, :n], m[:, n].astype(np.int64) * 256 + m[:, n + 1]

    def left(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length + 2
        return m[:, n : n + self.before], m[:, -2].astype(np.int64) * 256 + m[:, -1]

    def bytes_of(self, suffixes: np.ndarray) -> np.ndarray:
        return suffixes.view(np.uint8).reshape(len(suffixes), self.width)


class Chunk:
    """Some texts end to end, or a part of a long one, with their anchors: places in ``data``, rows, and offsets in the rows' texts."""

    def __init__(self, shape: Shape, texts: list[tuple[int, bytes, int, int, int]]):
        """``texts``: (row, bytes, offset of the first byte in the text, first and last + 1 offset in the text whose anchors are to be found)."""
        length, k, w = shape.length, shape.k, shape.w
        self.shape = shape
        sizes = np.array([len(t[1]) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join([t[1] for t in texts]), np.uint8)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.at, self.row, self.offset, self.prints = none, none, none, np.zeros(0, np.uint64)
        if n < length:
            return
        ends = np.cumsum(sizes)
        up, down = _grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[self.data] * up[:n], out=sums[1:])
        inner = _mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
        least = _sliding(inner, w, np.minimum, 2**64 - 1)
        for end in ends[:-1].tolist():  # strings that would cross the end of a text
            least[max(0, end - length + 1) : end] = 0
        padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        at = np.flatnonzero(inner == _sliding(padded, w, np.maximum, 0))
        which = np.searchsorted(ends, at, side="right")
        starts = ends - sizes
        meta = np.array([(t[0], t[2], t[3], t[4]) for t in texts], np.int64)
        # a hash of 0 may mark a place that no valid string covers
        inside = at + k <= ends[which]
        offset = at - starts[which] + meta[which, 1]
        own = inside & (offset >= meta[which, 2]) & (offset < meta[which, 3])
        self.at, which = at[own], which[own]
        self.low, self.high = starts[which], ends[which]
        self.row, self.offset, self.prints = meta[which, 0], offset[own], inner[self.at]

    def suffixes(self, chosen: np.ndarray) -> np.ndarray:
        """The suffixes at the anchors of a mask, with the bytes before them."""
        s = self.shape
        at, low, high = self.at[chosen], self.low[chosen], self.high[chosen]
        out = np.zeros((len(at), s.width), np.uint8)
        if len(at):
            padded = np.zeros(len(self.data) + s.before + s.length, np.uint8)
            padded[s.before : s.before + len(self.data)] = self.data
            found = sliding_window_view(padded, s.before + s.length)[at]
            before, behind = np.minimum(at - low, s.before), np.minimum(high - at, s.length)
            short = np.flatnonzero(behind < s.length)
            found[short] *= np.arange(s.before + s.length)[None, :] < (s.before + behind[short])[:, None]
            short = np.flatnonzero(before < s.before)
            found[short] *= np.arange(s.before + s.length)[None, :] >= (s.before - before[short])[:, None]
            n = s.length + 2
            out[:, : s.length] = found[:, s.before :]
            out[:, n : n + s.before] = found[:, : s.before][:, ::-1]
            out[:, s.length], out[:, s.length + 1] = behind >> 8, behind & 255
            out[:, -2], out[:, -1] = before >> 8, before & 255
        return out


def chunks(shape: Shape, texts: list[bytes]):
    """The texts in chunks; long ones in parts that own ``CHUNK`` bytes each and carry the bytes around them."""
    held, size, pad = [], 0, shape.length
    for row, t in enumerate(texts):
        if len(t) > 2 * CHUNK:
            for at in range(0, len(t), CHUNK):
                first = max(0, at - pad)
                yield Chunk(shape, [(row, t[first : at + CHUNK + 2 * pad], first, at, at + CHUNK)])
            continue
        held.append((row, t, 0, 0, len(t)))
        size += len(t)
        if size >= CHUNK:
            yield Chunk(shape, held)
            held, size = [], 0
    if held:
        yield Chunk(shape, held)


class Rows:
    """Sorted suffixes that lie in one or two sorted arrays: places in the arrays end to end. They are read in steps and not copied."""

    def __init__(self, shape: Shape, parts: list[np.ndarray], at: np.ndarray):
        self.shape, self.parts, self.at = shape, parts, at

    def __len__(self) -> int:
        return len(self.at)

    @classmethod
    def of(cls, shape: Shape, a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> Rows:
        """Those that masks choose of two arrays without a suffix in common."""
        at = np.empty(int(some_a.sum()) + int(some_b.sum()), np.int64)
        for own, other, some, chosen, first in ((a, b, some_a, some_b, 0), (b, a, some_b, some_a, len(a))):
            smaller = np.concatenate(([0], np.cumsum(chosen)))  # chosen ones of the other array before each place
            places = np.flatnonzero(some)
            for k in range(0, len(places), STEP):
                step = places[k : k + STEP]
                at[np.arange(k, k + len(step)) + smaller[np.searchsorted(other, own[step])]] = step + first
        return cls(shape, [a, b], at)

    def only(self, chosen: np.ndarray) -> Rows:
        return Rows(self.shape, self.parts, self.at[chosen])

    def bytes_at(self, rows: slice | np.ndarray) -> np.ndarray:
        at, first = self.at[rows], 0
        out = np.empty(len(at), self.shape.kind)
        for part in self.parts:
            own = (at >= first) & (at < first + len(part))
            out[own] = part[at[own] - first]
            first += len(part)
        return self.shape.bytes_of(out)


def _common(rows: Rows, side, order: np.ndarray | None = None) -> np.ndarray:
    """How many first bytes each row, in an order, shares with the next one; in steps, so that no copy of all rows is held."""
    n = len(rows)
    out = np.zeros(max(0, n - 1), np.int32)
    for at in range(0, n - 1, STEP):
        part, size = side(rows.bytes_at(slice(at, at + STEP + 1) if order is None else order[at : at + STEP + 1]))
        differ = part[1:] != part[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), part.shape[1])
        out[at : at + STEP] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def extents(shape: Shape, suffixes: Rows) -> np.ndarray:
    """For each of the sorted, distinct suffixes how far its matches with the others reach: columns left and right, 0 if it has none.

    A pair matches if some string of ``length`` bytes that starts l bytes before both anchors, 0 <= l <= length - k, is equal. For each l, equal
    strings are classes of two orders: neighbours in suffix order that share length - l bytes, and neighbours in the order of the reversed
    bytes before that share l. The least and the greatest l of a suffix are looked for, from both sides; only those l are tried at which its
    neighbours in both orders share enough.
    """
    n, length, before = len(suffixes), shape.length, shape.before
    out = np.zeros((n, 2), np.uint16)
    if n < 2:
        return out
    lcp = _common(suffixes, shape.right)
    near = np.zeros(n, np.int32)
    near[1:] = lcp
    near[:-1] = np.maximum(near[:-1], lcp)
    some = near >= shape.k
    if not some.any():
        return out
    if not some.all():  # the others end runs of at least k common bytes, so that runs stay apart
        out[some] = extents(shape, suffixes.only(some))
        return out
    back = np.empty((n, before + 2), np.uint8)
    for at in range(0, n, STEP):
        back[at : at + STEP] = suffixes.bytes_at(slice(at, at + STEP))[:, length + 2 :]
    order = np.argsort(back.view(f"V{before + 2}").ravel(), kind="stable")
    del back
    lcs = _common(suffixes, shape.left, order)
    reach = np.zeros(n, np.int32)
    reach[1:] = lcs
    reach[:-1] = np.maximum(reach[:-1], lcs)
    far = np.empty(n, np.int32)
    far[order] = reach
    low, high = length - near, far
    step = np.zeros(n, np.int64)

    def repeated(l: int, open_: np.ndarray) -> np.ndarray:
        """Which of the open suffixes have, l bytes before, a string of ``length`` bytes that another has too."""
        step[0] = 0
        np.cumsum(lcp < length - l, out=step[1:])
        live = np.zeros(step[-1] + 1, bool)
        live[step[open_]] = True
        members = np.flatnonzero(live[step] & (low <= l) & (high >= l))
        other = np.empty(n, np.int64)
        other[order] = np.concatenate(([0], np.cumsum(lcs < l)))
        key = step[members] * n + other[members]
        by = np.argsort(key, kind="stable")
        same = np.diff(key[by]) == 0
        twice = np.zeros(n, bool)
        twice[members[by[1:][same]]] = True
        twice[members[by[:-1][same]]] = True
        return open_[twice[open_]]

    for column, ls in ((1, range(before + 1)), (0, range(before, -1, -1))):
        todo = (low <= high) if column else out[:, 1] > 0
        tried = np.zeros(before + 2, np.int64)
        np.add.at(tried, np.clip(low[todo], 0, before + 1), 1)
        np.subtract.at(tried, np.clip(high[todo] + 1, 0, before + 1), 1)
        tried = np.cumsum(tried)
        for l in ls:
            if not tried[l]:
                continue
            open_ = np.flatnonzero(todo & (low <= l) & (high >= l))
            if len(open_):
                found = repeated(l, open_)
                out[found, column] = length - l if column else l
                todo[found] = False
    return out


class Level:
    """A sorted array of distinct suffixes and their numbers."""

    def __init__(self, suffixes: np.ndarray, numbers: np.ndarray):
        self.suffixes, self.numbers = suffixes, numbers


class Family:
    """The logarithmic index family of one shard."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.levels: list[Level] = []
        self.reach = np.zeros((1024, 2), np.uint16)
        self.several = np.zeros(1024, bool)
        self.count = 0

    def _numbers(self, n: int) -> np.ndarray:
        while self.count + n > len(self.several):
            self.reach = np.concatenate((self.reach, np.zeros_like(self.reach)))
            self.several = np.concatenate((self.several, np.zeros_like(self.several)))
        self.count += n
        return np.arange(self.count - n, self.count)

    def add(self, suffixes: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Take a sorted array of distinct suffixes; their numbers, by which ``found`` knows them."""
        shape, n = self.shape, len(suffixes)
        numbers = np.full(n, -1)
        for level in self.levels:  # a suffix that is there already starts at several places
            at = np.minimum(np.searchsorted(level.suffixes, suffixes), len(level.suffixes) - 1)
            hit = level.suffixes[at] == suffixes
            numbers[hit] = level.numbers[at[hit]]
        several = several | (numbers >= 0)
        fresh = numbers < 0
        numbers[fresh] = self._numbers(int(fresh.sum()))
        self.several[numbers[several]] = True
        new = Level(suffixes[fresh], numbers[fresh])  # copies, as a level's memory is its own
        if not len(new.suffixes):
            return numbers
        self._learn(new.numbers, extents(shape, Rows(shape, [new.suffixes], np.arange(len(new.suffixes)))))
        for level in self.levels:
            self._scan(level, new)
        while self.levels and len(self.levels[-1].suffixes) <= 2 * len(new.suffixes):
            new = self._merge(self.levels.pop(), new)
        self.levels.append(new)
        return numbers

    def _learn(self, numbers: np.ndarray, reach: np.ndarray) -> None:
        self.reach[numbers] = np.maximum(self.reach[numbers], reach)

    def _scan(self, old: Level, new: Level) -> None:
        """Matches between two levels, in the stretches of both that begin with the same k bytes."""
        shape = self.shape
        begin, end = np.empty(len(new.suffixes), np.int64), np.empty(len(new.suffixes), np.int64)
        for at in range(0, len(begin), STEP):
            probe = shape.bytes_of(new.suffixes[at : at + STEP]).copy()
            for out, fill, side in ((begin, 0, "left"), (end, 255, "right")):
                probe[:, shape.k :] = fill
                out[at : at + STEP] = np.searchsorted(old.suffixes, probe.view(shape.kind).ravel(), side=side)
        some = end > begin
        if not some.any():
            return
        marks = np.zeros(len(old.suffixes) + 1, np.int64)
        np.add.at(marks, begin[some], 1)
        np.subtract.at(marks, end[some], 1)
        part = np.cumsum(marks[:-1]) > 0
        both = Rows.of(shape, old.suffixes, new.suffixes, part, some)
        numbers = np.empty(len(both), np.int64)
        of_new = both.at >= len(old.suffixes)
        numbers[~of_new], numbers[of_new] = old.numbers[both.at[~of_new]], new.numbers[both.at[of_new] - len(old.suffixes)]
        self._learn(numbers, extents(shape, both))

    @staticmethod
    def _merge(a: Level, b: Level) -> Level:
        """The suffixes of both, in the memory of ``a``: it grows, and its own go to their places from the last to the first."""
        n, size = len(a.suffixes), len(a.suffixes) + len(b.suffixes)
        before = np.arange(n) + np.searchsorted(b.suffixes, a.suffixes, side="left")
        behind = np.arange(size - n) + np.searchsorted(a.suffixes, b.suffixes, side="right")
        for own, other in ((a.suffixes, b.suffixes), (a.numbers, b.numbers)):
            own.resize(size, refcheck=False)
            for at in range((n - 1) // STEP * STEP, -1, -STEP):
                own[before[at : at + STEP]] = own[at : min(n, at + STEP)].copy()
            own[behind] = other
        return a

    def sizes(self, suffixes: np.ndarray) -> np.ndarray:
        """How many bytes each has before and behind its anchor."""
        m = self.shape.bytes_of(suffixes)
        return np.stack((self.shape.left(m)[1], self.shape.right(m)[1])).astype(np.uint16)

    def found(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The reach of a run's suffixes by now; one that stands at several places matches as far as its text goes."""
        shape = self.shape
        before, behind = sizes
        out = self.reach[numbers].copy()
        whole = self.several[numbers] & (behind + before >= shape.length)
        # behind counts up to length and is at least k, so some string of the length reaches both ends
        out[whole, 0], out[whole, 1] = before[whole], behind[whole]
        return out


def _split(prints: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: equal ranges of the 64 bits."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.searchsorted(edges, prints, side="right")


def _member(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys


class Batch:
    """The rows of one batch, in an order that depends on nothing but them."""

    def __init__(self, rows: pa.Table, text: str, shape: Shape, number: str):
        give_back()  # what the last batch has left with the worker
        self.rows = rows.sort_by(number)
        self.texts = [t or b"" for t in self.rows.column(text).cast(pa.binary()).to_pylist()]
        self.shape = shape

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of anchors, and whether one stands at several places here."""
        found = [np.zeros(0, np.uint64), *[c.prints for c in chunks(self.shape, self.texts)]]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        return keys, counts > 1

    def array(self, active: np.ndarray, shards: int):
        """The sorted array of the suffixes whose hash is active, for each shard in turn: suffixes, shards, numbers of equal ones, and
        of all anchors with an active hash the row, the offset and the place of the suffix in the array."""
        shape = self.shape
        kind = np.dtype(f"V{4 + shape.width}")
        found, rows, offsets = [np.zeros((0, 4 + shape.width), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in chunks(shape, self.texts):
            chosen = _member(active, c.prints)
            if chosen.any():
                shard = _split(c.prints[chosen], shards).astype(">u4").view(np.uint8).reshape(-1, 4)
                found.append(np.concatenate((shard, c.suffixes(chosen)), axis=1))
                rows.append(c.row[chosen])
                offsets.append(c.offset[chosen])
        whole = np.ascontiguousarray(np.concatenate(found)).view(kind).ravel()
        del found
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        new = np.ones(len(whole), bool)
        new[1:] = whole[1:] != whole[:-1]
        place = np.empty(len(whole), np.int64)
        place[order] = np.cumsum(new) - 1
        kept = whole[new].view(np.uint8).reshape(-1, 4 + shape.width)
        shard = np.ascontiguousarray(kept[:, :4]).view(">u4").ravel().astype(np.int64)
        suffixes = np.ascontiguousarray(kept[:, 4:]).view(shape.kind).ravel()
        return suffixes, shard, np.bincount(place, minlength=len(suffixes)), np.concatenate(rows), np.concatenate(offsets), place


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


_ASK = "shard int, batch int, keys binary, several binary"
_ANSWER = "batch int, round int, shard int, payload binary, several long"


def _filter(rows: pa.Table) -> pa.Table:
    """One shard of hashes: tell each batch which of its own start at several places."""
    rows = rows.sort_by("batch")
    arrays = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
    flags = [_unbits(s, len(a)) for s, a in zip(rows.column("several").to_pylist(), arrays)]
    keys, at, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    several = counts > 1
    several[at[np.concatenate(flags)]] = True
    parts = np.split(several[at], np.cumsum([len(a) for a in arrays])[:-1])
    return pa.table(
        {
            "batch": rows.column("batch").cast(pa.int32()),
            "round": pa.array([1] * len(rows), pa.int32()),
            "shard": rows.column("shard").cast(pa.int32()),
            "payload": pa.array([_bits(p) for p in parts], pa.binary()),
            "several": pa.array([int(p.sum()) for p in parts], pa.int64()),
        }
    )


def _scan(shape: Shape):
    """One shard of suffixes: feed each batch's array to the shard's family, then tell all how far matches reach.

    The arrays are taken as they come, as their order decides nothing, and only the family keeps them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        family, runs, batches, shard = Family(shape), [], [], 0
        for rows in parts:
            shard = rows.column("shard")[0].as_py()
            batches += rows.column("batch").to_pylist()
            for key, flags in zip(rows.column("keys"), rows.column("several")):
                suffixes = np.frombuffer(key.as_buffer(), shape.kind)
                numbers = family.add(suffixes, _unbits(flags.as_py(), len(suffixes)))
                runs.append((numbers.astype(np.uint32), family.sizes(suffixes)))
            del rows, key, flags, suffixes
        reach = [family.found(*r) for r in runs]
        n = len(batches)
        yield pa.record_batch(
            {
                "batch": pa.array(batches, pa.int32()),
                "round": pa.array([2] * n, pa.int32()),
                "shard": pa.array([shard] * n, pa.int32()),
                "payload": pa.array([r.tobytes() for r in reach], pa.binary()),
                "several": pa.array([int((r[:, 1] > 0).sum()) for r in reach], pa.int64()),
            }
        )

    return run


def _ask(batch: int, keys: np.ndarray, shard: np.ndarray, several: np.ndarray) -> pa.Table:
    """A row for each shard that holds some of the keys, which are sorted by shard."""
    edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(keys)]
    spans = list(zip(edges, edges[1:]))
    return pa.table(
        {
            "shard": pa.array([int(shard[a]) for a, _ in spans], pa.int32()),
            "batch": pa.array([batch] * len(spans), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            "several": pa.array([_bits(several[a:b]) for a, b in spans], pa.binary()),
        }
    )


def _heard(answers: pa.Table, number: int) -> list[tuple[int, bytes]]:
    found = zip(*(answers.column(c).to_pylist() for c in ("round", "shard", "payload")))
    return sorted((s, p) for r, s, p in found if r == number)


def _active(batch: Batch, answers: pa.Table, shards: int) -> np.ndarray:
    """The batch's hashes that start at several places."""
    keys, _ = batch.anchors()
    shard = _split(keys, shards)
    parts = [_unbits(p, int((shard == s).sum())) for s, p in _heard(answers, 1)]
    return keys[np.concatenate(parts)] if parts else keys[:0]


def _spans(sizes: np.ndarray, rows: np.ndarray, offsets: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes to remove: row, first, last + 1."""
    some = reach[:, 1] > 0
    rows, offsets, reach = rows[some], offsets[some], reach[some].astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1  # a byte between rows keeps their runs apart
    a, b = base[rows] + offsets - reach[:, 0], base[rows] + offsets + reach[:, 1]
    order = np.argsort(a, kind="stable")
    a, b, rows = a[order], np.maximum.accumulate(b[order]) if len(a) else b, rows[order]
    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1]))) if len(a) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(a)) - 1
    return rows[head], a[head] - base[rows[head]], b[tail] - base[rows[head]] if len(head) else b


def remove_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, replace: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Every row with ``n_bytes, n_removed, n_spans, kept (binary), kept_sha256`` added.

    With ``replace`` the text becomes what is kept of it, without characters that a span cut in two.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    shape = Shape(length)
    added = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    columns = [f for f in df.schema if f.name not in added.names]
    number, key = "__row", "__batch"
    while {number, key} & set(df.columns):
        number, key = number + "_", key + "_"
    # rows get their numbers in files, so that a task that runs again sees the same ones
    rows = scratch.cut(df.select(*[F.col(f"`{f.name}`") for f in columns]).withColumn(number, F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    batches = max(1, math.ceil(total / BATCH_BYTES))
    dealt = scratch.bucketed(rows.withColumn(key, F.pmod(F.xxhash64(number), F.lit(batches)).cast("int")), key, min(batches, MAX_SHARDS), "batches")
    scratch.drop(rows)
    filters = min(MAX_SHARDS, max(1, math.ceil(total / FILTER_BYTES)))

    def first(rows: pa.Table) -> pa.Table:
        keys, several = Batch(rows, text, shape, number).anchors()
        return _ask(rows.column(key)[0].as_py(), keys, _split(keys, filters), several)

    heard = scratch.cut(dealt.groupBy(key).applyInArrow(first, _ASK).groupBy("shard").applyInArrow(_filter, _ANSWER), "filter")
    left = heard.agg(F.sum("several")).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, math.ceil(left * shape.width / SHARD_BYTES)))

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, text, shape, number)
        if not batch.texts:
            return _ask(0, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool))
        suffixes, shard, counts, *_ = batch.array(_active(batch, answers, filters), shards)
        return _ask(rows.column(key)[0].as_py(), suffixes, shard, counts > 1)

    arrays = dealt.groupBy(key).cogroup(heard.groupBy("batch")).applyInArrow(second, _ASK)
    with scratch._set(_SENT, SENT_BYTES):
        found = scratch.cut(arrays.repartition(shards, "shard").groupBy("shard").applyInArrow(_scan(shape), _ANSWER), "family")
    result = T.StructType([*columns, *added])

    def third(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, text, shape, number)
        _, _, _, row, offset, place = batch.array(_active(batch, answers, filters), shards)
        reach = np.frombuffer(b"".join([p for _, p in _heard(answers, 2)]), np.uint16).reshape(-1, 2)
        kept, removed, spans, cuts = list(batch.texts), [0] * len(batch.texts), [0] * len(batch.texts), {}
        sizes = np.array([len(t) for t in batch.texts], np.int64)
        for r, a, b in zip(*(x.tolist() for x in _spans(sizes, row, offset, reach[place]))):
            cuts.setdefault(r, []).append((a, b))
        for r, spots in cuts.items():
            t, at, parts = kept[r], 0, []
            for a, b in spots:
                parts.append(t[at:a])
                at = b
                removed[r] += b - a
            kept[r], spans[r] = b"".join([*parts, t[at:]]), len(spots)
        texts = pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()) if replace else None
        out = [texts if replace and f.name == text else batch.rows.column(f.name) for f in columns]
        out += [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.Table.from_arrays(out, names=result.names)

    return dealt.groupBy(key).cogroup(heard.union(found).groupBy("batch")).applyInArrow(third, result)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
