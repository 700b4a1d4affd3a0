"""Language identification with segmentation-marginalised unigrams (op 3).

The vocabulary is fixed and public: the pieces of a tokenizer file that are made of letters, and every character seen.
Each language has a probability for each piece. The likelihood of a word is the sum over all segmentations into pieces of
the product of their probabilities, by the forward algorithm; a text's is the product over its words (maximal runs of letters,
lower-cased). The prediction is the language of largest posterior under equal priors, and the score is that posterior.

Training reads labelled rows, a bounded sample of about ``PER_LANGUAGE`` different texts a language chosen by a hash of the text, each once, counts
words by language in the cluster, and runs ``ROUNDS`` of expectation maximisation on them with the forward-backward algorithm. Prediction is a map over all texts; a worker keeps the likelihoods of words it has seen.

Texts that are null or hold no letter are ``und`` with score 0. With no labelled row every text is ``und``.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table

PER_LANGUAGE, ROUNDS = 500, 3
KEEP, CELLS = 600_000, 1 << 18  # words that a worker remembers, cells of a lattice
# letters as str.isalpha has them: word characters without digits, and without numbers such as fractions
_NUMBERS = "".join(c for c in map(chr, range(0xAA, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMBERS}]+")
_NEARLY = re.compile(r"[^\W\d_]+")  # lets those numbers pass, in a fraction of the time
_UNKNOWN = -14.0  # log probability of a character that no training text has


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text."""
    lowered = (text or "").lower()
    found = _NEARLY.findall(lowered)
    return found if not found or "".join(found).isalpha() else _LETTERS.findall(lowered)


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that consist of letters; word starts lose their mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if _LETTERS.fullmatch(p))


class Lattice:
    """All pieces in a list of words, grouped for vectorised dynamic programming."""

    def __init__(self, words: list[str], index: dict[str, int]):
        most = max(map(len, index), default=1)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.order = np.array(order, np.int64)
        self.longest = len(words[order[0]]) if words else 0
        sizes = np.array([len(words[i]) for i in order], np.int64)
        self.sizes = sizes
        # a piece of a word as one number: its end, its size, its id
        get, span, base = index.get, most + 1, max(index.values(), default=0) + 1
        flat, counts = [], []
        for i in order:
            w, n, before = words[i], len(words[i]), len(flat)
            flat += [(b * span + b - a) * base + k for a in range(n) for b in range(a + 1, min(n, a + most) + 1) if (k := get(w[a:b])) is not None]
            counts.append(len(flat) - before)
        step, ids = np.divmod(np.array(flat, np.int64), base)
        rows, by_step = np.repeat(np.arange(len(order)), counts), np.argsort(step, kind="stable")
        step, ids, rows = step[by_step], ids[by_step], rows[by_step]
        firsts = np.flatnonzero(np.diff(step, prepend=-1))
        self.steps: dict[int, list] = {}
        for lo, hi in zip(firsts, [*firsts[1:], len(step)]):
            end, size = divmod(int(step[lo]), span)
            self.steps.setdefault(end, []).append((size, rows[lo:hi], ids[lo:hi]))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """alpha[row, end, language]: log of the sum over segmentations of each prefix; unknown characters stand alone."""
        alpha = np.full((len(self.sizes), self.longest + 1, logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, self.longest + 1):
            out = alpha[:, end - 1] + _UNKNOWN
            for size, rows, ids in self.steps.get(end, ()):
                out[rows] = np.logaddexp(out[rows], alpha[rows, end - size] + logp[ids])
            alpha[:, end] = out
        return alpha

    def likelihood(self, logp: np.ndarray) -> np.ndarray:
        alpha = self.forward(logp)
        out = np.empty((len(self.sizes), logp.shape[1]))
        out[self.order] = alpha[np.arange(len(self.sizes)), self.sizes]
        return out

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, by forward-backward, over words with given counts by language."""
        alpha = self.forward(logp)
        rows = np.arange(len(self.sizes))
        total = alpha[rows, self.sizes]
        beta = np.full(alpha.shape, -np.inf)
        beta[rows, self.sizes] = 0
        counts = np.zeros(logp.shape)
        w = weight[self.order]
        for end in range(self.longest, 0, -1):
            beta[:, end - 1] = np.logaddexp(beta[:, end - 1], beta[:, end] + _UNKNOWN)
            for size, r, ids in self.steps.get(end, ()):
                through = beta[r, end] + logp[ids]
                beta[r, end - size] = np.logaddexp(beta[r, end - size], through)
                np.add.at(counts, ids, np.exp(alpha[r, end - size] + through - total[r]) * w[r])
        return counts


def _portions(words: list[str]):
    """Words by length, in lists whose lattices have at most ``CELLS`` cells or one word."""
    held, cells = [], 0
    for w in sorted(words, key=len):
        if held and (len(held) + 1) * (len(w) + 1) > CELLS:
            yield held
            held = []
        held.append(w)
    if held:
        yield held


class Model:
    def __init__(self, languages: list[str], pieces: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp
        self.index = {p: i for i, p in enumerate(pieces)}
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))

    def __getstate__(self):
        return self.languages, list(self.index), self.logp

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.known) > KEEP:
            self.known, self.table = {}, self.table[:0]
        new = list({w for f in found for w in f}.difference(self.known))
        parts = [self.table]
        for portion in _portions(new):
            parts.append(Lattice(portion, self.index).likelihood(self.logp))
            for w in portion:
                self.known[w] = len(self.known)
        self.table = np.concatenate(parts)
        out = []
        for f in found:
            if not f:
                out.append(("und", 0.0))
                continue
            s = self.table[[self.known[w] for w in f]].sum(axis=0)
            k = int(s.argmax())
            out.append((self.languages[k], float(1 / np.exp(s - s[k]).sum())))
        return out


def train(df: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from labelled rows."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    hashed = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(hashed < share[F.col("lang")]).distinct()

    def count(batches):
        from collections import Counter

        for b in batches:
            seen: dict[str, Counter] = {}
            for k, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(k, Counter()).update(words_of(t))
            flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    data = words.collect()  # the words of the bounded sample
    languages = sorted(counts)
    letters = {c for r in data for c in r.word}
    pieces = sorted(set(pieces) | letters)
    index = {p: i for i, p in enumerate(pieces)}
    vocab = sorted({r.word for r in data}, key=lambda w: (len(w), w))
    at = {w: i for i, w in enumerate(vocab)}
    weight = np.zeros((len(vocab), len(languages)))
    for r in data:
        weight[at[r.word], languages.index(r.lang)] = r.n
    lattices = [(Lattice(p, index), weight[[at[w] for w in p]]) for p in _portions(vocab)]
    single = np.array([len(p) == 1 for p in pieces])
    logp = np.log(np.full((len(pieces), len(languages)), 1.0 / len(pieces)))
    for _ in range(rounds):
        found = np.zeros(logp.shape)
        for lattice, counts_of in lattices:
            found += lattice.expected(logp, counts_of)
        found += np.where(single, 0.5, 0.01)[:, None]
        logp = np.log(found / found.sum(axis=0))
    return Model(languages, pieces, logp)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    columns = [c for c in df.columns if c not in ("lang_pred", "score")]
    frame = df.select(*columns)
    out = frame.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double")).schema

    def run(batches):
        give_back()
        own = model
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = own.score(part.column(columns.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=out.names)

    return frame.mapInArrow(run, out)


def held_out(id_col: str = "doc_id"):
    """Every fourth document, by the CRC of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
