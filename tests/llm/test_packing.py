import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import winsyn.llm.packing as m

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def texts():
    rnd = random.Random(4)
    odd = ["it's HE'LL don't '''s !'s", "a\x1cb\x85c\xa0d e", "ÀÉÎ ÿ ß İ ı ſ ǅ ½ ² ª º", "é Å ﬁ", "Σίσυφος ΣΑΣ", "漢字かな 😀👍🏽", "x" * 3000, "<|endoftext|> </w> a</w>", "\x00\x01 \x7f", "1234 5,6", "İstanbul", None, "", " \n\t "]
    return odd + [" ".join(rnd.choice(["tHe", "naïve", "Grüße", "ever", "token"]) + str(rnd.randint(0, 99)) * rnd.randint(0, 1) for _ in range(rnd.randint(1, 6000))) for _ in range(60)]


def test_words_equal_the_library():
    t = texts()
    assert [np.frombuffer(b, "<u4").tolist() for b in m.Words(PATH).encode(t)] == reference(t)


def test_pieces(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts() * 4)] + [(None, "null id", 1), (3, "again", 2), (3, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = m.pack(df, PATH, keep_ids=True).collect()
    ids = {}
    for (d, t, _), x in zip(rows, reference([r[1] for r in rows])):
        ids.setdefault((d, tuple([*x, 2])), [0])[0] += 1
    total = sum(n[0] * len(k[1]) for k, n in ids.items())
    assert sum(r.length for r in got) == total
    docs = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        if r.doc_id is not None and r.doc_id > 3:
            docs.setdefault(r.doc_id, []).append(r)
    for (d, x), _ in ids.items():
        if d is not None and d > 3:
            parts = sorted(docs[d], key=lambda r: r.start)
            assert b"".join(r.ids for r in parts) == np.array(x, "<u4").tobytes()
            assert all(r.doc_tokens == len(x) for r in parts)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        at = 0
        for offset, length in s:
            assert offset == at
            at += length
        assert at <= 4096
    assert total / (4096 * len(seqs)) > 0.85


def test_plan_uses_the_histogram():
    h = np.zeros(257, np.int64)
    h[[100, 156, 50, 106, 128]] = [70, 60, 33, 40, 9]
    used = np.zeros(257, np.int64)
    for lengths, n in m.plan(h):
        assert sum(lengths) == 256
        for p in lengths:
            used[p] += n
    assert (used <= h).all() and used.sum() > 100


@pytest.mark.parametrize("seed", range(5))
def test_nnls(seed):
    rng = np.random.default_rng(seed)
    a, x = rng.random((30, 60)), np.maximum(rng.normal(size=60), 0)
    got = m.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def test_empty_table(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_names_of_special_tokens():
    texts = ["<|endoftext|>", "a <|startoftext|>b<|ENDOFTEXT|> c", "x\x0by\xa0z", "KKÅ", "tab\tx\x85y\x1cz", "it's İstanbul", None, ""]
    want = reference(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in m.Words(PATH).encode(texts)] == want
    assert want[0] == [49407]


def test_plan_places_most_pieces_of_short_texts():
    lengths = np.random.default_rng(4).geometric(1 / 40, 10_000)
    histogram = np.bincount(lengths[lengths <= 256], minlength=257)
    found = m.plan(histogram)
    assert all(sum(c) == 256 for c, _ in found)
    used = sum(len(c) * n for c, n in found)
    assert used > 0.8 * histogram.sum()
