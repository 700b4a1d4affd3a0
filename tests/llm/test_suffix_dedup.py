import hashlib
import random
from collections import Counter

from winsyn.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, length=length).collect()}
    want = brute(texts, length)
    assert got == dict(enumerate(want))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(150)
    texts = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "ab" * 130, prose(4), passage, passage]
    for _ in range(40):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
        texts.append(prose(rnd.randint(1, 80)) + (passage if rnd.random() < 0.4 else "") + prose(rnd.randint(1, 80)))
    texts.append(prose(200) + "zq" * 105 + prose(50))  # repeats only within itself
    check(spark, texts, 200)
    check(spark, [t and t[:300] for t in texts], 40)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_many_batches(spark, monkeypatch):
    import winsyn.llm.suffix_dedup as m

    monkeypatch.setattr(m, "BATCH_BYTES", 3000)
    monkeypatch.setattr(m, "SHARD_BYTES", 7000)
    test_against_brute_force(spark)
