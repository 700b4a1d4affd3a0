import itertools
import math

import numpy as np
import public_tokenizers as P

import winsyn.llm.language_id as m


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    logp = np.log(np.array([[0.1, 0.3], [0.2, 0.1], [0.4, 0.2], [0.2, 0.1], [0.1, 0.3]]))
    words = ["aba", "abab", "b", "axb"]
    got = m.Lattice(words, {p: i for i, p in enumerate(pieces)}).likelihood(logp)
    for w, row in zip(words, got):
        for k in range(2):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(w) - 1):
                parts, at = [], 0
                for i, c in enumerate((*cuts, 1)):
                    if c:
                        parts.append(w[at : i + 1])
                        at = i + 1
                p = 1.0
                for x in parts:
                    known = math.exp(logp[pieces.index(x), k]) if x in pieces else 0.0
                    p *= known + (math.exp(m._UNKNOWN) if len(x) == 1 else 0.0)
                total += p
            assert abs(math.log(total) - row[k]) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = m.op3_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", "x"), (2, "der und die", "de", "x"), (3, None, "de", "x"), (4, "12 ... %", None, "x"), (5, "y" * 5000, None, "x"), (None, "und der", None, "x"), (6, "", "en", "x")], "doc_id long, text string, lang string, score string")
    model = m.train(docs, m.vocabulary(P.path("piece_bpe_32k.model")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in m.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == got[None][0] == "de" and got[3] == got[4] == got[6] == ("und", 0.0) and got[5][0] in ("en", "de")
    assert m.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in m.predict(docs, m.train(docs.limit(0), ["a"])).collect()} == {"und"}


def test_numbers_are_not_letters():
    from winsyn.llm.language_id import words_of

    assert words_of("½ ² Ⅷ 12 ٣ _ ①") == []
    assert words_of("Straße 2² ñandú") == ["straße", "ñandú"]
    assert words_of("x" * 500) == ["x" * 500]
