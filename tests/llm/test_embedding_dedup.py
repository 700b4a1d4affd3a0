import random

import numpy as np

from winsyn.llm.embedding_dedup import near_vectors


def brute(rows, cosine=0.98):
    ok = [i for i, (_, v, c) in enumerate(rows) if v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    a, b = root(i), root(j)
                    comp[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted(((r[0], n[i], (c := least.get(root(i))), r[0] is not None and r[0] == c) for i, r in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(30, 64))
    rows = []
    for k in range(600):
        v = centres[k % 30] + rnd.normal(size=64) * rnd.choice([0.0, 0.05, 0.1, 0.14, 0.3])
        rows.append((k * 3, [float(x) for x in v], int(k % 30 // 10) if k % 50 else None))
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [1.0, None], 1), (9004, [float("nan")] * 64, 1), (9005, [1e30] * 64, 1), (9006, [2e30] * 64, 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (None, rows[4][1], rows[4][2]), rows[5], rows[5]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    want = brute(rows)
    # the index is not exact: nearly all links, and none too many
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
