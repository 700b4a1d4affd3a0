import math
import random

from winsyn.llm.topk_search import top_k


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)]) for i in range(-100, 400)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (550, [float("nan")] * 4), (551, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (600, [0.1, 0.2]), (601, [0.1, 0.3]), (650, [1e9] * 4), (700, [0.3] * 4), (700, [0.3] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in top_k(df).collect())
    ok = [(i, [math.floor(256 * x) for x in map(float, spark_floats(v))]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for m, (c, w) in enumerate(ok) if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert got == sorted(want)


def spark_floats(v):
    import numpy as np

    return np.array(v, np.float32).astype(float)


def test_groups_and_empty(spark, monkeypatch):
    import winsyn.llm.topk_search as m

    for name, value in (("TILE", 16), ("GROUP", 20), ("BLOCK", 3), ("FAN_IN", 2)):
        monkeypatch.setattr(m, name, value)
    test_against_brute_force(spark)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
