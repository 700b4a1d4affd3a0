import random

import pytest
from pyspark.sql import functions as F

from winsyn.operators import wavelets


def sequences(spark, sizes):
    rnd = random.Random(4)
    rows = [(k, i, float(rnd.randint(-500, 500))) for k, n in enumerate(sizes) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, idx long, v double")


def brute(values, levels):
    """Level by level: {(level, node): (coeff, leaves to the left, to the right)}."""
    cur, out = [(x, 1) for x in values], {}
    for level in range(levels):
        new = []
        for i in range(0, len(cur), 2):
            (a, n), right = cur[i], cur[i + 1 : i + 2]
            if right:
                (b, m) = right[0]
                out[level, i // 2] = (a - (a + b) / 2, n, m)
                a, n = (a + b) / 2, n + m
            new.append((a, n))
        cur = new
    return out | {(levels, 0): (*cur[0], 0)}


def test_plan_grows_with_layers_only(spark):
    _, df = sequences(spark, [5])
    value = wavelets.point(wavelets.haar(df, ["k"], "idx", "v", 21), df, ["k"], 21)
    assert value._jdf.queryExecution().sparkPlan().toString().count("Aggregate") < 80


@pytest.mark.parametrize("sizes", [[1, 2, 255, 256, 257, 1000, 700], [70_000, 3]])
def test_layers_against_brute_force(spark, sizes):
    rows, df = sequences(spark, sizes)
    levels = wavelets.levels_of(df, "idx")
    c = wavelets.haar(df, ["k"], "idx", "v", levels)
    got = {}
    for r in c.collect():
        got.setdefault(r.k, {})[r.level, r.node] = (r.coeff, r.leaves_left, r.leaves_right)
    want = {k: brute([v for q, _, v in sorted(rows) if q == k], levels) for k in range(len(sizes))}
    assert {k: set(x) for k, x in got.items()} == {k: set(x) for k, x in want.items()}
    assert all(got[k][at] == pytest.approx(x) for k, w in want.items() for at, x in w.items())
    made = {(r.k, r.idx): r.value for r in wavelets.point(c, df, ["k"], levels).collect()}
    assert made == pytest.approx({(k, i): v for k, i, v in rows})


def test_points_of_a_thresholded_wavelet(spark):
    rows, df = sequences(spark, [600, 40])
    df = df.withColumnRenamed("k", "g")
    levels = wavelets.levels_of(df, "idx")
    kept = wavelets.threshold(wavelets.haar(df, ["g"], "idx", "v", levels), ["g"], 20, levels).cache()
    have = {(r.g, r.level, r.node): r.coeff for r in kept.collect()}

    def value(k, i):
        signed = [have.get((k, at, i >> at + 1), 0.0) * (-1 if i >> at & 1 else 1) for at in range(levels)]
        return have[k, levels, 0] + sum(signed)

    got = {(r.g, r.idx): r.value for r in wavelets.point(kept, df, ["g"], levels).collect()}
    assert got == pytest.approx({(k, i): value(k, i) for k, i, _ in rows})


def test_sequences_with_gaps_to_the_right(spark):
    df = spark.createDataFrame([(0, 4.0), (2, 6.0), (3, 2.0), (4, 8.0)], "idx long, v double").withColumn("k", F.lit(1))
    got = {r.idx: r.value for r in wavelets.point(wavelets.haar(df, ["k"], "idx", "v", 3), df, ["k"], 3).collect()}
    assert got == {0: 4.0, 2: 6.0, 3: 2.0, 4: 8.0}


def test_distributed_query_has_a_plan_of_layers(spark):
    from winsyn import registry

    sf = "/root/testdata/sf0.001"
    plan = registry.queries()["haar_distributed"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate") < 40


def test_distributed_query_does_not_repeat_its_layers(spark):
    from winsyn import registry

    sf = "/root/testdata/sf0.001"
    plan = registry.queries()["haar_distributed"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate") < 20 and "Window" not in plan


def test_written_layers_are_the_same(spark):
    from winsyn.scratch import Scratch

    _, df = sequences(spark, [1000, 3])
    made = [{tuple(r) for r in wavelets.haar(df, ["k"], "idx", "v", 10, s).collect()} for s in (None, Scratch(spark, "haar"))]
    assert made[0] == made[1]
