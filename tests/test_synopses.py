import math
import random

import pytest
from pyspark.sql import functions as F

from winsyn.operators import samples, synopses, wavelets


def ints(spark, values, n=1):
    return spark.createDataFrame([(i, int(v), i % n) for i, v in enumerate(values)], "id long, x long, part int")


def test_count_min(spark):
    rnd = random.Random(1)
    values = [min(int(rnd.expovariate(0.02)), 400) for _ in range(4000)]
    df = ints(spark, values, 2)
    cells = synopses.count_min(df, [], "x", 272, 5)
    got = {r.x: r.estimate for r in synopses.count_min_point(cells, df.select("x").distinct(), [], "x", 272, 5).collect()}
    for v in set(values):
        assert values.count(v) <= got[v] <= values.count(v) + 4000 * math.e / 272
    key = lambda c: sorted(map(tuple, c.select("r", "bucket", "cnt").collect()))
    parts = [synopses.count_min(df.where(f"part = {k}"), [], "x", 272, 5) for k in (0, 1)]
    assert key(synopses.count_min_merge(*parts, [])) == key(cells)
    assert key(synopses.count_min_merge(cells, parts[0], [], -1)) == key(parts[1])
    assert key(synopses.count_min_merge(cells, cells, [])) == sorted((r, b, 2 * c) for r, b, c in key(cells))


def test_bloom(spark):
    assert synopses.bloom_k(800, 5000) == 4 and synopses.bloom_k(100_000, 10) == 1
    f = synopses.bloom(ints(spark, range(600, 2100)), [], "x", 1500, 3000)
    found = {r.x: r.found for r in synopses.bloom_probe(f, ints(spark, range(2100)), [], "x", 1500, 3000).collect()}
    assert all(found[x] for x in range(600, 2100))
    assert sum(found[x] for x in range(600)) / 600 < 0.6
    assert synopses.bloom(ints(spark, [5, 5, 5]), [], "x", 800, 5000).count() <= 4


def test_cuckoo(spark):
    f = synopses.cuckoo(ints(spark, range(1000, 3000)), [], "x", 4096)
    look = lambda g: {r.x: r.found for r in synopses.cuckoo_lookup(g, ints(spark, range(3000)), [], "x", 4096).collect()}
    found = look(f)
    assert all(found[x] for x in range(1000, 3000)) and sum(found[x] for x in range(1000)) < 60
    gone = look(synopses.cuckoo_merge(f, synopses.cuckoo(ints(spark, range(1000, 2000)), [], "x", 4096, sign=-1), by=[]))
    assert all(gone[x] for x in range(2000, 3000)) and sum(gone[x] for x in range(1000, 2000)) < 60


def test_ddsketch(spark):
    df = ints(spark, [800] * 200 + [0] * 10)
    bins = {r.bin: r.cnt for r in synopses.dd_sketch(df, [], "x", 0.01, 2000).collect()}
    assert sorted(bins.values()) == [10, 200] and bins[None] == 10
    with pytest.raises(Exception):
        synopses.dd_sketch(ints(spark, [-30]), [], "x", 0.01, 2000).collect()
    for bad in (1.0, 0.0, 12, -12):
        with pytest.raises(ValueError):
            synopses.dd_gamma(bad)
    rnd = random.Random(2)
    values = sorted(int(rnd.lognormvariate(6, 1)) + 1 for _ in range(3000))
    sketch = synopses.dd_sketch(ints(spark, values), [], "x", 0.01, 2000)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = synopses.dd_quantile(sketch, [], q, 0.01).first().quantile
        assert abs(got - values[int(q * 2999)]) <= 0.021 * values[int(q * 2999)]
    few = synopses.dd_sketch(ints(spark, [0, *values]), [], "x", 0.01, 50).collect()
    assert len(few) == 51 and sum(r.cnt for r in few) == 3001 and sum(r.cnt for r in few if r.bin is None) == 1


def test_hll_and_agms(spark):
    values = list(range(20_000)) * 2
    df = ints(spark, values, 2)
    regs = synopses.hll_registers(df, [], "x", 11)
    assert abs(synopses.hll_estimate(regs, [], 11).first().estimate - 20_000) < 2000
    assert sorted(map(tuple, synopses.hll_merge(regs, regs, []).collect())) == sorted(map(tuple, regs.collect()))
    for bad in (3, 17):
        with pytest.raises(ValueError):
            synopses.hll_registers(df, [], "x", bad)
    skew = [k for k in range(200) for _ in range(k)]
    exact = sum(k * k for k in range(200))
    got = synopses.agms_f2(synopses.agms(ints(spark, skew), [], "x", 2000, 7), [], 2000, 7).first()
    assert abs(got.f2 - exact) < 0.1 * exact


def test_four_level_code(spark):
    cells = spark.createDataFrame(list(enumerate([12, 18, 16, 6, 6, 14, 13, 15])), "bucket long, cnt long")
    code = synopses.four_level_code(cells, [])
    assert format(code.first().code, "032b") == "10000110010011010110101101010111"
    both = code.select(*[synopses.four_level_range(F.col("code"), F.lit(100), 0.0, 18.0, a, b).alias(n) for n, a, b in (("all", 0.0, 18.0), ("none", -9.0, 0.0), ("half", 0.0, 9.0))]).first()
    assert abs(both["all"] - 100) < 1e-9 and both["none"] == 0 and abs(both["half"] - 52) < 1


@pytest.mark.parametrize("a, b, want", [(0, 200, 100), (-10, 270, 100), (-247, 0, 0), (-10, 115, 60), (46, 75.48, 20), (75.48, 156.56, 40), (-10, 170, 86.19), (-10, 25, 10.87), (147.1, 190, 19.95), (156.56, 168, 5.27), (50, 120, 39.69), (20, 26, 2.61), (170, 189, 8.75)])
def test_equi_depth_range(spark, a, b, want):
    bounds = spark.createDataFrame([(i, x, 200.0, 100) for i, x in enumerate([0.0, 46.0, 75.48, 115.0, 156.56])], "i long, left_bound double, right_bound double, total long")
    assert round(synopses.equi_depth_range(bounds, [], a, b).first().estimate, 2) == want
    with pytest.raises(ValueError):
        synopses.equi_depth_range(bounds, [], 50, 24)


def test_samples(spark):
    df = spark.createDataFrame([(i, 1 if i < 12_000 else 0, i * 10) for i in range(15_000)], "id long, x int, t long")
    a, b = (samples.reservoir(df.where(f"id % 2 = {k}"), [], "id", 2000) for k in (0, 1))
    order = [synopses.raw_hash(F.col("id"), 7), F.col("id")]
    merged = samples.merge_samples(a, b, [], order, 2000)
    whole = samples.reservoir(df, [], "id", 2000)
    assert {r.id for r in merged.collect()} == {r.id for r in whole.collect()}
    assert abs(whole.agg(F.avg("x")).first()[0] - 0.8) < 0.04
    assert {r.id for r in samples.newest(df, [], "t", "id", 10).collect()} == set(range(14_990, 15_000))
    recent = [r.id for r in samples.biased(df, [], "t", "id", 500, 20_000.0).collect()]
    assert sum(recent) / 500 > 10_000
    strata = samples.stratified(df, [], "x", "id", 100).groupBy("x").agg(F.sum("weight").alias("w")).collect()
    assert {r.x: round(r.w) for r in strata} == {1: 12_000, 0: 3000}


def test_wavelet(spark):
    v = [9, 3, 9, -5, 5, 13, 13, 17, 14, -2, 9, 7, 7, 3]
    df = spark.createDataFrame(list(enumerate(map(float, v))), "idx long, v double").withColumn("k", F.lit(1))
    levels = wavelets.levels_of(df, "idx")
    c = wavelets.haar(df, ["k"], "idx", "v", levels)
    assert [r.value for r in wavelets.point(c, df, ["k"], levels).orderBy("idx").collect()] == v
    for i in (0, 4, 13):
        assert wavelets.range_sum(c, ["k"], 0, i, levels).first().total == sum(v[: i + 1])
    assert wavelets.threshold(c, ["k"], 3, levels).count() == 4


@pytest.mark.parametrize("by", [[], ["part"]])
def test_equi_depth_from_sketch_and_sample(spark, by):
    rnd = random.Random(5)
    values = [int(rnd.expovariate(0.002)) for _ in range(3000)]
    df = ints(spark, values, 2)
    groups = {(k,) if by else (): sorted(v for i, v in enumerate(values) if not by or i % 2 == k) for k in (0, 1)}
    bins = synopses.dd_sketch(df, by, "x", 0.01, 2048)
    for made, slack in ((synopses.dd_equi_depth(bins, by, 10, 0.01), 0.002), (samples.sampled_equi_depth(df, by, "x", "id", 10, 500), 0.08)):
        rows = made.collect()
        assert len(rows) == 10 * len(groups)
        for r in rows:
            v = groups[tuple(r[c] for c in by)]
            assert r.total == len(v) and abs(r.right_bound - v[-1]) <= 0.03 * v[-1]
            # the bound, give or take the sketch's accuracy, stands near its rank
            low, high = sum(x < r.left_bound * 0.97 for x in v) / len(v), sum(x <= r.left_bound * 1.03 for x in v) / len(v)
            assert low - slack <= r.i / 10 <= high + slack
        for r in synopses.equi_depth_range(made, by, 100.0, 900.0).collect():
            v = groups[tuple(r[c] for c in by)]
            assert abs(r.estimate - sum(100 <= x <= 900 for x in v)) < 0.1 * len(v)
