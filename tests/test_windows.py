"""Scripted traces: values at times, and the sums that each window must show."""

import random

import pytest
from pyspark.sql import functions as F

from winsyn.functions import aggregates as A
from winsyn.plans.engine import WindowedAggregation
from winsyn.plans.windows import Session, parse, session, sliding, tumbling

ONE_TO_FIVE = [(1, 1), (2, 19), (3, 29), (4, 39), (5, 49)]
GAPS = [(1, 1), (1, 30), (1, 20), (1, 23), (1, 25), (1, 45)]


def run(spark, rows, *specs, agg=None):
    df = spark.createDataFrame([(v, t, i) for i, (v, t) in enumerate(rows)], "value int, t long, id long")
    out = WindowedAggregation(df, "t", [], ["id"]).window(*specs).agg(x=agg or A.sum_("value")).run()
    return {(r.spec, r.window_start, r.window_end): r.x for r in out.collect()}


def sums(spark, rows, spec):
    return {k[1:]: v for k, v in run(spark, rows, spec).items()}


@pytest.mark.parametrize(
    "rows, spec, want",
    [
        (ONE_TO_FIVE, tumbling(10), {(0, 10): 1, (10, 20): 2, (20, 30): 3, (30, 40): 4, (40, 50): 5}),
        ([(1, 0), (2, 0), (3, 20), (4, 30), (5, 40)], tumbling(10), {(0, 10): 3, (20, 30): 3, (30, 40): 4, (40, 50): 5}),
        (GAPS, tumbling(10), {(0, 10): 1, (20, 30): 3, (30, 40): 1, (40, 50): 1}),
        (ONE_TO_FIVE, sliding(10, 5), {(0, 10): 1, (-5, 5): 1, (10, 20): 2, (15, 25): 2, (20, 30): 3, (25, 35): 3, (30, 40): 4, (35, 45): 4, (40, 50): 5, (45, 55): 5}),
        ([(1, 1), (2, 19), (3, 23), (4, 31), (5, 49)], session(10), {(1, 11): 1, (19, 41): 9, (49, 59): 5}),
        ([(1, 0), (2, 0), (3, 20), (4, 31), (5, 42)], session(10), {(0, 10): 3, (20, 30): 3, (31, 41): 4, (42, 52): 5}),
        ([(1, t) for t in (1, 9, 15, 30, 12)], session(10), {(1, 25): 4, (30, 40): 1}),
        ([(1, t) for t in (1, 9, 10, 30, 27)], session(10), {(1, 20): 3, (27, 40): 2}),
        ([(1, t) for t in (7, 30, 51, 15, 21)], session(10), {(7, 40): 4, (51, 61): 1}),
        ([(1, t) for t in (20, 40, 50, 57, 33, 31)], session(5), {(20, 25): 1, (31, 38): 2, (40, 45): 1, (50, 55): 1, (57, 62): 1}),
        ([(1, 1), (1, 19), (1, 29), (2, 39), (2, 49), (2, 50), (1, 51)], tumbling(3, "count"), {(0, 3): 3, (3, 6): 6}),
        ([(1, 1), (1, 19), (1, 29), (2, 39), (2, 10), (2, 50), (1, 51)], tumbling(3, "count"), {(0, 3): 4, (3, 6): 5}),
        ([(1, 1), (1, 19), (1, 29), (2, 39), (1, 41), (2, 10), (2, 50), (1, 51), (3, 52)], tumbling(5, "count"), {(0, 5): 7}),
    ],
)
def test_traces(spark, rows, spec, want):
    assert sums(spark, rows, spec) == want


def test_concurrent_windows(spark):
    got = run(spark, ONE_TO_FIVE, tumbling(10), tumbling(20), session(10))
    assert {k[1:]: v for k, v in got.items() if k[0] == tumbling(20).label} == {(0, 20): 3, (20, 40): 7, (40, 60): 5}
    assert len(got) == 5 + 3 + 2


def test_shared_slices_equal_single_windows_and_order_does_not_matter(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(-5, 90), rnd.randint(-500, 100_000)) for _ in range(800)]
    specs = [tumbling(1000), sliding(5000, 700), sliding(700, 2500), tumbling(3331), sliding(977, 13)]
    for agg in (None, A.avg("value"), A.quantile("value", 0.3)):
        together = run(spark, rows, *specs, agg=agg)
        apart = {}
        for s in specs:
            apart |= run(spark, rows[::-1], s, agg=agg)
        assert together == apart


def test_errors_and_notation():
    for bad in (lambda: tumbling(0), lambda: sliding(5, -1), lambda: Session(5, "count"), lambda: parse("Nonsense(3)")):
        with pytest.raises(ValueError):
            bad()
    assert parse("Sliding(2000,1000)+Tumbling(3)+Count(7)") == [sliding(2000, 1000), tumbling(3000), tumbling(7, "count")]
    assert len(parse("randomTumbling(20,1,20)")) == 20 and parse("randomSession(2,1,9)") == parse("randomSession(2,1,9)")


def test_empty_input(spark):
    assert run(spark, [], tumbling(5), session(3), tumbling(2, "count")) == {}


def test_slices_are_aggregated_before_they_meet_windows(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), F.lit(1).alias("value"))
    plan = WindowedAggregation(df, "t").window(sliding(60, 1), sliding(40, 1)).agg(x=A.sum_("value")).run()._jdf.queryExecution().executedPlan().toString()
    generate = plan.index("Generate")
    assert plan.index("HashAggregate") < generate and plan.rindex("HashAggregate") > generate
