import pytest
from pyspark.sql import functions as F

from winsyn import registry


@pytest.mark.parametrize("name", ["query_timestamped", "query_timestamped_stratified"])
def test_questions_older_than_a_thousand_windows(spark, monkeypatch, name):
    days = 1800
    ev = spark.range(days).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"), (F.col("id") * registry.D + 5).alias("t"), F.lit(1.0).alias("value"), F.lit(1).alias("v"))
    monkeypatch.setattr(registry.tables, "events", lambda *_: ev)
    rows = registry.queries()[name](spark, "").collect()
    assert len(rows) == days and all((r.total is None) == (r.event_id % 3 == 0) for r in rows)


def test_equal_questions_and_cells_of_a_synopsis(spark):
    from winsyn.operators import answers

    syn = spark.createDataFrame([(0, 10, b, b * 5) for b in range(3)] + [(20, 30, b, b) for b in range(2)], "window_start long, window_end long, bucket int, cnt int")
    asked = spark.createDataFrame([(5,), (5,), (12,), (25,)], "qt long")
    got = sorted((r.qt, -1 if r.bucket is None else r.bucket) for r in answers.query_timestamped(syn, asked, [], "qt").collect())
    assert got == [(5, 0), (5, 0), (5, 1), (5, 1), (5, 2), (5, 2), (12, -1), (25, 0), (25, 1)]
    assert answers.query_latest(syn, asked, []).count() == 8
    newest = answers.query_timestamped(syn, asked, [], "qt", archive=1).collect()
    assert sorted((r.qt, r.cnt) for r in newest if r.cnt is not None) == [(25, 0), (25, 1)]


def test_answer_latest_takes_what_foreach_batch_passes(spark):
    from winsyn.streaming.windows import answer_latest

    syn = spark.createDataFrame([(0, 10, 1.0), (10, 20, 2.0)], "window_start long, window_end long, total double")
    seen = []
    answer_latest(syn, [], lambda df: seen.extend(df.collect()))(spark.createDataFrame([(1,)], "q int"), 0)
    assert [(r.q, r.total) for r in seen] == [(1, 2.0)]


def test_sums_of_small_values(spark):
    from winsyn.functions import aggregates as A
    from winsyn.plans.engine import WindowedAggregation
    from winsyn.plans.windows import tumbling

    df = spark.range(1000).select("id", F.lit(5).cast("long").alias("t"), F.lit(0.004).alias("value"))
    r = WindowedAggregation(df, "t").window(tumbling(10)).agg(s=A.sum_("value"), m=A.avg("value"), n=A.sum_("id")).run().first()
    assert abs(r.s - 4.0) < 1e-9 and abs(r.m - 0.004) < 1e-12 and r.n == 499500
