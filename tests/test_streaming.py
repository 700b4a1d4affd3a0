"""Files fed one at a time, against the batch result on windows that the last watermark has closed."""

from pyspark.sql import functions as F

from winsyn.functions import aggregates as A
from winsyn.plans.engine import WindowedAggregation
from winsyn.plans.windows import session, sliding, tumbling
from winsyn.sources import tables
from winsyn.streaming import windows as S

H = 3_600_000


def feed(spark, tmp_path, name):
    ev = tables.events(spark, "/root/testdata/sf0.001").select("event_id", "user_id", "event_type", "value", "t")
    cut = [r[0] for r in ev.select(F.percentile("t", F.array(*[F.lit(k / 3) for k in range(1, 3)]))).collect()][0]
    for k, where in enumerate([F.col("t") <= cut[0], (F.col("t") > cut[0]) & (F.col("t") <= cut[1]), F.col("t") > cut[1]]):
        ev.where(where).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    return ev, S.with_event_time(stream, "t", "1 day")


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_time_windows(spark, tmp_path):
    ev, stream = feed(spark, tmp_path, "a")
    money = F.col("value").cast("decimal(18,2)")  # so that sums don't depend on their order
    for k, spec in enumerate([tumbling(H), sliding(6 * H, 2 * H), sliding(2 * H, 5 * H), session(H)]):
        got = {(r.event_type, r.window_start, r.window_end): r.x for r in drain(S.time_windows(stream, spec, ["event_type"], {"x": A.sum_(money)}), tmp_path, f"time{k}")}
        want = {(r.event_type, r.window_start, r.window_end): r.x for r in WindowedAggregation(ev, "t", ["event_type"]).window(spec).agg(x=A.sum_(money)).run().collect()}
        assert got.items() <= want.items()


def test_count_windows(spark, tmp_path):
    ev, _ = feed(spark, tmp_path, "b")
    stream = S.with_event_time(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "b")), "t", "1 seconds")
    got = {(r.event_type, r.window_start): round(r.sum, 6) for r in drain(S.count_windows(stream, "event_type", "value", "event_id", 20), tmp_path, "counts")}
    want = {(r.event_type, r.window_start): round(r.x, 6) for r in WindowedAggregation(ev, "t", ["event_type"], ["event_id"]).window(tumbling(20, "count")).agg(x=A.sum_("value")).run().collect()}
    assert got.items() <= want.items() and len(got) > 0.5 * len(want)
