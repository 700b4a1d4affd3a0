"""Headline queries on local[$BENCH_CPUS]: prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from winsyn.functions import aggregates as A
from winsyn.plans.engine import WindowedAggregation
from winsyn.plans.windows import parse, sliding
from winsyn.registry import QUERIES
from winsyn.sources import tables

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMED = ["flagship", "tumbling_sum", "sliding_sum", "session_sum", "count_tumbling_sum", "multi_window_shared", "random_tumbling_20", "cms_cells", "hll_registers", "ddsketch_quantile", "agms_f2", "equiwidth_hist", "equidepth_hist", "reservoir_sample", "bloom_probe", "query_timestamped_stratified"]


def timed(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    timed(QUERIES["tumbling_sum"](spark, SF))  # warm-up
    for name in NAMED:
        out[name] = timed(QUERIES[name](spark, SF))
    events = tables.events(spark, SF)
    rows = events.count()
    # the time should stay flat as windows overlap more and as there are more of them
    for overlap in (1, 2, 5, 10, 20, 40):
        plan = WindowedAggregation(events, "t", ["event_type"]).window(sliding(overlap * 60_000, 60_000)).agg(total=A.sum_("value"))
        out[f"overlap_{overlap}"] = timed(plan.run())
    for n in (1, 10, 100):
        plan = WindowedAggregation(events, "t", ["event_type"]).window(*parse(f"randomTumbling({n},60,1200)")).agg(total=A.sum_("value"))
        out[f"concurrent_{n}"] = timed(plan.run())
    print(json.dumps({"metric": "total query seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF, "event_rows": rows}))


if __name__ == "__main__":
    main()
