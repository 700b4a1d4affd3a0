"""Approximate query answering: a stream of questions against archived synopses (rows with window_start, window_end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(synopses: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's rows of its last window."""
    if not keys:
        top = synopses.agg(F.max("window_start").alias("window_start"))  # one row
        return synopses.join(F.broadcast(top), "window_start")
    return synopses.join(synopses.groupBy(*keys).agg(F.max("window_start").alias("window_start")), [*keys, "window_start"])


def query_latest(synopses: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Every query with the latest synopsis (of its key), a row for each of its cells; unanswered ones keep nulls."""
    last = latest(synopses, keys)
    if keys:
        return queries.join(last, keys, "left")
    return queries.join(F.broadcast(last), F.lit(True), "left")  # one window's synopsis, whose size its parameters bound


def query_timestamped(synopses: DataFrame, queries: DataFrame, keys: list[str], t: str, archive: int | None = 1000) -> DataFrame:
    """As-of: the synopsis with the greatest window_start <= t, if t <= window_end, a row for each of its cells; unanswered queries keep nulls.

    Only the newest ``archive`` windows (of a key) are asked, all if None. The time line is cut into cells no shorter than a window, so
    a query's window starts in its cell or the one before: windows are dealt to both, and within (key, cell) each query takes the last
    window before it in time order. Neither a key nor the lack of one makes a single task, and equal queries stay apart.
    """
    windows = synopses.select(*keys, "window_start", "window_end").distinct()
    if archive is not None and keys:
        newest = W.partitionBy(*keys).orderBy(F.desc("window_start"))
        windows = windows.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= archive).drop("__k")
    elif archive is not None:
        windows = windows.orderBy(F.desc("window_start")).limit(archive)
    step = max(1, windows.agg(F.max(F.col("window_end") - F.col("window_start"))).first()[0] or 1)
    cell = lambda c: F.floor(c / F.lit(float(step))).cast("long")
    own = F.struct(*queries.columns)
    asked = queries.select(*keys, F.col(t).cast("long").alias("__t"), F.lit(1).alias("__o"), cell(F.col(t)).alias("__c"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("__w"), own.alias("__q"))
    starts = windows.select(*keys, F.col("window_start").alias("__t"), F.lit(0).alias("__o"), F.explode(F.array(cell(F.col("window_start")), cell(F.col("window_start")) + 1)).alias("__c"), F.struct(F.col("window_start").alias("s"), F.col("window_end").alias("e")).alias("__w"))
    merged = asked.unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy(*keys, "__c").orderBy("__t", "__o").rowsBetween(W.unboundedPreceding, 0)
    found = merged.withColumn("__w", F.last("__w", ignorenulls=True).over(order)).where("__o = 1")
    start = F.when(F.col("__w.e") >= F.col("__t"), F.col("__w.s"))
    found = found.select("__q.*", start.alias("__start"))
    body = [c for c in synopses.columns if c not in keys]
    right = synopses.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__s_{c}") for c in body])
    match = F.col("__start") == F.col("__s_window_start")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(right, match, "left").select(*queries.columns, *[F.col(f"__s_{c}").alias(c) for c in body])


def interval_join(synopses: DataFrame, queries: DataFrame, keys: list[str], t: str, step: int) -> DataFrame:
    """All windows that contain each query's time, window_end included: an equi-join on cells of the time line, then the exact test."""
    cell = lambda c: ((c - F.pmod(c, F.lit(step))) / step).cast("long")
    spread = synopses.withColumn("__cell", F.explode(F.sequence(cell(F.col("window_start")), cell(F.col("window_end")))))
    asked = queries.withColumn("__cell", cell(F.col(t)))
    return asked.join(spread, [*keys, "__cell"]).where(F.col(t).between(F.col("window_start"), F.col("window_end"))).drop("__cell")
