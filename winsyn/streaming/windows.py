"""The windows over Structured Streaming: event time, watermarks, append mode.

A row later than the watermark is dropped, where an engine that keeps old slices would still add it to windows that haven't
fired; choose the delay accordingly. Windows beyond the last watermark stay open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Agg
from ..plans.windows import Session, Window


def with_event_time(df: DataFrame, t: str, delay: str = "0 seconds") -> DataFrame:
    """``event_time`` from a column of milliseconds, or of timestamps with or without zone, and its watermark."""
    kind = df.schema[t].dataType
    stamp = F.timestamp_millis(F.col(t)) if isinstance(kind, (T.LongType, T.IntegerType)) else F.col(t).cast("timestamp")
    return df.withColumn("event_time", stamp).withWatermark("event_time", delay)


def time_windows(df: DataFrame, spec: Window | Session, keys: list[str], aggs: dict[str, Agg]) -> DataFrame:
    """One specification; a query with several has one such result, and state, for each."""
    if isinstance(spec, Session):
        w = F.session_window("event_time", f"{spec.gap} milliseconds")
    elif spec.measure == "count":
        raise ValueError("count windows have an operator of their own")
    elif spec.slide > spec.size:
        inside = F.pmod(F.unix_millis("event_time"), F.lit(spec.slide)) < spec.size
        df, w = df.where(inside), F.window("event_time", f"{spec.slide} milliseconds")
    else:
        w = F.window("event_time", f"{spec.size} milliseconds", f"{spec.slide} milliseconds")
    out = df.groupBy(w.alias("w"), *keys).agg(*[a.final(*a.partials).alias(n) for n, a in aggs.items()])
    start = F.unix_millis("w.start")
    end = start + spec.size if isinstance(spec, Window) and spec.slide > spec.size else F.unix_millis("w.end")
    return out.select(*keys, F.lit(spec.label).alias("spec"), start.alias("window_start"), end.alias("window_end"), *aggs)


def count_windows(df: DataFrame, key: str, value: str, tie: str, size: int) -> DataFrame:
    """Sums of every ``size`` values of a key in event-time order.

    A row's place is final only when the watermark has passed it, so rows wait in state until then; each full group is
    emitted once.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, filled, total, times, ties, values = state.get if state.exists else (0, 0, 0.0, [], [], [])
        rows = list(zip(times, ties, values))
        for f in frames:
            rows += zip(f["t"].tolist(), f[tie].tolist(), f[value].tolist())
        rows.sort()
        wm = state.getCurrentWatermarkMs()
        out, open_ = [], []
        for t, i, v in rows:
            if t > wm:
                open_.append((t, i, v))
                continue
            filled, total = filled + 1, total + v
            if filled == size:
                out.append((k[0], at, at + size, total))
                at, filled, total = at + size, 0, 0.0
        state.update((at, filled, total, [r[0] for r in open_], [r[1] for r in open_], [r[2] for r in open_]))
        if open_:
            state.setTimeoutTimestamp(max(open_[0][0], wm) + 1)
        yield pd.DataFrame(out, columns=[key, "window_start", "window_end", "sum"])

    rows = df.withColumn("t", F.unix_millis("event_time")).select(key, value, tie, "t", "event_time")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, window_start long, window_end long, sum double", "at long, filled long, total double, times array<long>, ties array<long>, vals array<double>", "append", "EventTimeTimeout")


def answer_latest(synopses: DataFrame, keys: list[str], sink):
    """For ``questions.writeStream.foreachBatch``: ``sink`` gets each micro-batch of questions with the latest rows of a table."""
    from ..operators.answers import query_latest

    def answer(batch: DataFrame, _: int) -> None:
        sink(query_latest(synopses, batch, keys))

    return answer
