"""Any synopsis over any windows, from shared slices.

A synopsis is a relation of counters, so a window's is the merge of its slices': rows are counted once, by key and slice, and only counters are
spread over the windows that contain the slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.engine import rank_by_time, slice_start, windows_of
from ..plans.windows import Window
from . import synopses


@dataclass(frozen=True)
class Synopsis:
    """``build(df, by)`` gives (by, cell columns, counters); ``merges`` combine the counters of one cell; ``finish(cells, by)`` comes last."""

    build: Callable[[DataFrame, list[str]], DataFrame]
    cell: tuple[str, ...]
    merges: dict[str, Callable[[str], Column]]
    finish: Callable[[DataFrame, list[str]], DataFrame] = lambda cells, by: cells


def count_min(x: str, width: int, rows: int, seed: int = 1) -> Synopsis:
    return Synopsis(lambda df, by: synopses.count_min(df, by, x, width, rows, seed), ("r", "bucket"), {"cnt": F.sum})


def agms(x: str, width: int, rows: int, seed: int = 1) -> Synopsis:
    return Synopsis(lambda df, by: synopses.agms(df, by, x, width, rows, seed), ("r", "bucket"), {"cell": F.sum})


def hll(x: str, log_m: int, seed: int = 1) -> Synopsis:
    return Synopsis(lambda df, by: synopses.hll_registers(df, by, x, log_m, seed), ("reg",), {"rho": F.max})


def equi_width(v: str, low: float, high: float, n: int) -> Synopsis:
    return Synopsis(lambda df, by: synopses.equi_width(df, by, v, low, high, n), ("bucket",), {"cnt": F.sum})


def dd_sketch(v: str, accuracy: float, max_bins: int) -> Synopsis:
    """Slices keep all their bins; a window folds its lowest ones only when it is complete."""
    return Synopsis(lambda df, by: synopses.dd_sketch(df, by, v, accuracy, 2**31 - 1), ("bin",), {"cnt": F.sum}, lambda cells, by: synopses.dd_collapse(cells, by, max_bins))


def over_windows(df: DataFrame, t: str, specs: list[Window], keys: list[str], synopsis: Synopsis, ties: list[str] | None = None) -> DataFrame:
    """(keys, spec, window_start, window_end, cells) for every window of every specification; ``t`` is a long of milliseconds.

    ``spec`` is the specification's number. Count windows are full ones only, over ordinals in event-time order with ``ties`` for equal times.
    Rows without a time take no part.
    """
    by = [*keys, "spec", "window_start", "window_end"]
    df = df.where(F.col(t).isNotNull())
    timed = [(i, s) for i, s in enumerate(specs) if s.measure == "time"]
    parts = []
    if timed:
        cells = synopsis.build(df.withColumn("__slice", slice_start(F.col(t), [s for _, s in timed])), [*keys, "__slice"])
        parts.append(cells.select("*", F.inline(windows_of(F.col("__slice"), timed))).drop("__slice"))
    counted = [(i, s) for i, s in enumerate(specs) if s.measure == "count"]
    if counted:
        ranked = rank_by_time(df, t, keys, ties or [])
        cells = synopsis.build(ranked.withColumn("__slice", slice_start(F.col("rn").cast("long"), [s for _, s in counted])), [*keys, "__slice"])
        size = ranked.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else ranked.agg(F.count("*").alias("__n"))
        spread = cells.select("*", F.inline(windows_of(F.col("__slice"), counted))).drop("__slice").where("window_start >= 0")
        full = spread.join(size, keys) if keys else spread.crossJoin(F.broadcast(size))  # without keys one row
        parts.append(full.where(F.col("window_end") <= F.col("__n")).drop("__n"))
    if not parts:
        raise ValueError("at least one window")
    spread = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    merged = spread.groupBy(*by, *synopsis.cell).agg(*[f(c).alias(c) for c, f in synopsis.merges.items()])
    return synopsis.finish(merged, by)
