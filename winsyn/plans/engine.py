"""Concurrent windows over one keyed table, from shared slices.

All time windows of fixed size cut the time line at their starts and ends; between two cuts lies a slice. Rows are aggregated
once, by key and slice, and each slice's partials are merged into the windows that contain it. The shuffle after the
first aggregation carries slices, not rows times windows. Sessions and count windows read the rows themselves.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, Holistic
from .windows import Session, Window


def floor_to(t: Column, step: int) -> Column:
    return t - F.pmod(t, F.lit(step))


def slice_start(t: Column, specs: list[Window]) -> Column:
    """The last window start or end at or before ``t``: on a common grid if it is coarse, else over all specifications."""
    grid = reduce(gcd, [x for s in specs for x in (s.size, s.slide)])
    if grid * 16 >= min(min(s.size, s.slide) for s in specs):
        return floor_to(t, grid)
    edges = []
    for slide, rest in sorted({(s.slide, 0) for s in specs} | {(s.slide, s.size % s.slide) for s in specs}):
        edges.append(floor_to(t - rest, slide) + rest)
    return F.greatest(*edges) if len(edges) > 1 else edges[0]


def windows_of(t: Column, specs: list[tuple[int, Window]]) -> Column:
    """All windows that contain ``t``: array of (spec, window_start, window_end)."""

    def of(i: int, s: Window) -> Column:
        last = floor_to(t, s.slide)
        if s.size == s.slide:
            return F.array(F.struct(F.lit(i).alias("spec"), last.alias("window_start"), (last + s.size).alias("window_end")))
        starts = F.sequence(last - (-(-s.size // s.slide) - 1) * s.slide, last, F.lit(s.slide).cast("long"))
        starts = F.filter(starts, lambda w: t < w + s.size)
        return F.transform(starts, lambda w: F.struct(F.lit(i).alias("spec"), w.alias("window_start"), (w + s.size).alias("window_end")))

    parts = [of(i, s) for i, s in specs]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def rank_by_time(df: DataFrame, t: str, keys: list[str], ties: list[str]) -> DataFrame:
    """``rn``: the ordinal, from 0, of each row in event-time order within its key.

    Without keys, rows are dealt into ranges of time of known counts first, so that no task sorts the whole table.
    """
    if keys:
        return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(t, *ties)) - 1)
    cuts = df.agg(F.percentile_approx(t, [k / 64 for k in range(1, 64)], 1000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c < F.col(t)))
    dealt = df.withColumn("__b", bucket)
    counts = {r[0]: r[1] for r in dealt.groupBy("__b").count().collect()}  # at most 64 rows
    before = [sum(n for b, n in counts.items() if b < k) for k in range(len(set(cuts)) + 1)]
    first = F.element_at(F.array(*[F.lit(n) for n in before]), F.col("__b") + 1)
    return dealt.withColumn("rn", first + F.row_number().over(W.partitionBy("__b").orderBy(t, *ties)) - 1).drop("__b")


class WindowedAggregation:
    """``WindowedAggregation(df, "t", ["key"]).window(..).agg(name=..).run()``; ``t`` is a long of milliseconds.

    The result has the keys, ``window_type, measure, spec, window_start, window_end`` and the aggregates.
    ``ties`` order rows of equal time for count windows.
    """

    def __init__(self, df: DataFrame, t: str, keys: list[str] | None = None, ties: list[str] | None = None):
        self.df, self.t, self.keys, self.ties = df.where(F.col(t).isNotNull()), t, keys or [], ties or []
        self.specs: list[Window | Session] = []
        self.aggs: dict[str, Agg | Holistic] = {}

    def window(self, *specs: Window | Session) -> WindowedAggregation:
        self.specs += specs
        return self

    def agg(self, **aggs: Agg | Holistic) -> WindowedAggregation:
        self.aggs |= aggs
        return self

    def _partials(self) -> list[Column]:
        return [p.alias(f"{n}__{i}") for n, a in self.aggs.items() for i, p in enumerate(a.partials)]

    def _merges(self) -> list[Column]:
        return [m(F.col(f"{n}__{i}")).alias(f"{n}__{i}") for n, a in self.aggs.items() for i, m in enumerate(a.merges)]

    def _finals(self) -> list[Column]:
        return [a.final(*[F.col(f"{n}__{i}") for i in range(len(a.partials))]).alias(n) for n, a in self.aggs.items()]

    def _holistic(self) -> bool:
        return any(isinstance(a, Holistic) for a in self.aggs.values())

    def _over_rows(self, rows: DataFrame, by: list) -> DataFrame:
        """Group rows that already carry their window."""
        if self._holistic():
            exprs = []
            for n, a in self.aggs.items():
                exprs.append(a.expr.alias(n) if isinstance(a, Holistic) else a.final(*a.partials).alias(n))
            return rows.groupBy(*by).agg(*exprs)
        return rows.groupBy(*by).agg(*self._partials())

    def _label(self, df: DataFrame) -> DataFrame:
        columns = ("kind", "measure", "label")
        kind, measure, label = (F.element_at(F.array(*[F.lit(getattr(s, c)) for s in self.specs]), F.col("spec") + 1) for c in columns)
        finals = [F.col(n) for n in self.aggs] if self._holistic() else self._finals()
        return df.select(*self.keys, kind.alias("window_type"), measure.alias("measure"), label.alias("spec"), "window_start", "window_end", *finals)

    def _time(self, specs: list[tuple[int, Window]]) -> DataFrame:
        by = [*self.keys, "spec", "window_start", "window_end"]
        t = F.col(self.t)
        if self._holistic() or len(specs) == 1 and specs[0][1].size == specs[0][1].slide:
            return self._over_rows(self.df.select("*", F.inline(windows_of(t, specs))), by)
        slices = self.df.withColumn("__s", slice_start(t, [s for _, s in specs])).groupBy(*self.keys, "__s").agg(*self._partials())
        return slices.select("*", F.inline(windows_of(F.col("__s"), specs))).groupBy(*by).agg(*self._merges())

    def _session(self, i: int, s: Session) -> DataFrame:
        stamp = F.timestamp_millis(F.col(self.t))
        rows = self.df.withColumn("__ts", stamp)
        out = self._over_rows(rows, [*self.keys, F.session_window("__ts", f"{s.gap} milliseconds").alias("w")])
        return out.withColumns({"spec": F.lit(i), "window_start": F.unix_millis("w.start"), "window_end": F.unix_millis("w.end")}).drop("w")

    def _count(self, i: int, s: Window) -> DataFrame:
        """Full windows of ``size`` rows in event-time order, from every ``slide``-th row on."""
        rows = rank_by_time(self.df, self.t, self.keys, self.ties).select("*", F.inline(windows_of(F.col("rn").cast("long"), [(i, s)]))).where("window_start >= 0")
        by = [*self.keys, "spec", "window_start", "window_end"]
        full = self._over_rows_with_count(rows, by)
        return full.where(F.col("__n") == s.size).drop("__n")

    def _over_rows_with_count(self, rows: DataFrame, by: list) -> DataFrame:
        if self._holistic():
            exprs = [a.expr.alias(n) if isinstance(a, Holistic) else a.final(*a.partials).alias(n) for n, a in self.aggs.items()]
        else:
            exprs = self._partials()
        return rows.groupBy(*by).agg(*exprs, F.count("*").alias("__n"))

    def run(self) -> DataFrame:
        if not self.specs or not self.aggs:
            raise ValueError("at least one window and one aggregate")
        numbered = list(enumerate(self.specs))
        fixed = [(i, s) for i, s in numbered if isinstance(s, Window) and s.measure == "time"]
        parts = [self._time(fixed)] if fixed else []
        parts += [self._session(i, s) for i, s in numbered if isinstance(s, Session)]
        parts += [self._count(i, s) for i, s in numbered if isinstance(s, Window) and s.measure == "count"]
        return self._label(reduce(lambda a, b: a.unionByName(b), parts))


def with_empty_windows(result: DataFrame, spec: Window, keys: list[str]) -> DataFrame:
    """A tumbling or sliding result with a row for every window between each key's first and last one."""
    span = result.groupBy(*keys).agg(F.min("window_start").alias("__a"), F.max("window_start").alias("__b"))
    every = span.select(*keys, F.explode(F.sequence("__a", "__b", F.lit(spec.slide).cast("long"))).alias("window_start"))
    own = [c for c in result.columns if c not in (*keys, "window_start", "window_end", "window_type", "measure", "spec")]
    full = every.join(result.select(*keys, "window_start", *own), [*keys, "window_start"], "left")
    return full.withColumn("window_end", F.col("window_start") + spec.size)
