"""Aggregates as (partials, merges, final): what a slice stores, how slices combine, what a window shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """``partials`` aggregate rows; ``merges`` combine partial columns of the same place; ``final`` maps the merged ones."""

    partials: tuple[Column, ...]
    merges: tuple[Callable[[Column], Column], ...]
    final: Callable[..., Column]


@dataclass(frozen=True)
class Holistic:
    """An aggregate without a bounded partial: evaluated over the rows of each window."""

    expr: Column


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(agg: Agg, f: Callable[[Column], Column]) -> Agg:
    """The same with ``f`` applied to the result."""
    return Agg(agg.partials, agg.merges, lambda *x: f(agg.final(*x)))


def sum_(c: str | Column) -> Agg:
    """In the column's own type; sums of doubles depend on their order, those of decimals don't."""
    return Agg((F.sum(_column(c)),), (F.sum,), lambda s: s)


def count() -> Agg:
    return Agg((F.count("*"),), (F.sum,), lambda n: n)


def min_(c: str) -> Agg:
    return Agg((F.min(c),), (F.min,), lambda x: x)


def max_(c: str) -> Agg:
    return Agg((F.max(c),), (F.max,), lambda x: x)


def avg(c: str | Column) -> Agg:
    return Agg((F.sum(_column(c)), F.count(_column(c))), (F.sum, F.sum), lambda s, n: s.cast("double") / n)


def int_mean(c: str) -> Agg:
    """Integer division of an integer sum by the count."""
    return Agg((F.sum(F.col(c).cast("long")), F.count(c)), (F.sum, F.sum), lambda s, n: ((s - F.pmod(s, n)) / n).cast("long"))


def quantile(c: str, p: float) -> Holistic:
    return Holistic(F.expr(f"percentile_disc({p}) within group (order by {c})"))


def approx_quantile(c: str, p: float) -> Agg:
    """Mergeable: a KLL sketch in each slice."""
    return Agg((F.expr(f"kll_sketch_agg_double(cast({c} as double))"),), (lambda x: F.call_function("kll_merge_agg_double", x),), lambda x: F.call_function("kll_sketch_get_quantile_double", x, F.lit(float(p))))


def distinct(c: str) -> Agg:
    """Mergeable: an HLL sketch in each slice."""
    return Agg((F.hll_sketch_agg(c),), (lambda x: F.hll_union_agg(x),), lambda x: F.hll_sketch_estimate(x))


def user_defined(lift: Callable[[Column], Column], combine: Callable[[Column], Column], lower: Callable[[Column], Column], c: str) -> Agg:
    """``lift`` aggregates a column, ``combine`` aggregates partials, ``lower`` gives the result."""
    return Agg((lift(F.col(c)),), (combine,), lower)
