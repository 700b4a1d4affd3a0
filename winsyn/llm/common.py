"""Shared helpers: tables, memory of workers, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_held: list[Callable[[], None]] = []


def held(clear: Callable[[], None]) -> None:
    """``clear`` empties what a module keeps in a worker from task to task."""
    _held.append(clear)


def give_back(but: Callable[[], None] | None = None) -> None:
    """A worker that turns to another operator keeps nothing of the last one: what modules hold is emptied, ``but`` one's own, and free memory
    that the allocators of Arrow and C keep goes back to the machine."""
    for clear in _held:
        if clear != but:
            clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has an edge in ``edges(a, b)``; component is the smallest node id.

    Alternates the large-star and small-star contractions, each of which rewires every edge to the
    smallest neighbour known, until the edges are stars around the components' minima. Every step is
    an aggregation with map-side combine and an equi-join, so a node with very many neighbours is
    split by the adaptive skew join; nothing reaches the driver but a checksum.
    """
    cur = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every edge now points from the larger to the smaller end
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.cut(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        cur = new
        if tuple(now) == before:
            break
        before = tuple(now)
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._winsyn_path = cur._winsyn_path
    return out
