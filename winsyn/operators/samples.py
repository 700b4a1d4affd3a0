"""Samples as ranked relations: a sample of a union is the best of the union of the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .synopses import equi_depth, raw_hash


def _best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def reservoir(df: DataFrame, by: list[str], id_: str, n: int, seed: int = 1) -> DataFrame:
    """A uniform sample: the n least hashes of the id. Spark cuts each task's groups to n before the shuffle."""
    return _best(df, by, [raw_hash(F.col(id_), 7, seed), F.col(id_)], n)


def newest(df: DataFrame, by: list[str], t: str, id_: str, n: int) -> DataFrame:
    """The n latest rows."""
    return _best(df, by, [F.desc(t), F.desc(id_)], n)


def biased(df: DataFrame, by: list[str], t: str, id_: str, n: int, half_life: float, seed: int = 1) -> DataFrame:
    """Recency-biased without replacement: exponential keys whose rate doubles with each ``half_life`` of time."""
    u = (raw_hash(F.col(id_), 8, seed) + 1) / F.lit(2147483648.0)
    # log of -ln(u) / weight, so that no weight overflows
    key = F.log(-F.log(u)) - F.col(t) * F.lit(0.6931471805599453 / half_life)
    return _best(df, by, [key, F.col(id_)], n)


def merge_samples(a: DataFrame, b: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return _best(a.drop("rank").unionByName(b.drop("rank")), by, order, n)


def stratified(df: DataFrame, by: list[str], stratum: str, id_: str, n: int, seed: int = 1) -> DataFrame:
    """A reservoir for each stratum, each row with the number of rows that it stands for."""
    sample = reservoir(df, [*by, stratum], id_, n, seed)
    counts = df.groupBy(*by, stratum).agg(F.count("*").alias("seen"))
    return sample.join(counts, [*by, stratum]).withColumn("weight", F.greatest(F.col("seen") / n, F.lit(1.0)))


def sampled_equi_depth(df: DataFrame, by: list[str], v: str, id_: str, n: int, size: int, seed: int = 1) -> DataFrame:
    """(by, i, left_bound, right_bound, total), as ``equi_depth`` has it: inner boundaries from a reservoir of ``size`` rows, ends and total from all rows."""
    known = df.where(F.col(v).isNotNull())
    inner = equi_depth(reservoir(known, by, id_, size, seed), by, v, n).drop("right_bound", "total")
    ends = known.groupBy(*by).agg(F.min(v).cast("double").alias("low"), F.max(v).alias("right_bound"), F.count("*").alias("total"))
    both = inner.join(ends, by) if by else inner.join(F.broadcast(ends))  # one row
    return both.select(*by, "i", F.when(F.col("i") == 0, F.col("low")).otherwise(F.col("left_bound")).alias("left_bound"), "right_bound", "total")
