"""Projection, stratification and routing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.engine import rank_by_time


def stratify(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn("stratum", F.col(c).cast("string"))


def range_stratum(c: Column, strata: int, span: float = 100.0) -> Column:
    """Equal ranges of [0, span); larger values join the last one."""
    return F.least(F.floor(c / span * strata), F.lit(strata - 1)).cast("long")


def block_stratum(c: Column, size: int = 1000) -> Column:
    return ((c - F.pmod(c, F.lit(size))) / size).cast("long")


def capped_stratum(c: Column, strata: int) -> Column:
    return F.least(c, F.lit(strata - 1)).cast("long")


def modulo_stratum(c: Column, strata: int) -> Column:
    return F.pmod(c, F.lit(strata)).cast("long")


def with_timestamp(df: DataFrame, value: str, t: str | None = None) -> DataFrame:
    """The value with its event time, or with the processing time where there is none."""
    now = F.unix_millis(F.current_timestamp())
    return df.withColumn("element", F.struct(F.col(value).alias("value"), F.coalesce(F.col(t), now).alias("ts") if t else now.alias("ts")))


def parallel_index(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.spark_partition_id())


def round_robin(df: DataFrame, t: str, keys: list[str], ties: list[str], parts: int) -> DataFrame:
    """Rows dealt in turn, in event-time order: ``part`` and the ordinal ``local`` within it."""
    ranked = rank_by_time(df, t, keys, ties)
    part = F.pmod(F.col("rn"), F.lit(parts))
    return ranked.withColumns({"part": part.cast("int"), "local": ((F.col("rn") - part) / parts).cast("long")}).drop("rn")
