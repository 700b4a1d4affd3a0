"""Tables, files and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import rank_by_time

TUPLE = "key int, value int, ts long"
RIDES = "ride_id long, kind string, started string, ended string, start_lon {f}, start_lat {f}, end_lon {f}, end_lat {f}, passengers short, taxi_id long, driver_id long"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with ``t``, milliseconds since the epoch whatever the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read_table(spark, sf_dir, "events").withColumn("t", F.floor(micros / 1000).cast("long"))


def read_csv(spark: SparkSession, path: str, schema: str = TUPLE) -> DataFrame:
    """Delimited text, compressed or not; rows that don't fit the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path)


def stream_csv(spark: SparkSession, path: str, schema: str = TUPLE, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def read_rides(spark: SparkSession, path: str, doubles: bool = False) -> DataFrame:
    """Taxi rides with an event time: the end of ENDed rides, the start of others."""
    rides = read_csv(spark, path, RIDES.format(f="double" if doubles else "float"))
    return rides.withColumn("t", F.unix_millis(F.to_timestamp(F.when(F.col("kind") == "END", F.col("ended")).otherwise(F.col("started")))))


def stamp_rows(df: DataFrame, order: list[str], first: int = 1517499757961, per_step: int = 10_000, step: int = 60_000) -> DataFrame:
    """Rows in a given order with a time that advances by ``step`` every ``per_step`` rows."""
    ranked = rank_by_time(df, order[0], [], order[1:])
    return ranked.withColumn("ts", first + ((F.col("rn") - F.pmod("rn", F.lit(per_step))) / per_step).cast("long") * step).drop("rn")


def uniform(spark: SparkSession, rows: int, strata: int = 0, seed: int = 42, per_ms: int = 1) -> DataFrame:
    """Keys from 0 to 100, or 1000 for each stratum; values from 0 to 9."""
    keys = 1000 * strata if strata else 101
    return spark.range(rows).select(F.floor(F.rand(seed) * keys).cast("int").alias("key"), F.floor(F.rand(seed + 1) * 10).cast("int").alias("value"), (F.col("id") / per_ms).cast("long").alias("ts"))


def normal(spark: SparkSession, rows: int, seed: int = 42, per_ms: int = 1) -> DataFrame:
    """Keys floor(3 N(0, 1) + 10), negative ones rejected."""
    key = F.floor(F.randn(seed) * 3 + 10).cast("int")
    return spark.range(rows).select(key.alias("key"), F.floor(F.rand(seed + 1) * 10).cast("int").alias("value"), (F.col("id") / per_ms).cast("long").alias("ts")).where("key >= 0")


def zipf(spark: SparkSession, rows: int, keys: int = 1000, exponent: float = 1.0, seed: int = 42, per_ms: int = 1) -> DataFrame:
    """Keys with probability about rank ** -exponent, by the inverse of the continuous distribution."""
    u = F.rand(seed)
    if exponent == 1.0:
        x = F.pow(F.lit(float(keys + 1)), u)
    else:
        e = 1 - exponent
        x = F.pow(u * ((keys + 1) ** e - 1) + 1, F.lit(1 / e))
    return spark.range(rows).select((F.floor(x) - 1).cast("int").alias("key"), F.floor(F.rand(seed + 1) * 10).cast("int").alias("value"), (F.col("id") / per_ms).cast("long").alias("ts"))


def gaps(spark: SparkSession, n: int, most: int, shortest: int, longest: int, seed: int = 333) -> DataFrame:
    """Random pauses (start, length), sorted."""
    return spark.range(n).select(F.floor(F.rand(seed) * most).cast("long").alias("start"), (F.floor(F.rand(seed + 444) * (longest - shortest)) + shortest).cast("long").alias("length")).orderBy("start")


def without_gaps(df: DataFrame, t: str, pauses: DataFrame) -> DataFrame:
    """Rows outside all pauses: a pause list is bounded by the caller, so it becomes a literal."""
    spans = [(r.start, r.start + r.length) for r in pauses.collect()]
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((F.col(t) >= a) & (F.col(t) < b))
    return df.where(~inside)


def out_of_order(df: DataFrame, t: str, probability: float, least: int, most: int, seed: int = 7) -> DataFrame:
    """Some rows late: ``arrival`` is the order in which to feed them."""
    late = F.when(F.rand(seed) < probability, F.floor(F.rand(seed + 1) * (most - least)) + least).otherwise(0)
    return df.withColumn("arrival", F.col(t) + late)


def quantile_queries(spark: SparkSession, n: int, strata: int = 0, first: int | None = None, step: int = 1, seed: int = 5) -> DataFrame:
    """Questions q in [0, 1), with a stratum and a time where asked for."""
    out = spark.range(n).select(F.col("id").alias("query_id"), F.rand(seed).alias("q"))
    if strata:
        out = out.withColumn("stratum", F.floor(F.rand(seed + 1) * strata).cast("int"))
    return out.withColumn("qt", first + F.col("query_id") * step) if first is not None else out


def rate_stream(spark: SparkSession, per_second: int) -> DataFrame:
    """A counter as ``value`` and its ``timestamp``."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(",", *df.columns)).write.mode("overwrite").text(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
