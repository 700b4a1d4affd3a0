"""Two-pass external shuffle into shards (op 5).

Law ``key``: a row's shard follows from its id and the number of shards alone, by rendezvous hashing: each shard gets a seeded
hash of the id and the largest wins, so that one more shard takes rows only into itself.

Pass one scatters whole rows by another seeded hash, uniformly, into buckets that fit in memory (``BUCKET_BYTES``; their
number follows from the shards' sizes). Pass two shuffles each bucket by Fisher-Yates, from a seed of its own and a fixed
starting order, and writes it behind the shard's earlier buckets. The result depends on the rows and the seed only, so
a task that runs again writes the same rows. Null ids and null texts are values like any other; rows that are
equal in every column are interchangeable. Columns that clash with a result column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

SHARDS, SEED = 24, 11
BUCKET_BYTES = 8 << 20


def shard_of(id_col: str, shards: int, seed: int = SEED):
    """The shard with the largest seeded hash."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def shuffle_into_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the rows below ``path``, a folder for each shard, with ``size``, ``slot`` and ``grown_shard`` added."""
    columns = [c for c in df.columns if c not in ("shard", "slot", "size", "grown_shard", "__bucket", "__at")]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    placed = df.select(*columns, size.alias("size"), shard_of(id_col, shards, seed).alias("shard"), shard_of(id_col, shards + 1, seed).alias("grown_shard"))
    sizes = dict(placed.groupBy("shard").agg(F.sum("size")).collect())  # a row for each shard
    buckets = [max(1, math.ceil(sizes.get(s, 0) / BUCKET_BYTES)) for s in range(shards)]
    many = F.element_at(F.array(*[F.lit(b) for b in buckets]), F.col("shard") + 1)
    dealt = placed.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text)), many).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__bucket").agg(F.count("*").alias("n")).select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    out = T.StructType([*dealt.schema, T.StructField("__at", T.LongType())])

    def fisher_yates(rows: pa.Table) -> pa.Table:
        keys = [rows.column(c).to_pylist() for c in (id_col, text)]
        order = sorted(range(len(rows)), key=lambda i: (keys[0][i] is None, keys[0][i] or 0, keys[1][i] is None, keys[1][i] or ""))
        rng = np.random.Generator(np.random.PCG64([seed, rows.column("shard")[0].as_py(), rows.column("__bucket")[0].as_py()]))
        rows = rows.take(pa.array(np.array(order, np.int64)[rng.permutation(len(rows))]))
        return rows.append_column("__at", pa.array(np.arange(len(rows)), pa.int64())).cast(schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    shuffled = dealt.groupBy("shard", "__bucket").applyInArrow(fisher_yates, out).join(starts, ["shard", "__bucket"])
    shuffled = shuffled.withColumn("slot", F.col("__start") + F.col("__at")).drop("__start", "__at", "__bucket")
    shuffled.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "shards").path("shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shuffle_into_shards(docs, path)
    schema = "doc_id long, text string, size long, grown_shard int, slot long, shard int"
    back = spark.read.schema(schema).parquet(path)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return back.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
