"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (op 6).

Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
``COSINE``. Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing.

1. Rows with equal label and vector form one node with a count, so that copies are one row from here on.
2. Iterative quantisation learns, for each vector length, a rotation of the principal axes that balances the signs, from a
   sample of at most ``SAMPLE`` nodes in hash order; every node is coded with it. The code has up to 64 bits.
3. Codes are cut into ``TABLES`` parts. Two nodes are candidates if some part differs in at most two bits, which holds for every
   pair within 3 * TABLES - 1 bits of each other and most beyond: both sides bring their parts and all single-bit variants,
   and of the ways in which a part can meet one counts. Candidates further than ``RADIUS`` bits apart are dropped.
4. The original vectors decide.

Counts of links count rows. Rows with a null id belong to their group and never name it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table
from .topk_search import usable

COSINE, SAMPLE, TABLES, RADIUS, BITS, ROUNDS = 0.98, 20_000, 4, 16, 64, 40


def learn_rotation(x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of iterative quantisation for rows of unit length."""
    bits = min(BITS, x.shape[1])
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.Generator(np.random.PCG64(1)).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = w.T @ u.T
    return mean, axes @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = ((x - mean) @ projection >= 0).astype(np.uint64)
    return (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat components of vectors scaled to unit length."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    scale = np.maximum.reduceat(np.abs(flat), starts) if len(flat) else np.zeros(0)
    flat = flat / np.repeat(scale, sizes)  # against overflow of the squares
    return sizes, flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes) if len(flat) else flat


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: its id, ``n_links, component_id, kept``."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    value = F.col(vec).cast("array<double>")
    good = usable(vec) & F.exists(value, lambda x: x != 0) & F.col(label).isNotNull()
    good = F.coalesce(good, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.when(good, value).alias("v"), good.alias("good"))
    rows = scratch.cut(rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", "v"))), "rows")
    live = rows.where("good")
    nodes = live.groupBy("node").agg(F.count("*").alias("many"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.cut(nodes, "nodes")
    sample: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node")).select("v").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    learned = {}
    for dim, vs in sample.items():
        x = np.array(vs, np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        if len(x) > 1:
            learned[dim] = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True))

    def code(batches):
        for b in batches:
            sizes, flat = _units(b.column(b.schema.get_field_index("v")))
            starts, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                # a length that the sample lacks gets signs of the leading components
                mean, projection = learned.get(int(dim), (np.zeros(dim), np.eye(dim)[:, : min(BITS, dim)]))
                out[at] = codes(flat[starts[at][:, None] + np.arange(dim)], mean, projection)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), b.column(b.schema.get_field_index("label")), pa.array(sizes, pa.int32()), pa.array(out)], names=["node", "label", "dim", "code"])

    kind = nodes.schema["label"].dataType.simpleString()
    coded = scratch.cut(nodes.select("node", "label", "v").mapInArrow(code, f"node long, label {kind}, dim int, code long"), "codes")
    width = BITS // TABLES
    in_tables = coded.withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(width)])
    part = F.expr(f"(shiftrightunsigned(code, t * {width}) & {(1 << width) - 1}L) ^ flip")
    held, asked = (in_tables.withColumn("flip", F.explode(flips)).select("label", "dim", "t", part.alias("part"), F.col("node").alias(n), F.col("code").alias(f"code_{n}"), F.col("flip").alias(f"flip_{n}")) for n in "ab")
    once = (F.col("flip_a") == 0) | (F.col("flip_a") < F.col("flip_b"))
    near = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= RADIUS
    pairs = held.join(asked, ["label", "dim", "t", "part"]).where((F.col("a") < F.col("b")) & once & near).select("a", "b").distinct()
    vectors = nodes.select("node", "v")
    loaded = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("v_a")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("v_b")), "b").select("a", "b", "v_a", "v_b")

    def verify(batches):
        for b in batches:
            sizes, x = _units(b.column(2))
            _, y = _units(b.column(3))
            if not len(sizes):
                continue
            cos = np.add.reduceat(x * y, np.cumsum(sizes) - sizes)
            keep = pa.array(cos >= cosine)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    links = scratch.cut(loaded.mapInArrow(verify, "a long, b long"), "links")
    parts = connected_components(links, scratch)
    many = nodes.select(F.col("node").alias("b"), "many")
    both = links.union(links.select("b", "a"))
    beside = both.toDF("node", "b").join(many, "b").groupBy("node").agg(F.sum("many").alias("others"))
    groups = nodes.select("node", "many", "least").join(parts, "node", "left").join(beside, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node")).withColumn("n_links", F.col("many") - 1 + F.coalesce("others", F.lit(0)))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(names, "component").select("node", "n_links", "component_id")
    out = rows.select("id", "node", "good").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
