"""Exact top-k by tiled matrix products (op 4).

Vectors are packed into tiles of a few thousand rows. Queries are dealt into blocks and tiles into groups; each
(block, group) is one task that multiplies the block with the group's tiles one by one, keeps each query's k best of a
tile by partial selection, and merges them into its list. The lists of the groups then meet in a tree of at most
``FAN_IN`` lists a step. Queries are a stated set and grow with the table, so nothing is broadcast: blocks and
groups are both shuffled, and a task holds one of each.

Scores are exact integers: products run in double precision while no sum can reach 2**53, and otherwise in Python's
integers, clipped to the range of a long. Vectors that are null, hold null or non-finite components or have no
id take no part; only vectors of one length meet. Every row but the query's own is a candidate, rows
with equal ids and equal vectors too. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TILE, GROUP, BLOCK, FAN_IN = 4096, 16384, 1024, 32


def usable(vec: str):
    """Condition: no null vector and no null or non-finite component."""
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def _pack(batches):
    """Rows to tiles: ids and integer components, end to end."""
    held: dict[int, list] = {}

    def tile(dim, parts):
        ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([data[order].tobytes()], pa.binary())], names=["dim", "n", "ids", "data"]
        )

    for batch in batches:
        ids, vec = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, sizes = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(vec.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            data = np.floor(256 * flat[starts[rows][:, None] + np.arange(dim)])
            for k in range(0, len(rows), TILE):
                parts = held.setdefault(int(dim), [])
                parts.append((ids[rows[k : k + TILE]].astype(np.int64), data[k : k + TILE]))
                if sum(len(p[0]) for p in parts) >= TILE:
                    yield tile(int(dim), held.pop(int(dim)))
    for dim, parts in held.items():
        yield tile(dim, parts)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2.0**53:
        whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1).astype(np.int64)
    return (q @ c.T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by partial selection; ids[row or 0, column] break ties."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        out_s, out_i = np.empty((len(scores), k), np.int64), np.empty((len(scores), k), np.int64)
        for r in range(len(scores)):
            at = np.flatnonzero(scores[r] >= least[r])
            own = ids[r if len(ids) > 1 else 0][at]
            pick = np.lexsort((own, -scores[r][at].astype(np.float64) if abs(least[r]) < 2**53 and abs(scores[r][at]).max() < 2**53 else np.array([-int(v) for v in scores[r][at]], dtype=object)))[:k]
            out_s[r], out_i[r] = scores[r][at][pick], own[pick]
        return out_s, out_i
    return scores, np.broadcast_to(ids, scores.shape)


def top_k(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", every: int = 50, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = df.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    tiles = scratch.cut(rows.mapInArrow(_pack, "dim int, n long, ids binary, data binary").withColumn("tile", F.expr("uuid()")), "tiles")
    size = tiles.agg(F.sum("n"), F.count("*")).first()
    groups = max(1, -(-(size[0] or 0) // GROUP))

    def ask(batches):
        for b in batches:
            for dim, n, ids, data, tile in zip(*(b.column(c).to_pylist() for c in ("dim", "n", "ids", "data", "tile"))):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                data = np.frombuffer(data, np.float64).reshape(n, dim)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array(ids[at]), pa.array([tile] * len(at)), pa.array(at, pa.int64()), pa.array([data[i].tobytes() for i in at], pa.binary())], names=["dim", "query_id", "own_tile", "own_row", "data"])

    queries = scratch.cut(tiles.mapInArrow(ask, "dim int, query_id long, own_tile string, own_row long, data binary"), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("own_tile", "own_row"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "block", "part"]

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if len(q) and len(c):
            dim = q.column("dim")[0].as_py()
            matrix = np.frombuffer(b"".join(q.column("data").to_pylist()), np.float64).reshape(len(q), dim)
            own_tile, own_row = np.array(q.column("own_tile").to_pylist()), q.column("own_row").to_numpy()
            lists = [([], []) for _ in range(len(q))]
            for n, ids, data, tile in zip(*(c.column(x).to_pylist() for x in ("n", "ids", "data", "tile"))):
                ids = np.frombuffer(ids, np.int64)
                scores = products(matrix, np.frombuffer(data, np.float64).reshape(n, dim))
                # a query's own row leaves its list after selection, so one more is selected
                s, i = best(scores, np.arange(n)[None, :], k + 1)
                mine = own_tile == tile
                for r in range(len(q)):
                    ok = ~(mine[r] & (i[r] == own_row[r]))
                    lists[r][0].append(s[r][ok])
                    lists[r][1].append(ids[i[r][ok]])
            for r, (s, i) in enumerate(lists):
                s, i = best(np.concatenate(s)[None, :], np.concatenate(i)[None, :], k)
                out += [(r, int(x), int(y)) for x, y in zip(i[0], s[0])]
        at = pa.array([o[0] for o in out], pa.int64())
        return pa.table(
            [q.column("query_id").take(at), q.column("own_tile").take(at), q.column("own_row").take(at), pa.array([0 if not len(q) else q.column("part")[0].as_py()] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
            names=["query_id", "own_tile", "own_row", "part", "id", "score"],
        )

    lists = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(search, "query_id long, own_tile string, own_row long, part int, id long, score long")
    while True:
        last = groups <= FAN_IN
        groups = -(-groups // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        order = Window.partitionBy("own_tile", "own_row", "query_id", "part").orderBy(F.desc("score"), "id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if last:
            return lists.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
