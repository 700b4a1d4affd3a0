"""Synopses as relations: each is a table of counters by window, so that it merges, inverts and can be checked by SQL.

Hashes are of the form ((a x + b) mod (2^31 - 1)) mod w for non-negative integers below 2^31; strings become integers by
their MD5's first 32 bits. Function r of a seed takes its a and b from a seeded generator.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIME = 2147483647


def coefficients(r: int, seed: int = 1) -> tuple[int, int]:
    rnd = random.Random(seed * 1000 + r)
    return rnd.randrange(1, PRIME), rnd.randrange(PRIME)


def raw_hash(x: Column, r: int, seed: int = 1) -> Column:
    a, b = coefficients(r, seed)
    return F.pmod(x.cast("long") * F.lit(a).cast("long") + F.lit(b).cast("long"), F.lit(PRIME).cast("long"))


def mixed_hash(x: Column, r: int, seed: int = 1) -> Column:
    """Two rounds with a fold of the high bits between: runs of integers leave no pattern in single bits."""
    y = raw_hash(x, r, seed)
    return raw_hash(y.bitwiseXOR(F.shiftright(y, 15)), r + 900, seed)


def bucket_hash(x: Column, r: int, width: int, seed: int = 1) -> Column:
    return F.pmod(raw_hash(x, r, seed), F.lit(width).cast("long"))


def string_key(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def _per_row(x: Column, rows: int, width: int, seed: int, **more) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("r"), bucket_hash(x, r, width, seed).alias("bucket"), *[f(r).alias(n) for n, f in more.items()]) for r in range(rows)]))


# -- Count-Min

def count_min(df: DataFrame, by: list[str], x: str, width: int, rows: int, seed: int = 1) -> DataFrame:
    """(by, r, bucket, cnt)."""
    # equal items first: one row for each distinct item reaches the explosion
    items = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    return items.select(*by, "n", _per_row(F.col(x), rows, width, seed).alias("c")).groupBy(*by, "c.r", "c.bucket").agg(F.sum("n").alias("cnt"))


def count_min_merge(a: DataFrame, b: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """Cell by cell a + sign * b; sign -1 takes b's rows out again."""
    return a.unionByName(b.withColumn("cnt", F.col("cnt") * sign)).groupBy(*by, "r", "bucket").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def count_min_point(cells: DataFrame, queries: DataFrame, by: list[str], x: str, width: int, rows: int, seed: int = 1) -> DataFrame:
    """Estimate for each query row (by, x): the least of its cells, 0 for a missing one."""
    asked = queries.select(*by, x, _per_row(F.col(x), rows, width, seed).alias("c")).select(*by, x, "c.r", "c.bucket")
    return asked.join(cells, [*by, "r", "bucket"], "left").groupBy(*by, x).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


# -- HyperLogLog

def hll_registers(df: DataFrame, by: list[str], x: str, log_m: int, seed: int = 1) -> DataFrame:
    """(by, reg, rho): the largest position of the lowest set bit of the hash beyond the register's index."""
    if not 4 <= log_m <= 16:
        raise ValueError("log_m from 4 to 16")
    m = 1 << log_m
    h = mixed_hash(F.col(x), 0, seed)
    rest = F.shiftright(h, log_m)
    rho = F.when(rest == 0, F.lit(31 - log_m + 1)).otherwise(F.bit_count(rest.bitwiseAND(-rest) - 1) + 1)
    return df.where(F.col(x).isNotNull()).groupBy(*by, F.pmod(h, F.lit(m).cast("long")).alias("reg")).agg(F.max(rho).alias("rho"))


def hll_merge(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "reg").agg(F.max("rho").alias("rho"))


def hll_estimate(registers: DataFrame, by: list[str], log_m: int) -> DataFrame:
    m = 1 << log_m
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*by).agg((F.sum(F.pow(F.lit(2.0), -F.col("rho"))) + (m - F.count("*"))).alias("s"), (m - F.count("*")).alias("zeros"))
    raw = F.lit(alpha * m * m) / F.col("s")
    return sums.select(*by, F.when((F.col("zeros") > 0) & (raw < 2.5 * m), m * F.log(m / F.col("zeros"))).otherwise(raw).alias("estimate"))


# -- Bloom

def bloom_k(max_elements: int, bits: int) -> int:
    return max(1, round(math.log(2) * bits / max_elements))


def bloom(df: DataFrame, by: list[str], x: str, max_elements: int, bits: int, seed: int = 1) -> DataFrame:
    """(by, bit): the bits that are set. Partitioned builds merge by union; see ``bloom_intersect``."""
    items = df.where(F.col(x).isNotNull()).select(*by, x).distinct()
    return items.select(*by, _per_row(F.col(x), bloom_k(max_elements, bits), bits, seed).alias("c")).select(*by, F.col("c.bucket").alias("bit")).distinct()


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def bloom_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def bloom_probe(filter_: DataFrame, probes: DataFrame, by: list[str], x: str, max_elements: int, bits: int, seed: int = 1) -> DataFrame:
    """(by, x, found) for each distinct probe."""
    k = bloom_k(max_elements, bits)
    asked = probes.select(*by, x).distinct().select(*by, x, _per_row(F.col(x), k, bits, seed).alias("c")).select(*by, x, F.col("c.bucket").alias("bit")).distinct()
    hit = filter_.withColumn("hit", F.lit(1))
    return asked.join(hit, [*by, "bit"], "left").groupBy(*by, x).agg((F.count("hit") == F.count("*")).alias("found"))


# -- Cuckoo filter: fingerprints counted at the lesser of their two buckets; no kicks, never full

def _cuckoo(x: Column, buckets: int, seed: int) -> tuple[Column, Column]:
    fp = F.pmod(raw_hash(x, 1, seed), F.lit(255)) + 1
    one = bucket_hash(x, 0, buckets, seed)
    other = F.pmod(bucket_hash(fp, 2, buckets, seed) - one, F.lit(buckets).cast("long"))
    return fp, F.least(one, other)


def cuckoo(df: DataFrame, by: list[str], x: str, buckets: int, seed: int = 1, sign: int = 1) -> DataFrame:
    """(by, fp, bucket, cnt); ``sign`` -1 makes deletions."""
    fp, bucket = _cuckoo(F.col(x), buckets, seed)
    return df.where(F.col(x).isNotNull()).groupBy(*by, fp.alias("fp"), bucket.alias("bucket")).agg((F.count("*") * sign).alias("cnt"))


def cuckoo_merge(*parts: DataFrame, by: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, "fp", "bucket").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def cuckoo_lookup(filter_: DataFrame, probes: DataFrame, by: list[str], x: str, buckets: int, seed: int = 1) -> DataFrame:
    fp, bucket = _cuckoo(F.col(x), buckets, seed)
    asked = probes.select(*by, x).distinct().withColumns({"fp": fp, "bucket": bucket})
    return asked.join(filter_, [*by, "fp", "bucket"], "left").select(*by, x, F.coalesce(F.col("cnt") > 0, F.lit(False)).alias("found"))


# -- DDSketch

def dd_gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def dd_sketch(df: DataFrame, by: list[str], v: str, accuracy: float, max_bins: int) -> DataFrame:
    """(by, bin, cnt); zeros have a null bin. Beyond ``max_bins`` the lowest bins fold into the lowest that stays."""
    log_gamma = math.log(dd_gamma(accuracy))
    bad = F.raise_error(F.lit("negative value in a DDSketch"))
    bin_ = F.when(F.col(v) < 0, bad.cast("long")).when(F.col(v) > 0, F.floor(F.log(F.col(v).cast("double")) / F.lit(log_gamma)))
    return dd_collapse(df.where(F.col(v).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("cnt")), by, max_bins)


def dd_collapse(bins: DataFrame, by: list[str], max_bins: int) -> DataFrame:
    top = W.partitionBy(*by).orderBy(F.desc_nulls_last("bin"))
    ranked = bins.withColumn("k", F.row_number().over(top))
    floor_ = F.min(F.when(F.col("k") <= max_bins, F.col("bin"))).over(W.partitionBy(*by))
    # greatest() passes over nulls, and zeros must stay apart
    folded = F.when(F.col("bin").isNotNull(), F.greatest("bin", floor_))
    return ranked.withColumn("bin", folded).groupBy(*by, "bin").agg(F.sum("cnt").alias("cnt"))


def dd_merge(a: DataFrame, b: DataFrame, by: list[str], max_bins: int, sign: int = 1) -> DataFrame:
    both = a.unionByName(b.withColumn("cnt", F.col("cnt") * sign)).groupBy(*by, "bin").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
    return dd_collapse(both, by, max_bins)


def dd_quantile(bins: DataFrame, by: list[str], q: float, accuracy: float) -> DataFrame:
    """The value of the first bin whose cumulated count exceeds floor(q (n - 1))."""
    gamma = dd_gamma(accuracy)
    order = W.partitionBy(*by).orderBy(F.asc_nulls_first("bin"))
    run = bins.withColumn("upto", F.sum("cnt").over(order)).withColumn("n", F.sum("cnt").over(W.partitionBy(*by)))
    hit = run.where(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1))).groupBy(*by).agg(F.min(F.struct("upto", "bin")).alias("s"))
    return hit.select(*by, F.when(F.col("s.bin").isNull(), 0.0).otherwise(F.pow(F.lit(gamma), F.col("s.bin")) * (1 + accuracy)).alias("quantile"))


def dd_equi_depth(bins: DataFrame, by: list[str], n: int, accuracy: float) -> DataFrame:
    """(by, i, left_bound, right_bound, total), as ``equi_depth`` has it, from the quantiles i / n of a DDSketch."""
    order = W.partitionBy(*by).orderBy(F.asc_nulls_first("bin"))
    run = bins.withColumn("upto", F.sum("cnt").over(order)).withColumn("total", F.sum("cnt").over(W.partitionBy(*by)))
    ranked = run.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("i"))
    rank = F.floor(F.col("i") * (F.col("total") - 1) / n)
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(dd_gamma(accuracy)), F.col("bin")) * (1 + accuracy))
    cuts = ranked.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("cnt"))).select(*by, "i", value.alias("left_bound"), "total")
    last = F.max(F.when(F.col("i") == n, F.col("left_bound"))).over(W.partitionBy(*by))
    return cuts.withColumn("right_bound", last).where(F.col("i") < n).select(*by, "i", "left_bound", "right_bound", "total")


# -- Fast-AGMS

def agms(df: DataFrame, by: list[str], x: str, width: int, rows: int, seed: int = 1) -> DataFrame:
    """(by, r, bucket, cell)."""
    items = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    sign = lambda r: 1 - 2 * F.pmod(raw_hash(F.col(x), r + 500, seed), F.lit(2))
    return items.select(*by, "n", _per_row(F.col(x), rows, width, seed, sign=sign).alias("c")).groupBy(*by, "c.r", "c.bucket").agg(F.sum(F.col("n") * F.col("c.sign")).alias("cell"))


def agms_merge(a: DataFrame, b: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    return a.unionByName(b.withColumn("cell", F.col("cell") * sign)).groupBy(*by, "r", "bucket").agg(F.sum("cell").alias("cell"))


def agms_f2(cells: DataFrame, by: list[str], width: int, rows: int) -> DataFrame:
    """Second moment (upper median of the rows), its error bound and the probability of exceeding it."""
    per_row = cells.groupBy(*by, "r").agg(F.sum(F.col("cell") * F.col("cell")).alias("f2"))
    median = F.element_at(F.array_sort(F.collect_list("f2")), rows // 2 + 1)  # ``rows`` values
    return per_row.groupBy(*by).agg(median.alias("f2")).select(*by, "f2", F.round(F.col("f2") / math.sqrt(width), 6).alias("error_bound"), F.lit(2.0**-rows).alias("error_probability"))


# -- Equi-width

def equi_width(df: DataFrame, by: list[str], v: str, low: float, high: float, n: int) -> DataFrame:
    """(by, bucket, cnt) over [low, high); values outside are ignored."""
    if not low < high or n < 1:
        raise ValueError("low < high and at least one bucket")
    step = (high - low) / n
    inside = df.where((F.col(v) >= low) & (F.col(v) < high))
    bucket = F.least(F.floor((F.col(v) - low) / F.lit(step)), F.lit(n - 1)).cast("long")
    return inside.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def equi_width_merge(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "bucket").agg(F.sum("cnt").alias("cnt"))


def equi_width_range(cells: DataFrame, by: list[str], low: float, high: float, n: int, a: float, b: float) -> DataFrame:
    """Estimated count in [a, b): buckets count by the share of them that lies inside."""
    step = (high - low) / n
    left = F.lit(low) + F.col("bucket") * step
    share = F.greatest(F.lit(0.0), F.least(F.lit(float(b)), left + step) - F.greatest(F.lit(float(a)), left)) / step
    return cells.groupBy(*by).agg(F.sum(F.col("cnt") * share).alias("estimate"))


def four_level_code(cells: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """(by, code): a 32-bit tree over 8 buckets: shares of the left children in 6, 5, 5 and four times 4 bits."""
    f = [F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("cnt"))), F.lit(0)) for k in range(n)]
    wide = cells.groupBy(*by).agg(*[f[k].alias(f"f{k}") for k in range(n)])
    return wide.select(*by, _four_level([F.col(f"f{k}") for k in range(n)]).alias("code"))


def _four_level(f: list[Column]) -> Column:
    def share(part, whole, most):
        return F.when(whole == 0, 0).otherwise(F.floor(F.lit(most) * part / whole + 0.5)).cast("long")

    total = lambda a, b: sum(f[a + 1 : b], f[a])
    code = share(total(0, 4), total(0, 8), 63) * (1 << 26) + share(total(0, 2), total(0, 4), 31) * (1 << 21) + share(total(4, 6), total(4, 8), 31) * (1 << 16)
    for k, place in zip((0, 2, 4, 6), (12, 8, 4, 0)):
        code = code + share(f[k], f[k] + f[k + 1], 15) * (1 << place)
    return code


def four_level_range(code: Column, total: Column, low: float, high: float, a: float, b: float) -> Column:
    """Estimated count in [a, b) from a code word and the total: leaves by the decoded shares, linear within a leaf."""
    bits = lambda place, n: F.shiftrightunsigned(code, place).bitwiseAND(F.lit((1 << n) - 1)) / ((1 << n) - 1)
    half = bits(26, 6)
    quarters = [half * bits(21, 5), half * (1 - bits(21, 5)), (1 - half) * bits(16, 5), (1 - half) * (1 - bits(16, 5))]
    leaves = []
    for q, place in zip(quarters, (12, 8, 4, 0)):
        leaves += [q * bits(place, 4), q * (1 - bits(place, 4))]
    step = (high - low) / 8
    shares = [max(0.0, min(b, low + (k + 1) * step) - max(a, low + k * step)) / step for k in range(8)]
    return total * sum((leaf * s for leaf, s in zip(leaves[1:], shares[1:])), leaves[0] * shares[0])


# -- Equi-depth

def equi_depth(df: DataFrame, by: list[str], v: str, n: int) -> DataFrame:
    """(by, i, left_bound, right_bound, total): exact boundaries, each bucket holding total / n rows.

    The boundary in a value's run of equals is interpolated towards the next value.
    """
    freq = df.where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("f"))
    order = W.partitionBy(*by).orderBy(v)
    run = freq.withColumn("upto", F.sum("f").over(order)).withColumn("next", F.lead(v).over(order)).withColumn("total", F.sum("f").over(W.partitionBy(*by)))
    run = run.withColumn("size", F.col("total") / n).withColumn("before", F.col("upto") - F.col("f"))
    first = F.floor(F.col("before") / F.col("size")) + 1
    last = F.least(F.floor(F.col("upto") / F.col("size")), F.lit(n - 1))
    inner = run.where(last >= first).select(*by, F.explode(F.sequence(first, last)).alias("i"), v, "next", "upto", "size", "total")
    beyond = F.least((F.col("upto") - F.col("i") * F.col("size")) / F.col("size"), F.lit(1.0))
    inner = inner.select(*by, "i", (F.col(v) + (1 - beyond) * (F.coalesce("next", v) - F.col(v))).alias("left_bound"))
    ends = freq.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("right_bound"), F.sum("f").alias("total"))
    bounds = inner.unionByName(ends.select(*by, F.lit(0).cast("long").alias("i"), F.col("low").cast("double").alias("left_bound")))
    if by:
        return bounds.join(ends.select(*by, "right_bound", "total"), by)
    return bounds.join(F.broadcast(ends.select("right_bound", "total")))  # one row


def equi_depth_range(bounds: DataFrame, by: list[str], a: float, b: float) -> DataFrame:
    """Estimated count in [a, b]: full buckets and linear shares of the outer ones; reversed ranges are an error."""
    if a > b:
        raise ValueError("reversed range")
    right = F.coalesce(F.lead("left_bound").over(W.partitionBy(*by).orderBy("i")), F.col("right_bound"))
    cells = bounds.withColumn("right", right).withColumn("n", F.count("*").over(W.partitionBy(*by)))
    width = F.col("right") - F.col("left_bound")
    overlap = F.least(F.lit(float(b)), F.col("right")) - F.greatest(F.lit(float(a)), F.col("left_bound"))
    share = F.when(width > 0, F.greatest(F.lit(0.0), overlap) / width).when((F.col("left_bound") >= a) & (F.col("left_bound") <= b), 1.0).otherwise(0.0)
    return cells.groupBy(*by).agg(F.sum(share * F.col("total") / F.col("n")).alias("estimate"))
