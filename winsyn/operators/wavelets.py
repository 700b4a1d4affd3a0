"""Haar wavelets as relations.

Level by level, pairs of neighbours become their average, and half their difference is the coefficient. A last element
without a partner passes to the next level unchanged, so coefficients exist for true pairs only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch

STEP = 8  # levels of a layer


def levels_of(df: DataFrame, idx: str) -> int:
    """Levels that the longest sequence needs."""
    return max(1, int(df.agg(F.max(idx)).first()[0] or 0).bit_length())


def _layers(levels: int) -> list[tuple[int, int]]:
    """First level and number of levels of each layer."""
    return [(first, min(STEP, levels - first)) for first in range(0, levels, STEP)]


def _held(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that later expressions refer to and do not compute again: a generator of one row keeps them apart."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _filled(entries, size: int | None = None):
    """The sorted array of structs (at, ..) with each at its place: nulls for places that are left out."""
    last = F.element_at(entries, -1)["at"] if size is None else F.lit(size - 1)
    by_place = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["at"], e)))
    filled = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.try_element_at(by_place, i))
    return F.when(F.size(entries) == last + 1, entries).otherwise(filled)


def _pairs(nodes):
    """The next level of an array of (at, a, n): each pair's ends, average and leaves."""

    def pair(i):
        left, right = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        avg = F.when(right["a"].isNull(), left["a"]).otherwise((left["a"] + right["a"]) / 2)
        return F.struct(i.alias("at"), avg.alias("a"), (F.coalesce(left["n"], F.lit(0)) + F.coalesce(right["n"], F.lit(0))).alias("n"), left["a"].alias("l"), right["a"].alias("r"), left["n"].alias("nl"), right["n"].alias("nr"))

    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), pair)


def haar(df: DataFrame, by: list[str], idx: str, v: str, levels: int, scratch: Scratch | None = None) -> DataFrame:
    """(by, level, node, coeff, leaves_left, leaves_right) and, at ``level`` = ``levels``, each root's average as ``coeff``.

    ``levels``: at least the binary logarithm of the longest sequence. ``STEP`` levels at a time are computed within arrays of up to
    2 ** ``STEP`` neighbours, so that the plan has one shuffle for each such layer and not one for each level. With ``scratch`` each layer
    is written once, so that the plan of the result, which reads every layer, does not repeat those below it.
    """
    cur = df.select(*by, F.col(idx).cast("long").alias("node"), F.col(v).cast("double").alias("a"), F.lit(1).cast("long").alias("n"))
    out = []
    for first, many in _layers(levels):
        at = F.pmod("node", F.lit(1 << many)).cast("int").alias("at")
        block = cur.groupBy(*by, F.shiftright("node", many).alias("block")).agg(F.sort_array(F.collect_list(F.struct(at, "a", "n"))).alias("entries"))
        block = _held(block, level_0=_filled(F.col("entries"))).drop("entries")
        for k in range(many):
            block = _held(block, **{f"level_{k + 1}": _pairs(F.col(f"level_{k}"))})
        node = lambda k: lambda p: F.struct(F.lit(first + k).alias("level"), (F.shiftleft("block", many - k - 1) + p["at"]).alias("node"), (p["l"] - p["a"]).alias("coeff"), p["nl"].alias("leaves_left"), p["nr"].alias("leaves_right"))
        made = [F.transform(F.filter(f"level_{k + 1}", lambda p: p["r"].isNotNull()), node(k)) for k in range(many)]
        top = F.get(f"level_{many}", F.lit(0))
        block = block.select(*by, "block", F.concat(*made).alias("made"), top["a"].alias("a"), top["n"].alias("n"))
        block = scratch.cut(block, f"layer-{first}") if scratch else block
        out.append(block.select(*by, F.inline("made")))
        cur = block.select(*by, F.col("block").alias("node"), "a", "n")
    out.append(cur.select(*by, F.lit(levels).alias("level"), "node", F.col("a").alias("coeff"), F.col("n").alias("leaves_left"), F.lit(0).cast("long").alias("leaves_right")))
    return reduce(lambda a, b: a.unionByName(b), out)


def threshold(coeffs: DataFrame, by: list[str], keep: int, levels: int) -> DataFrame:
    """The root and the ``keep`` coefficients whose loss would cost most squared error."""
    cost = F.abs("coeff") * F.sqrt(F.col("leaves_left") + F.col("leaves_right"))
    rank = F.row_number().over(W.partitionBy(*by, F.col("level") == levels).orderBy(F.desc(cost), "level", "node"))
    return coeffs.withColumn("k", rank).where((F.col("k") <= keep) | (F.col("level") == levels)).drop("k")


def point(coeffs: DataFrame, queries: DataFrame, by: list[str], levels: int) -> DataFrame:
    """Reconstructed value at each queried ``idx``: the sum of signed coefficients on its path.

    A query meets an array of the coefficients of its subtree for each layer, so that its path is not spread over rows.
    """
    asked, parts = queries.select(*by, "idx"), []
    roots = coeffs.where(F.col("level") == levels).select(*by, F.col("node").alias("__block"), F.col("coeff").alias("__root"))
    for number, (first, many) in enumerate(_layers(levels)):
        part, last = f"__part{number}", first + many
        own = coeffs.where((F.col("level") >= first) & (F.col("level") < last))
        # a subtree's coefficients level by level from its root, which is at 1
        place = F.expr(f"shiftleft(1L, {last - 1} - level)")
        at = (place + F.pmod("node", place) - 1).cast("int").alias("at")
        block = F.expr(f"shiftright(node, {last - 1} - level)").alias("__block")
        packed = own.groupBy(*by, block).agg(F.sort_array(F.collect_list(F.struct(at, F.col("coeff").alias("c")))).alias("entries"))
        packed = packed.select(*by, "__block", _filled(F.col("entries"), (1 << many) - 1)["c"].alias("__c"))
        asked = asked.withColumn("__block", F.shiftright("idx", last)).join(packed, [*by, "__block"], "left")
        local = F.pmod(F.shiftright("idx", first), F.lit(1 << many)) + (1 << many)
        path = [(F.get("__c", (F.shiftright(local, k + 1) - 1).cast("int")), F.pmod(F.shiftright("idx", first + k), F.lit(2)) == 0) for k in range(many)]
        found = reduce(lambda a, b: a | b, [c.isNotNull() for c, _ in path])
        total = reduce(lambda a, b: a + b, [F.coalesce(F.when(left, c).otherwise(-c), F.lit(0.0)) for c, left in path])
        asked = asked.withColumn(part, F.when(found, total)).drop("__c", "__block")
        parts.append(part)
    asked = asked.withColumn("__block", F.shiftright("idx", levels)).join(roots, [*by, "__block"], "left")
    parts.append("__root")
    value = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in reversed(parts)])
    return asked.where(F.coalesce(*parts).isNotNull()).select(*by, "idx", value.alias("value"))


def range_sum(coeffs: DataFrame, by: list[str], left: int, right: int, levels: int) -> DataFrame:
    """Sum of the reconstructed values at left .. right: each coefficient counts by its leaves inside."""
    start = F.col("node") * F.pow(F.lit(2), F.col("level") + 1)
    start = F.when(F.col("level") == levels, 0).otherwise(start)
    middle = start + F.col("leaves_left")
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.lit(right + 1), b) - F.greatest(F.lit(left), a))
    weight = inside(start, middle) - inside(middle, middle + F.col("leaves_right"))
    return coeffs.groupBy(*by).agg(F.sum(F.col("coeff") * weight).alias("total"))
