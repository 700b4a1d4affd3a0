"""Queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as A
from .operators import answers, routing, samples, synopses, wavelets, windowed
from .plans.engine import WindowedAggregation, with_empty_windows
from .plans.windows import Session, parse, session, sliding, tumbling
from .scratch import Scratch
from .sources import tables

H, D = 3_600_000, 86_400_000
EVENTS = "ev AS (SELECT *, epoch_us(ts)//1000 AS t, value::DECIMAL(18,2) AS v FROM events)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _windows(spark, sf_dir, *specs, keys=("event_type",), **aggs) -> DataFrame:
    return WindowedAggregation(tables.events(spark, sf_dir), "t", list(keys), ["event_id"]).window(*specs).agg(**aggs).run()


# -- SQL of the windows

_AGG_SQL = {
    "total": "sum(v)::DOUBLE", "n": "count(*)", "low": "min(value)", "high": "max(value)", "mean": "round(sum(v)::DOUBLE / count(value), 6)",
    "whole": "sum(trunc(value)::BIGINT)::BIGINT // count(value)", "median": "quantile_disc(value, 0.5)",
}
# values have two decimals: as decimals their sums don't depend on their order, in Spark and in SQL
def _money():
    return F.col("value").cast("decimal(18,2)")


def _total():
    return A.mapped(A.sum_(_money()), lambda x: x.cast("double"))


# columns need a session, so they are made when a query is
_AGGS = {
    "total": lambda: _total(), "n": A.count, "low": lambda: A.min_("value"), "high": lambda: A.max_("value"), "mean": lambda: A.mapped(A.avg(_money()), lambda x: F.round(x, 6)),
    "whole": lambda: A.int_mean("value"), "median": lambda: A.quantile("value", 0.5),
}


def _of(*names) -> dict:
    return {n: _AGGS[n]() for n in names}


def _sql(specs, names, keys=("event_type",)) -> str:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    agg = ", ".join(f"{_AGG_SQL[n]} AS {n}" for n in names)
    out = []
    for s in specs:
        head = f"SELECT {k}'{s.kind}' AS window_type, '{s.measure}' AS measure, '{s.label}' AS spec"
        if isinstance(s, Session):
            out.append(
                f"{head}, min(t) AS window_start, max(t) + {s.gap} AS window_end, {agg} FROM (SELECT *, sum(cut) OVER ({part}ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM "
                f"(SELECT *, CASE WHEN t - lag(t) OVER ({part}ORDER BY t, event_id) <= {s.gap} THEN 0 ELSE 1 END AS cut FROM ev)) GROUP BY {k}run"
            )
        elif s.measure == "count":
            steps = -(-s.size // s.slide)
            out.append(
                f"{head}, ws AS window_start, ws + {s.size} AS window_end, {agg} FROM (SELECT *, unnest(range((rn // {s.slide}) * {s.slide} - {(steps - 1) * s.slide}, (rn // {s.slide}) * {s.slide} + 1, {s.slide})) AS ws FROM "
                f"(SELECT *, row_number() OVER ({part}ORDER BY t, event_id) - 1 AS rn FROM ev)) WHERE ws >= 0 AND ws <= rn AND rn < ws + {s.size} GROUP BY {k}ws HAVING count(*) = {s.size}"
            )
        else:
            back = (-(-s.size // s.slide) - 1) * s.slide
            out.append(f"{head}, ws AS window_start, ws + {s.size} AS window_end, {agg} FROM (SELECT *, unnest(range((t // {s.slide}) * {s.slide} - {back}, (t // {s.slide}) * {s.slide} + 1, {s.slide})) AS ws FROM ev) WHERE ws <= t AND t < ws + {s.size} GROUP BY {k}ws")
    return f"WITH {EVENTS} " + " UNION ALL ".join(out)


def _register(name: str, specs, names, keys=("event_type",)) -> None:
    QUERIES[name] = lambda spark, sf_dir: _windows(spark, sf_dir, *specs, keys=keys, **_of(*names))
    SQL[name] = _sql(specs, names, keys)


FLAGSHIP = [tumbling(H), sliding(6 * H, 2 * H), session(H)]
for _name, _specs, _names, _keys in [
    ("tumbling_sum", [tumbling(H)], ["total"], ("event_type",)),
    ("tumbling_count", [tumbling(H)], ["n"], ("event_type",)),
    ("tumbling_min", [tumbling(H)], ["low"], ("event_type",)),
    ("tumbling_max", [tumbling(H)], ["high"], ("event_type",)),
    ("tumbling_avg", [tumbling(H)], ["mean"], ("event_type",)),
    ("tumbling_int_mean", [tumbling(H)], ["whole"], ("event_type",)),
    ("tumbling_quantile", [tumbling(H)], ["median"], ("event_type",)),
    ("sliding_sum", [sliding(6 * H, 2 * H)], ["total", "n"], ("event_type",)),
    ("sliding_uneven", [sliding(5 * H, 2 * H)], ["total", "n"], ("event_type",)),
    ("sliding_gap", [sliding(2 * H, 5 * H)], ["total", "n"], ("event_type",)),
    ("session_sum", [session(H)], ["total", "n"], ("user_id",)),
    ("multi_session", [session(H), session(5 * H)], ["total", "n"], ("user_id",)),
    ("count_tumbling_sum", [tumbling(50, "count")], ["total"], ("event_type",)),
    ("count_sliding_sum", [sliding(80, 40, "count")], ["total", "high"], ("event_type",)),
    ("multi_window_shared", [tumbling(H), sliding(6 * H, 2 * H), sliding(5 * H, 2 * H), sliding(2 * H, 5 * H), tumbling(3 * H + 7), session(H), tumbling(50, "count")], ["total", "n", "low", "high"], ("event_type",)),
    ("random_tumbling_20", parse("randomTumbling(20,3600,72000)"), ["total", "n"], ("event_type",)),
    ("random_count_5", parse("randomCount(5,10,200)"), ["total"], ("event_type",)),
    ("multi_agg", [tumbling(H), sliding(6 * H, 2 * H)], ["total", "n", "low", "high", "mean", "whole"], ("event_type",)),
    ("multi_agg_holistic", [tumbling(6 * H), sliding(6 * H, 2 * H)], ["total", "median"], ("event_type",)),
    ("global_window_sum", [tumbling(H), sliding(6 * H, 2 * H)], ["total", "n"], ()),
    ("global_count_window", [tumbling(500, "count")], ["total"], ()),
    ("flagship", FLAGSHIP, ["total", "n", "low", "high", "mean"], ("event_type",)),
]:
    _register(_name, _specs, _names, _keys)


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["flagship"](spark, "/root/testdata/sf0.001")


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, t // {D} * {D} AS ws, sum(v)::DOUBLE AS total FROM ev GROUP BY ALL),
b AS (SELECT user_id, unnest(range(min(ws), max(ws) + 1, {D})) AS ws FROM w GROUP BY user_id)
SELECT user_id, ws AS window_start, ws + {D} AS window_end, total FROM b LEFT JOIN w USING (user_id, ws)""")
def tumbling_empty_windows(spark, sf_dir):
    return with_empty_windows(_windows(spark, sf_dir, tumbling(D), keys=("user_id",), **_of("total")), tumbling(D), ["user_id"])


@query()
def approx_quantile_shared(spark, sf_dir):
    """KLL sketches in slices, merged into windows."""
    return _windows(spark, sf_dir, tumbling(D), sliding(2 * D, D), median=A.approx_quantile("value", 0.5))


@query()
def hll_builtin(spark, sf_dir):
    return _windows(spark, sf_dir, tumbling(D), sliding(2 * D, D), users=A.distinct("user_id"))


@query(_sql([tumbling(D)], ["total"]).replace("sum(v)::DOUBLE", "max(value) - min(value)"))
def user_defined_aggregate(spark, sf_dir):
    """lift, combine, lower: the spread as (min, max) partials."""
    spread = A.Agg((F.min("value"), F.max("value")), (F.min, F.max), lambda a, b: b - a)
    return _windows(spark, sf_dir, tumbling(D), total=spread)


# -- synopses: day windows of events by type

DAY = f"day AS (SELECT *, t // {D} * {D} AS w FROM ev)"
BY = ["event_type", "w"]


def _days(spark, sf_dir) -> DataFrame:
    return tables.events(spark, sf_dir).withColumn("w", F.col("t") - F.pmod("t", F.lit(D)))


def _h(x: str, r: int) -> str:
    a, b = synopses.coefficients(r)
    return f"(({a}::BIGINT * {x} + {b}) % 2147483647)"


def _mixed(x: str, r: int) -> str:
    y = _h(x, r)
    return _h(f"xor({y}, {y} >> 15)", r + 900)


def _rows(x: str, rows: int, width: int, table: str = "items", more: Callable[[int], str] = lambda r: "", columns: str = "event_type, w") -> str:
    return " UNION ALL ".join(f"SELECT {columns}, {x}, n, {r} AS r, {_h(x, r)} % {width} AS bucket{more(r)} FROM {table}" for r in range(rows))


ITEMS = f"WITH {EVENTS}, {DAY}, items AS (SELECT event_type, w, user_id, count(*) AS n FROM day GROUP BY ALL)"
CMS_SQL = f"{ITEMS}, c AS ({_rows('user_id', 5, 64)}), cells AS (SELECT event_type, w, r, bucket, sum(n)::BIGINT AS cnt FROM c GROUP BY ALL)"


@query(f"{CMS_SQL} SELECT * FROM cells")
def cms_cells(spark, sf_dir):
    return synopses.count_min(_days(spark, sf_dir), BY, "user_id", 64, 5)


@query(f"{CMS_SQL} SELECT event_type, w, user_id, min(cnt) AS estimate FROM c JOIN cells USING (event_type, w, r, bucket) GROUP BY ALL")
def cms_point(spark, sf_dir):
    days = _days(spark, sf_dir)
    return synopses.count_min_point(synopses.count_min(days, BY, "user_id", 64, 5), days.select(*BY, "user_id").distinct(), BY, "user_id", 64, 5)


_EVEN = f"WITH {EVENTS}, {DAY}, items AS (SELECT event_type, user_id, count(*) AS n FROM day WHERE event_id % 2 = 1 GROUP BY ALL), c AS ({_rows('user_id', 5, 64, columns='event_type')})"


@query(f"{_EVEN} SELECT event_type, r, bucket, sum(n)::BIGINT AS cnt FROM c GROUP BY ALL")
def cms_invert(spark, sf_dir):
    """All rows minus the rows with even ids."""
    ev = tables.events(spark, sf_dir)
    whole, part = (synopses.count_min(x, ["event_type"], "user_id", 64, 5) for x in (ev, ev.where("event_id % 2 = 0")))
    return synopses.count_min_merge(whole, part, ["event_type"], -1)


@query(f"WITH {EVENTS}, {DAY}, items AS (SELECT event_type, user_id, count(*) AS n FROM day GROUP BY ALL), c AS ({_rows('user_id', 5, 64, columns='event_type')}) SELECT event_type, r, bucket, sum(n)::BIGINT AS cnt FROM c GROUP BY ALL")
def cms_merge(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return synopses.count_min_merge(*(synopses.count_min(ev.where(f"event_id % 2 = {k}"), ["event_type"], "user_id", 64, 5) for k in (0, 1)), ["event_type"])


@query("""WITH p AS (SELECT p_partkey, ('0x' || md5(p_brand)[1:8])::BIGINT AS x FROM part) SELECT x, count(*) AS n FROM p GROUP BY x""")
def string_keys(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "part").groupBy(synopses.string_key(F.col("p_brand")).alias("x")).agg(F.count("*").alias("n"))


LOG_M = 6
HLL_SQL = f"""WITH h AS (SELECT l_returnflag, {_mixed('l_partkey', 0)} AS h FROM lineitem), r AS (SELECT l_returnflag, h % {1 << LOG_M} AS reg, h // {1 << LOG_M} AS rest FROM h),
regs AS (SELECT l_returnflag, reg, max(CASE WHEN rest = 0 THEN {32 - LOG_M} ELSE bit_count((rest & -rest) - 1) + 1 END)::INTEGER AS rho FROM r GROUP BY ALL)"""


@query(f"{HLL_SQL} SELECT * FROM regs")
def hll_registers(spark, sf_dir):
    return synopses.hll_registers(tables.read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", LOG_M)


@query(f"""{HLL_SQL}, s AS (SELECT l_returnflag, sum(pow(2.0, -rho)) + ({1 << LOG_M} - count(*)) AS s, {1 << LOG_M} - count(*) AS z FROM regs GROUP BY ALL)
SELECT l_returnflag, round(CASE WHEN z > 0 AND {0.709 * 4096} / s < {2.5 * 64} THEN 64 * ln(64 / z) ELSE {0.709 * 4096} / s END, 6) AS estimate FROM s""")
def hll_estimate(spark, sf_dir):
    regs = synopses.hll_registers(tables.read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", LOG_M)
    return synopses.hll_estimate(regs, ["l_returnflag"], LOG_M).withColumn("estimate", F.round("estimate", 6))


BITS, ELEMENTS = 4096, 1000
_K = synopses.bloom_k(ELEMENTS, BITS)


def _bits(name: str, where: str) -> str:
    return f"{name}_i AS (SELECT DISTINCT user_id, 1 AS n FROM ev WHERE {where}), {name} AS (SELECT DISTINCT bucket AS bit FROM ({_rows('user_id', _K, BITS, f'{name}_i', columns='1 AS one')}))"


@query(f"""WITH {EVENTS}, {_bits('f', "event_type = 'purchase' OR user_id % 3 = 0")}, p_i AS (SELECT DISTINCT user_id, 1 AS n FROM ev), p AS (SELECT DISTINCT user_id, bucket AS bit FROM ({_rows('user_id', _K, BITS, 'p_i', columns='1 AS one')}))
SELECT user_id, count(f.bit) = count(*) AS found FROM p LEFT JOIN f USING (bit) GROUP BY user_id""")
def bloom_probe(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    f = synopses.bloom(ev.where("event_type = 'purchase' OR user_id % 3 = 0"), [], "user_id", ELEMENTS, BITS)
    return synopses.bloom_probe(f, ev, [], "user_id", ELEMENTS, BITS)


@query(f"WITH {EVENTS}, {_bits('f', 'user_id % 3 = 0')}, {_bits('g', 'user_id % 2 = 0')} SELECT bit FROM f INTERSECT SELECT bit FROM g")
def bloom_intersect(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return synopses.bloom_intersect(*(synopses.bloom(ev.where(f"user_id % {k} = 0"), [], "user_id", ELEMENTS, BITS) for k in (3, 2)))


@query(f"WITH {EVENTS}, {_bits('f', 'user_id % 3 = 0 OR user_id % 2 = 0')} SELECT bit FROM f")
def bloom_union(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return synopses.bloom_union(*(synopses.bloom(ev.where(f"user_id % {k} = 0"), [], "user_id", ELEMENTS, BITS) for k in (3, 2)))


def _cuckoo_sql(table: str) -> str:
    fp = f"({_h('user_id', 1)} % 255 + 1)"
    one, two = f"{_h('user_id', 0)} % 4096", f"{_h(fp, 2)} % 4096"
    return f"SELECT user_id, {fp} AS fp, least({one}, ({two} - {one} + 4096) % 4096) AS bucket FROM {table}"


def _cuckoo_query(minus: str) -> str:
    return f"""WITH {EVENTS}, a AS (SELECT fp, bucket, count(*) AS cnt FROM ({_cuckoo_sql('(SELECT user_id FROM ev WHERE user_id % 2 = 0)')}) GROUP BY ALL),
d AS (SELECT fp, bucket, -count(*) AS cnt FROM ({_cuckoo_sql(f'(SELECT user_id FROM ev WHERE {minus})')}) GROUP BY ALL),
f AS (SELECT fp, bucket, sum(cnt) AS cnt FROM (SELECT * FROM a UNION ALL SELECT * FROM d) GROUP BY ALL HAVING sum(cnt) > 0)
SELECT user_id, coalesce(cnt > 0, false) AS found FROM ({_cuckoo_sql('(SELECT DISTINCT user_id FROM ev)')}) LEFT JOIN f USING (fp, bucket)"""


def _cuckoo(spark, sf_dir, minus):
    ev = tables.events(spark, sf_dir)
    add = synopses.cuckoo(ev.where("user_id % 2 = 0"), [], "user_id", 4096)
    drop = synopses.cuckoo(ev.where(minus), [], "user_id", 4096, sign=-1)
    return synopses.cuckoo_lookup(synopses.cuckoo_merge(add, drop, by=[]), ev, [], "user_id", 4096)


@query(_cuckoo_query("false"))
def cuckoo_lookup(spark, sf_dir):
    return _cuckoo(spark, sf_dir, "false")


@query(_cuckoo_query("user_id % 4 = 0"))
def cuckoo_delete(spark, sf_dir):
    return _cuckoo(spark, sf_dir, "user_id % 4 = 0")


ACC, MAX_BINS = 0.01, 128
LOG_GAMMA = repr(math.log(synopses.dd_gamma(ACC)))
DD_SQL = f"""WITH {EVENTS}, {DAY}, raw AS (SELECT event_type, w, CASE WHEN value > 0 THEN floor(ln(value) / {LOG_GAMMA}::DOUBLE)::BIGINT END AS bin, count(*) AS cnt FROM day GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, w ORDER BY bin DESC NULLS LAST) AS k FROM raw),
l AS (SELECT *, min(CASE WHEN k <= {MAX_BINS} THEN bin END) OVER (PARTITION BY event_type, w) AS low FROM k),
bins AS (SELECT event_type, w, CASE WHEN bin IS NOT NULL THEN greatest(bin, low) END AS bin, sum(cnt)::BIGINT AS cnt FROM l GROUP BY ALL)"""


@query(f"{DD_SQL} SELECT * FROM bins")
def ddsketch_bins(spark, sf_dir):
    return synopses.dd_sketch(_days(spark, sf_dir), BY, "value", ACC, MAX_BINS)


@query(f"""{DD_SQL}, c AS (SELECT *, sum(cnt) OVER (PARTITION BY event_type, w ORDER BY bin NULLS FIRST) AS upto, sum(cnt) OVER (PARTITION BY event_type, w) AS n FROM bins)
SELECT event_type, w, round(arg_min(CASE WHEN bin IS NULL THEN 0.0 ELSE pow({synopses.dd_gamma(ACC)!r}::DOUBLE, bin) * {1 + ACC} END, upto), 6) AS quantile FROM c WHERE upto > floor(0.9 * (n - 1)) GROUP BY ALL""")
def ddsketch_quantile(spark, sf_dir):
    bins = synopses.dd_sketch(_days(spark, sf_dir), BY, "value", ACC, MAX_BINS)
    return synopses.dd_quantile(bins, BY, 0.9, ACC).withColumn("quantile", F.round("quantile", 6))


def _sign(r: int) -> str:
    return f", 1 - 2 * ({_h('user_id', r + 500)} % 2) AS sign"


@query(f"""{ITEMS}, c AS ({_rows('user_id', 5, 256, more=_sign)}), cells AS (SELECT event_type, w, r, bucket, sum(n * sign)::BIGINT AS cell FROM c GROUP BY ALL),
f AS (SELECT event_type, w, r, sum(cell * cell)::BIGINT AS f2 FROM cells GROUP BY ALL)
SELECT event_type, w, list_sort(list(f2))[3] AS f2, round(list_sort(list(f2))[3] / 16.0::DOUBLE, 6) AS error_bound, 0.03125::DOUBLE AS error_probability FROM f GROUP BY event_type, w""")
def agms_f2(spark, sf_dir):
    return synopses.agms_f2(synopses.agms(_days(spark, sf_dir), BY, "user_id", 256, 5), BY, 256, 5)


@query(f"{ITEMS} SELECT event_type, w, sum(n * n)::BIGINT AS f2 FROM items GROUP BY event_type, w")
def exact_f2(spark, sf_dir):
    return _days(spark, sf_dir).groupBy(*BY, "user_id").count().groupBy(*BY).agg(F.sum(F.col("count") * F.col("count")).alias("f2"))


EW_SQL = f"WITH {EVENTS}, {DAY}, cells AS (SELECT event_type, w, least(floor(value / 62.5)::BIGINT, 7) AS bucket, count(*) AS cnt FROM day WHERE value >= 0 AND value < 500 GROUP BY ALL)"


def _cells(spark, sf_dir):
    return synopses.equi_width(_days(spark, sf_dir), BY, "value", 0.0, 500.0, 8)


@query(f"{EW_SQL} SELECT * FROM cells")
def equiwidth_hist(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"{EW_SQL} SELECT event_type, w, round(sum(cnt * greatest(0, least(210.5, bucket * 62.5 + 62.5) - greatest(33.25, bucket * 62.5)) / 62.5)::DOUBLE, 6) AS estimate FROM cells GROUP BY event_type, w")
def equiwidth_range(spark, sf_dir):
    return synopses.equi_width_range(_cells(spark, sf_dir), BY, 0.0, 500.0, 8, 33.25, 210.5).withColumn("estimate", F.round("estimate", 6))


def _share(part: str, whole: str, most: int) -> str:
    return f"(CASE WHEN {whole} = 0 THEN 0 ELSE floor({most} * ({part})::DOUBLE / ({whole}) + 0.5) END)::BIGINT"


_F = [f"f{k}" for k in range(8)]
_CODE = " + ".join(
    [f"{_share('+'.join(_F[:4]), '(' + '+'.join(_F) + ')', 63)} * {1 << 26}", f"{_share('f0+f1', '(f0+f1+f2+f3)', 31)} * {1 << 21}", f"{_share('f4+f5', '(f4+f5+f6+f7)', 31)} * {1 << 16}"]
    + [f"{_share(f'f{k}', f'(f{k}+f{k + 1})', 15)} * {1 << p}" for k, p in zip((0, 2, 4, 6), (12, 8, 4, 0))]
)


@query(f"{EW_SQL}, wide AS (SELECT event_type, w, {', '.join(f'coalesce(sum(cnt) FILTER (WHERE bucket = {k}), 0)::BIGINT AS f{k}' for k in range(8))} FROM cells GROUP BY event_type, w) SELECT event_type, w, {_CODE} AS code FROM wide")
def fourlevel_code(spark, sf_dir):
    return synopses.four_level_code(_cells(spark, sf_dir), BY)


@query()
def fourlevel_range(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    totals = cells.groupBy(*BY).agg(F.sum("cnt").alias("total"))
    return synopses.four_level_code(cells, BY).join(totals, BY).select(*BY, synopses.four_level_range(F.col("code"), F.col("total"), 0.0, 500.0, 33.25, 210.5).alias("estimate"))


ED_SQL = """WITH f AS (SELECT o_orderpriority, o_totalprice AS v, count(*) AS f FROM orders GROUP BY ALL),
r AS (SELECT *, sum(f) OVER (PARTITION BY o_orderpriority ORDER BY v) AS upto, lead(v) OVER (PARTITION BY o_orderpriority ORDER BY v) AS nxt, sum(f) OVER (PARTITION BY o_orderpriority) AS total FROM f),
i AS (SELECT o_orderpriority, v, nxt, upto, total / 10.0::DOUBLE AS size, unnest(range((floor((upto - f) / (total / 10.0::DOUBLE)) + 1)::BIGINT, least(floor(upto / (total / 10.0::DOUBLE)), 9)::BIGINT + 1)) AS i FROM r),
b AS (SELECT o_orderpriority, i, v + (1 - least((upto - i * size) / size, 1.0)) * (coalesce(nxt, v) - v) AS left_bound FROM i UNION ALL SELECT o_orderpriority, 0, min(v) FROM f GROUP BY o_orderpriority),
e AS (SELECT o_orderpriority, max(v) AS right_bound, sum(f)::BIGINT AS total FROM f GROUP BY o_orderpriority)"""


@query(f"{ED_SQL} SELECT o_orderpriority, i::BIGINT AS i, round(left_bound, 4) AS left_bound, right_bound, total FROM b JOIN e USING (o_orderpriority)")
def equidepth_hist(spark, sf_dir):
    out = synopses.equi_depth(tables.read_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 10)
    return out.withColumn("left_bound", F.round("left_bound", 4))


@query(f"""{ED_SQL}, c AS (SELECT *, coalesce(lead(left_bound) OVER (PARTITION BY o_orderpriority ORDER BY i), right_bound) AS r FROM b JOIN e USING (o_orderpriority))
SELECT o_orderpriority, round(sum(greatest(0.0, (least(150000.0::DOUBLE, r) - greatest(50000.0::DOUBLE, left_bound)) / (r - left_bound)) * total / 10.0::DOUBLE), 4) AS estimate FROM c GROUP BY o_orderpriority""")
def equidepth_range(spark, sf_dir):
    bounds = synopses.equi_depth(tables.read_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 10)
    return synopses.equi_depth_range(bounds, ["o_orderpriority"], 50000.0, 150000.0).withColumn("estimate", F.round("estimate", 4))


@query()
def equidepth_sketch(spark, sf_dir):
    """Boundaries from a mergeable quantile sketch: the contract of the online equi-depth histograms."""
    return tables.read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(o_totalprice), array(0.1D, 0.2D, 0.3D, 0.4D, 0.5D, 0.6D, 0.7D, 0.8D, 0.9D))").alias("bounds"))


# -- samples


def _top(order: str, columns: str, part: str = "event_type, w", n: int = 5) -> str:
    return f"WITH {EVENTS}, {DAY}, s AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM day) SELECT {columns} FROM s WHERE rank <= {n}"


@query(_top(f"{_h('event_id', 7)}, event_id", "event_type, w, event_id, value"))
def reservoir_sample(spark, sf_dir):
    return samples.reservoir(_days(spark, sf_dir), BY, "event_id", 5).select(*BY, "event_id", "value")


@query(_top("t DESC, event_id DESC", "event_type, w, event_id, value, rank::INTEGER AS rank"))
def fifo_sample(spark, sf_dir):
    return samples.newest(_days(spark, sf_dir), BY, "t", "event_id", 5).select(*BY, "event_id", "value", "rank")


@query(_top(f"round(ln(-ln(({_h('event_id', 8)} + 1) / 2147483648.0::DOUBLE)) - (t - w) * {0.6931471805599453 / H!r}::DOUBLE, 9), event_id", "event_type, w, event_id, value"))
def biased_sample(spark, sf_dir):
    days = _days(spark, sf_dir).withColumn("own", F.col("t") - F.col("w"))
    return samples.biased(days, BY, "own", "event_id", 5, float(H)).select(*BY, "event_id", "value")


@query(f"""WITH {EVENTS}, {DAY}, s AS (SELECT *, row_number() OVER (PARTITION BY w, event_type ORDER BY {_h('event_id', 7)}, event_id) AS rank, count(*) OVER (PARTITION BY w, event_type) AS seen FROM day)
SELECT w, event_type, event_id, greatest(seen / 20.0::DOUBLE, 1.0::DOUBLE) AS weight FROM s WHERE rank <= 20""")
def stratified_sample_weighted(spark, sf_dir):
    return samples.stratified(_days(spark, sf_dir), ["w"], "event_type", "event_id", 20).select("w", "event_type", "event_id", "weight")


# -- routing


@query("SELECT least(floor(value / 100 * 4), 3)::BIGINT AS stratum, count(*) AS n FROM events GROUP BY ALL")
def stratify_range(spark, sf_dir):
    return tables.events(spark, sf_dir).groupBy(routing.range_stratum(F.col("value"), 4).alias("stratum")).agg(F.count("*").alias("n"))


@query("SELECT (user_id % 7)::BIGINT AS stratum, (event_id // 1000)::BIGINT AS block, least(user_id, 9)::BIGINT AS capped, count(*) AS n FROM events GROUP BY ALL")
def stratify_mod(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return ev.groupBy(routing.modulo_stratum(F.col("user_id"), 7).alias("stratum"), routing.block_stratum(F.col("event_id")).alias("block"), routing.capped_stratum(F.col("user_id"), 10).alias("capped")).agg(F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS stratum, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def stratify_field(spark, sf_dir):
    return routing.stratify(tables.events(spark, sf_dir), "user_id").groupBy("stratum").agg(F.count("*").alias("n"), F.max("value").alias("high"))


@query(f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS rn FROM ev) SELECT event_type, event_id, (rn % 4)::INTEGER AS part, rn // 4 AS local FROM r")
def roundrobin_index(spark, sf_dir):
    return routing.round_robin(tables.events(spark, sf_dir), "t", ["event_type"], ["event_id"], 4).select("event_type", "event_id", "part", "local")


@query(f"WITH {EVENTS} SELECT event_id, value, t AS ts FROM ev")
def timestamped_elements(spark, sf_dir):
    return routing.with_timestamp(tables.events(spark, sf_dir), "value", "t").select("event_id", "element.value", "element.ts")


@query(f"WITH {EVENTS}, r AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS rn FROM ev) SELECT event_id, 1517499757961 + rn // 1000 * 60000 AS ts FROM r")
def stamped_rows(spark, sf_dir):
    return tables.stamp_rows(tables.events(spark, sf_dir).drop("ts"), ["t", "event_id"], per_step=1000).select("event_id", "ts")


# -- wavelets: each type's values in event-time order

_SEQ = f"WITH {EVENTS}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS idx FROM ev)"


def _sequence(spark, sf_dir):
    from .plans.engine import rank_by_time

    return rank_by_time(tables.events(spark, sf_dir), "t", ["event_type"], ["event_id"]).select("event_type", F.col("rn").cast("long").alias("idx"), "value")


def _coeffs(spark, sf_dir):
    seq = _sequence(spark, sf_dir)
    levels = wavelets.levels_of(seq, "idx")
    return wavelets.haar(seq, ["event_type"], "idx", "value", levels), levels


@query(f"""{_SEQ}, p AS (SELECT event_type, idx // 2 AS node, max(value) FILTER (WHERE idx % 2 = 0) AS l, max(value) FILTER (WHERE idx % 2 = 1) AS r FROM s GROUP BY ALL)
SELECT event_type, node, round(l - (l + r) / 2, 6) AS coeff FROM p WHERE r IS NOT NULL""")
def haar_coeffs(spark, sf_dir):
    return _coeffs(spark, sf_dir)[0].where("level = 0").select("event_type", "node", F.round("coeff", 6).alias("coeff"))


@query(f"{_SEQ} SELECT event_type, idx, round(value, 4) AS value FROM s")
def haar_point(spark, sf_dir):
    coeffs, levels = _coeffs(spark, sf_dir)
    return wavelets.point(coeffs, _sequence(spark, sf_dir).select("event_type", "idx"), ["event_type"], levels).withColumn("value", F.round("value", 4))


@query(f"{_SEQ} SELECT event_type, round(sum(value), 4) AS total FROM s WHERE idx BETWEEN 17 AND 1000 GROUP BY event_type")
def haar_rangesum(spark, sf_dir):
    coeffs, levels = _coeffs(spark, sf_dir)
    return wavelets.range_sum(coeffs, ["event_type"], 17, 1000, levels).withColumn("total", F.round("total", 4))


@query()
def haar_synopsis(spark, sf_dir):
    coeffs, levels = _coeffs(spark, sf_dir)
    return wavelets.threshold(coeffs, ["event_type"], 64, levels)


@query(f"WITH {EVENTS}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS idx FROM ev) SELECT event_type, (idx % 4)::INTEGER AS part, idx // 4 AS idx, round(value, 4) AS value FROM s")
def haar_distributed(spark, sf_dir):
    """Four wavelets by turns for each type."""
    seq = routing.round_robin(tables.events(spark, sf_dir), "t", ["event_type"], ["event_id"], 4).select("event_type", "part", F.col("local").alias("idx"), "value")
    by, scratch = ["event_type", "part"], Scratch(spark, "haar")
    # ranked and written once: the wavelet, its height and the questions all read it
    seq = scratch.cut(seq, "sequences")
    levels = wavelets.levels_of(seq, "idx")
    return wavelets.point(wavelets.haar(seq, by, "idx", "value", levels, scratch), seq.select(*by, "idx"), by, levels).withColumn("value", F.round("value", 4))


# -- query answering: synopses are day windows; questions are events of one kind

_SYN = f"WITH {EVENTS}, syn AS (SELECT event_type, t // {D} * {D} AS window_start, t // {D} * {D} + {D} AS window_end, sum(v)::DOUBLE AS total FROM ev WHERE t // {D} % 3 <> 0 GROUP BY ALL), one AS (SELECT t // {D} * {D} AS window_start, t // {D} * {D} + {D} AS window_end, sum(v)::DOUBLE AS total FROM ev WHERE t // {D} % 3 <> 0 GROUP BY ALL), q AS (SELECT event_id, event_type, t AS qt FROM ev)"


def _synopses(spark, sf_dir, keys):
    ev = tables.events(spark, sf_dir).where(f"t div {D} % 3 <> 0")
    out = WindowedAggregation(ev, "t", keys).window(tumbling(D)).agg(total=_total()).run()
    return out.select(*keys, "window_start", "window_end", "total")


def _questions(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", "event_type", F.col("t").alias("qt"))


@query(f"{_SYN} SELECT q.*, o.* FROM q, (SELECT * FROM one ORDER BY window_start DESC LIMIT 1) o")
def query_latest(spark, sf_dir):
    return answers.query_latest(_synopses(spark, sf_dir, []), _questions(spark, sf_dir), [])


@query(f"{_SYN}, l AS (SELECT event_type, max(window_start) AS window_start FROM syn GROUP BY ALL) SELECT q.*, syn.window_start, window_end, total FROM q LEFT JOIN (syn SEMI JOIN l USING (event_type, window_start)) USING (event_type)")
def query_latest_stratified(spark, sf_dir):
    return answers.query_latest(_synopses(spark, sf_dir, ["event_type"]), _questions(spark, sf_dir), ["event_type"])


_ASOF = "CASE WHEN qt <= window_end THEN {c} END AS {c}"
_ASOFS = ", ".join(_ASOF.format(c=c) for c in ("window_start", "window_end", "total"))


@query(f"{_SYN} SELECT q.*, {_ASOFS} FROM q ASOF LEFT JOIN one ON q.qt >= one.window_start")
def query_timestamped(spark, sf_dir):
    return answers.query_timestamped(_synopses(spark, sf_dir, []), _questions(spark, sf_dir), [], "qt", archive=None)


@query(f"{_SYN} SELECT q.*, {_ASOFS} FROM q ASOF LEFT JOIN syn ON q.event_type = syn.event_type AND q.qt >= syn.window_start")
def query_timestamped_stratified(spark, sf_dir):
    return answers.query_timestamped(_synopses(spark, sf_dir, ["event_type"]), _questions(spark, sf_dir), ["event_type"], "qt", archive=None)


@query(f"{_SYN} SELECT q.*, window_start, window_end, total FROM q JOIN syn ON q.event_type = syn.event_type AND qt BETWEEN window_start AND window_end")
def interval_join(spark, sf_dir):
    return answers.interval_join(_synopses(spark, sf_dir, ["event_type"]), _questions(spark, sf_dir), ["event_type"], "qt", D)


# -- generators


@query()
def generated_uniform(spark, sf_dir):
    return WindowedAggregation(tables.uniform(spark, 10_000), "ts", ["key"]).window(sliding(2000, 1000)).agg(n=A.count()).run()


@query()
def generated_normal(spark, sf_dir):
    return tables.normal(spark, 10_000).groupBy("key").agg(F.count("*").alias("n"))


@query()
def generated_zipf(spark, sf_dir):
    return tables.zipf(spark, 10_000).groupBy("key").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- synopses over sliding and count windows, from shared slices

SLIDING_DAY = f"day AS (SELECT ev.*, t // {D} * {D} - k * {D} AS w FROM ev, range(3) s(k))"
HUNDRED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS many FROM ev), day AS (SELECT *, rn // 50 * 50 - k * 50 AS w FROM ranked, range(2) s(k) WHERE rn // 50 * 50 - k * 50 >= 0 AND rn // 50 * 50 - k * 50 + 100 <= many)"


def _over(spark, sf_dir, spec, synopsis) -> DataFrame:
    out = windowed.over_windows(tables.events(spark, sf_dir), "t", [spec], ["event_type"], synopsis, ["event_id"])
    return out.withColumnRenamed("window_start", "w").drop("spec", "window_end")


@query(f"{CMS_SQL.replace(DAY, SLIDING_DAY)} SELECT * FROM cells")
def cms_sliding(spark, sf_dir):
    return _over(spark, sf_dir, sliding(3 * D, D), windowed.count_min("user_id", 64, 5))


@query(f"{CMS_SQL.replace(DAY, HUNDRED)} SELECT * FROM cells")
def cms_count_windows(spark, sf_dir):
    return _over(spark, sf_dir, sliding(100, 50, "count"), windowed.count_min("user_id", 64, 5))


@query(f"{DD_SQL.replace(DAY, SLIDING_DAY)} SELECT * FROM bins")
def ddsketch_sliding(spark, sf_dir):
    return _over(spark, sf_dir, sliding(3 * D, D), windowed.dd_sketch("value", ACC, MAX_BINS))


@query(f"{EW_SQL.replace(DAY, SLIDING_DAY)} SELECT * FROM cells")
def equiwidth_sliding(spark, sf_dir):
    return _over(spark, sf_dir, sliding(3 * D, D), windowed.equi_width("value", 0.0, 500.0, 8))


@query(f"{EW_SQL.replace(DAY, HUNDRED)} SELECT * FROM cells")
def equiwidth_count_windows(spark, sf_dir):
    return _over(spark, sf_dir, sliding(100, 50, "count"), windowed.equi_width("value", 0.0, 500.0, 8))
