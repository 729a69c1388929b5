"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partition as P
from . import sources
from .operators import collectives as C
from .operators import elementwise as E
from .operators import order as O
from .operators import reduce as R
from .operators import scan as S
from .operators import views as V
from .operators.apps import jacobi_step
from .operators.kvmap import KVMap
from .operators.tensor import Tensor, from_flat
from .plans.blockscan import Key
from .seq import Seq, from_dense, from_ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EV = "WITH ev AS (SELECT event_id AS idx, cast(floor(value * 100) AS BIGINT) AS value, count(*) OVER () AS n FROM events) "
#: The numbers below that of the events.
_N = "WITH r AS (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM events)) "
#: Running columns in SQL.
_UP = "OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PRE = "OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BLOCKS = 8


def _block(n: str = "n", p: int = BLOCKS, idx: str = "idx") -> str:
    return f"CASE WHEN {idx} < ({n} % {p}) * ({n} // {p} + 1) THEN {idx} // ({n} // {p} + 1) ELSE ({idx} - ({n} % {p}) * ({n} // {p} + 1)) // ({n} // {p}) + {n} % {p} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *keep: str, n_blocks: int = 0) -> Seq:
    """Events by id, with their value in whole hundredths."""
    return from_dense(table(spark, sf_dir, "events"), "event_id", F.floor(F.col("value") * 100).cast("long"), n_blocks=n_blocks, keep=keep)


def ranks(spark: SparkSession, sf_dir: str) -> Seq:
    """The same as ``BLOCKS`` ranks hold it, for queries whose result is told by rank; for others the table decides."""
    return events(spark, sf_dir, n_blocks=BLOCKS)


def sized(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").count()


def query(name: str, sql: str | None, source: Callable[..., Seq] = events):
    """Registers a query of a sequence."""

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: _frame(make(source(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def frame_query(name: str, sql: str | None):
    def add(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def _frame(out: Seq | DataFrame) -> DataFrame:
    return out.df if isinstance(out, Seq) else out


# element-wise ------------------------------------------------------------------------------------------------------
query("transform_unary", _EV + "SELECT idx, value * 3 + 1 AS value FROM ev")(lambda s: E.transform(s, lambda v: v * 3 + 1))
query("transform_segmented", _EV + f"SELECT idx, value + {_block()} AS value FROM ev", ranks)(lambda s: Seq(R.with_block(s).select("idx", (F.col("value") + F.col("block")).alias("value")), s.size))
query("transform_binary", _EV + "SELECT a.idx, a.value - 2 * b.value AS value FROM ev a JOIN (SELECT idx, value % 1000 AS value FROM ev) b ON a.idx = b.idx")(
    lambda s: E.transform_pairs(s, E.transform(s, lambda v: v % 1000), lambda a, b: a - 2 * b)
)
query("for_each_first", _EV + "SELECT idx, CASE WHEN idx < 100 THEN -value ELSE value END AS value FROM ev")(lambda s: E.transform_first(s, 100, lambda v: -v))
query("for_each_first_of_blocks", _EV + f", b AS (SELECT idx, value, {_block()} AS block FROM ev) SELECT idx, CASE WHEN idx - min(idx) OVER (PARTITION BY block) < 10 THEN -value ELSE value END AS value FROM b", ranks)(
    lambda s: E.transform_first_of_blocks(s, 10, lambda v: -v)
)
query("fill", _EV + "SELECT idx, cast(42 AS BIGINT) AS value FROM ev")(lambda s: E.transform(s, lambda v: F.lit(42).cast("long")))
query("fill_n", _EV + "SELECT idx, CASE WHEN idx < 50 THEN cast(7 AS BIGINT) ELSE value END AS value FROM ev")(lambda s: E.transform_first(s, 50, lambda v: F.lit(7).cast("long")))
query("copy", _EV + "SELECT idx, value FROM ev")(E.copy)
query("copy_n", _EV + "SELECT idx, value FROM ev WHERE idx < 321")(lambda s: E.copy_first(s, 321))
query("copy_if_reindex", _EV + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, value FROM ev WHERE value % 3 = 0")(lambda s: E.copy_if(s, lambda v: v % 3 == 0))
query("replace_value", _EV + "SELECT idx, CASE WHEN value % 10 = 4 THEN -1 ELSE value % 10 END AS value FROM ev")(lambda s: E.replace(E.transform(s, lambda v: v % 10), 4, -1))
query("replace_if", _EV + "SELECT idx, CASE WHEN value > 5000 THEN 0 ELSE value END AS value FROM ev")(lambda s: E.replace_if(s, lambda v: v > 5000, 0))
query("replace_count", _EV + "SELECT count(*) FILTER (WHERE value > 5000) AS count FROM ev")(lambda s: E.replaced(s, lambda v: v > 5000))
query("subview", _EV + "SELECT idx - 100 AS idx, value FROM ev WHERE idx >= 100 AND idx < 350")(lambda s: E.subview(s, 100, 250))
query("span_last", _EV + "SELECT idx - (n - 77) AS idx, value FROM ev WHERE idx >= n - 77")(lambda s: E.last(s, 77))
query("strided", _EV + "SELECT (idx - 3) // 7 AS idx, value FROM ev WHERE idx >= 3 AND (idx - 3) % 7 = 0")(lambda s: E.strided(s, 7, 3))
query("pipe_views", _EV + "SELECT (idx - 1) // 2 - 10 AS idx, value FROM ev WHERE idx % 2 = 1 AND (idx - 1) // 2 >= 10 AND (idx - 1) // 2 < 110")(
    lambda s: E.pipe(s, lambda x: E.strided(x, 2, 1), lambda x: E.drop(x, 10), lambda x: E.take(x, 100))
)
query("rotate", _EV + "SELECT ((idx - 37) % n + n) % n AS idx, value FROM ev")(lambda s: E.rotate(s, 37))
query("shift_left", _EV + "SELECT idx, lead(value, 5, 0) OVER (ORDER BY idx) AS value FROM ev")(lambda s: E.shift_left(s, 5, 0))
query("shift_right", _EV + "SELECT idx, lag(value, 5, -1) OVER (ORDER BY idx) AS value FROM ev")(lambda s: E.shift_right(s, 5, -1))
query("resize_shrink", _EV + "SELECT idx, value FROM ev WHERE idx < 123")(lambda s: E.resize(s, 123))
query("resize_grow", _EV + "SELECT idx, value FROM ev UNION ALL SELECT n + range, cast(9 AS BIGINT) FROM (SELECT max(n) AS n FROM ev), range(50)")(lambda s: E.resize(s, s.size + 50, 9))
query("point_put", _EV + "SELECT idx, CASE WHEN idx = 10 THEN cast(99 AS BIGINT) ELSE value END AS value FROM ev")(lambda s: E.transform_indexed(s, lambda i, v: F.when(i == 10, F.lit(99).cast("long")).otherwise(v)))
frame_query("iota_step", _N + "SELECT i AS idx, 5 + i * 3 AS value FROM r")(lambda spark, d: sources.iota(spark, sized(spark, d), 5, 3).df)
frame_query("local_iota", _N + f", b AS (SELECT i, {_block('n', 7, 'i')} AS b FROM r) SELECT i AS idx, i - min(i) OVER (PARTITION BY b) AS value FROM b")(lambda spark, d: sources.local_iota(spark, sized(spark, d), 7).df)
frame_query("generate", _N + "SELECT i AS idx, i * i % 97 AS value FROM r")(lambda spark, d: sources.generated(spark, sized(spark, d), lambda i: i * i % 97).df)

# search and reductions ---------------------------------------------------------------------------------------------
_FOUND = "SELECT count(*) > 0 AS found, min(idx) AS idx, arg_min(value, idx) AS value FROM ev WHERE "
query("find_value", _EV + _FOUND + "value = (SELECT value FROM ev WHERE idx = 200)")(lambda s: R.find(s, E.point_get(s, 200)))
query("find_if", _EV + _FOUND + "value > 9000")(lambda s: R.find_if(s, lambda v: v > 9000))
query("find_if_not", _EV + _FOUND + "NOT value > 100")(lambda s: R.find_if_not(s, lambda v: v > 100))
query("find_absent", _EV + _FOUND + "value = -12345")(lambda s: R.find(s, -12345))
query("find_if_in_blocks", _EV + f"SELECT {_block()} AS block, min(idx) AS idx FROM ev WHERE value > 9000 GROUP BY 1", ranks)(lambda s: R.find_if_in_blocks(s, lambda v: v > 9000))
query("count_value", _EV + "SELECT count(*) FILTER (WHERE value % 10 = 3) AS count FROM ev")(lambda s: R.count(E.transform(s, lambda v: v % 10), 3))
query("count_if", _EV + "SELECT count(*) FILTER (WHERE value % 2 = 0) AS count FROM ev")(lambda s: R.count_if(s, lambda v: v % 2 == 0))
query("predicates", _EV + "SELECT bool_and(value < 5000) AS all_of, bool_or(value < 5000) AS any_of, NOT bool_or(value < 5000) AS none_of FROM ev")(lambda s: R.predicates(s, lambda v: v < 5000))
query("predicates_empty", _EV + "SELECT coalesce(bool_and(value < 0), true) AS all_of, coalesce(bool_or(value < 0), false) AS any_of, NOT coalesce(bool_or(value < 0), false) AS none_of FROM ev WHERE idx < 0")(lambda s: R.predicates(E.take(s, 0), lambda v: v < 0))
for _op, _sql in {"sum": "10 + sum(value)", "min": "least(10, min(value))", "max": "greatest(10, max(value))", "band": "10 & bit_and(value)", "bor": "10 | bit_or(value)", "bxor": "xor(10, bit_xor(value))"}.items():
    query(f"reduce_{_op}", _EV + f"SELECT cast({_sql} AS BIGINT) AS value FROM ev")(lambda s, op=_op: R.reduce(s, op, F.lit(10).cast("long")))
for _op, _sql in {"land": "bool_and(value > 0)", "lor": "bool_or(value > 0)", "lxor": "count(*) FILTER (WHERE value > 0) % 2 = 1"}.items():
    query(f"reduce_{_op}", _EV + f"SELECT {_sql} AS value FROM ev")(lambda s, op=_op: R.transform_reduce(s, lambda v: v > 0, op))
query("reduce_product", _EV + "SELECT round(product(1 + (value % 7) / 10000000.0), 6) AS value FROM ev")(
    lambda s: R.transform_reduce(s, lambda v: 1 + (v % 7) / F.lit(10000000.0), "product").select(F.round("value", 6).alias("value"))
)
query("distributed_reduce", _EV + f", b AS (SELECT {_block()} AS block, value FROM ev) SELECT block, cast(sum(value) AS BIGINT) AS local, cast(sum(sum(value)) OVER () AS BIGINT) AS global FROM b GROUP BY block", ranks)(lambda s: R.distributed_reduce(s, "sum"))
query("transform_reduce", _EV + "SELECT cast(sum(value * value % 1009) AS BIGINT) AS value FROM ev")(lambda s: R.transform_reduce(s, lambda v: v * v % 1009, "sum"))
query("transform_reduce_pairs", _EV + "SELECT max(value - value % 1000) AS value FROM ev")(lambda s: R.transform_reduce_pairs(s, E.transform(s, lambda v: v % 1000), lambda a, b: a - b, "max"))
query("inner_product", _EV + "SELECT cast(5 + sum(value * (value % 10)) AS BIGINT) AS value FROM ev")(lambda s: R.inner_product(s, E.transform(s, lambda v: v % 10), F.lit(5).cast("long")))
query("sum_of_squares", _EV + "SELECT cast(sum((value % 1000) * (value % 1000)) AS BIGINT) AS value FROM ev")(lambda s: R.sum_of_squares(E.transform(s, lambda v: v % 1000)))
query("sum_of_abs", _EV + "SELECT cast(sum(abs(value - 5000)) AS BIGINT) AS value FROM ev")(lambda s: R.sum_of_abs(E.transform(s, lambda v: v - 5000)))
query("minloc", _EV + "SELECT min(value) AS value, min(idx) FILTER (WHERE value = lo) AS idx FROM (SELECT *, min(value) OVER () AS lo FROM ev)")(R.min_element)
query("maxloc", _EV + "SELECT max(value) AS value, min(idx) FILTER (WHERE value = hi) AS idx FROM (SELECT *, max(value) OVER () AS hi FROM ev)")(R.max_element)
query(
    "minmax_element",
    _EV + "SELECT min(value) AS min_value, min(idx) FILTER (WHERE value = lo) AS min_idx, max(value) AS max_value, min(idx) FILTER (WHERE value = hi) AS max_idx FROM (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM ev)",
)(R.minmax_element)
query(
    "block_minmax",
    _EV + f", b AS (SELECT *, {_block()} AS block FROM ev), c AS (SELECT *, min(value) OVER (PARTITION BY block) AS lo, max(value) OVER (PARTITION BY block) AS hi FROM b) "
    "SELECT block, min(lo) AS min_value, min(idx) FILTER (WHERE value = lo) AS min_idx, max(hi) AS max_value, min(idx) FILTER (WHERE value = hi) AS max_idx FROM c GROUP BY block",
    ranks,
)(R.block_min_max)
query("ordered_fold_concat", _EV + "SELECT 'x' || string_agg(cast(value % 10 AS VARCHAR), ',' ORDER BY idx) AS value FROM ev")(lambda s: R.concat_fold(E.transform(s, lambda v: v % 10), ",", "x"))
query("ordered_fold", _EV + "SELECT list_reduce(list_prepend(cast(1 AS BIGINT), list(value ORDER BY idx)), lambda a, v: (a * 31 + v) % 1000003) AS value FROM ev")(lambda s: R.ordered_fold(s, F.lit(1).cast("long"), lambda a, v: (a * 31 + v) % 1_000_003))
query("statistics", _EV + "SELECT count(*) AS count, cast(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max FROM ev")(R.statistics)


@frame_query("dot_embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE) * cast(x AS DOUBLE))), 4) AS dot FROM embeddings")
def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.array_dot(F.col("embedding"), F.col("embedding")), 4).alias("dot"))


# scans and neighbours ----------------------------------------------------------------------------------------------
query("inclusive_scan", _EV + f"SELECT idx, cast(sum(value) {_UP} AS BIGINT) AS value FROM ev")(S.inclusive_scan)
query("inclusive_scan_init", _EV + f"SELECT idx, cast(10 + sum(value) {_UP} AS BIGINT) AS value FROM ev")(lambda s: S.inclusive_scan(s, "sum", F.lit(10).cast("long")))
query("exclusive_scan", _EV + f"SELECT idx, cast(7 + coalesce(sum(value) {_PRE}, 0) AS BIGINT) AS value FROM ev")(lambda s: S.exclusive_scan(s, "sum", F.lit(7).cast("long")))
query("transform_inclusive_scan", _EV + f"SELECT idx, cast(sum(value % 100) {_UP} AS BIGINT) AS value FROM ev")(lambda s: S.transform_inclusive_scan(s, lambda v: v % 100))
query("transform_exclusive_scan", _EV + f"SELECT idx, cast(coalesce(sum(value % 100) {_PRE}, 0) AS BIGINT) AS value FROM ev")(lambda s: S.transform_exclusive_scan(s, lambda v: v % 100, "sum", F.lit(0).cast("long")))
query("scan_min", _EV + f"SELECT idx, min(value) {_UP} AS value FROM ev")(lambda s: S.scan(s, "min"))
query("scan_max", _EV + f"SELECT idx, max(value) {_UP} AS value FROM ev")(lambda s: S.scan(s, "max"))
query("scan_band", _EV + f"SELECT idx, bit_and(value | 1) {_UP} AS value FROM ev")(lambda s: S.scan(s, "band", rule=lambda v: v.bitwiseOR(F.lit(1).cast("long"))))
query("scan_bor", _EV + f"SELECT idx, bit_or(value % 64) {_UP} AS value FROM ev")(lambda s: S.scan(s, "bor", rule=lambda v: v % 64))
query("scan_product", _EV + f"SELECT idx, round(product(1 + (value % 7) / 10000000.0) {_UP}, 6) AS value FROM ev")(
    lambda s: E.transform(S.scan(E.transform(s, lambda v: 1 + (v % 7) / F.lit(10000000.0)), "product"), lambda v: F.round(v, 6))
)
query("scan_min_exclusive", _EV + f"SELECT idx, coalesce(min(value) {_PRE}, 9223372036854775807) AS value FROM ev")(lambda s: S.scan(s, "min", F.lit(2**63 - 1).cast("long"), exclusive=True))
query("local_scan_blocked", _EV + f", b AS (SELECT *, {_block()} AS block FROM ev) SELECT idx, cast(sum(value) OVER (PARTITION BY block ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM b", ranks)(S.local_scan)
query("exscan_blocks", _EV + f", b AS (SELECT {_block()} AS block, sum(value) AS t FROM ev GROUP BY 1) SELECT block, cast(coalesce(sum(t) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS value FROM b", ranks)(lambda s: S.block_scan(s, "sum", True).withColumn("value", F.coalesce("value", F.lit(0))))
query("adjacent_difference", _EV + "SELECT idx, coalesce(value - lag(value) OVER (ORDER BY idx), value) AS value FROM ev")(S.adjacent_difference)
query("halo_sum", _EV + "SELECT idx, cast(sum(value) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS value FROM ev")(
    lambda s: S.stencil(s, 2, lambda i, v, a, b: v + sum((F.coalesce(x, F.lit(0)) for x in (*a, *b)), F.lit(0)))
)
query("jacobi_step", _EV + "SELECT idx, CASE WHEN idx = 0 OR idx = n - 1 THEN cast(value AS DOUBLE) ELSE (lag(value) OVER (ORDER BY idx) + lead(value) OVER (ORDER BY idx)) / 2.0 END AS value FROM ev")(lambda s: jacobi_step(E.transform(s, lambda v: v.cast("double"))))
query("lag_default", _EV + "SELECT idx, lag(value, 3, 0) OVER (ORDER BY idx) AS value FROM ev")(lambda s: S.lag(s, 3, 0))

# views -------------------------------------------------------------------------------------------------------------
query("chunk_agg", _EV + "SELECT idx // 64 AS chunk, cast(sum(value) AS BIGINT) AS total, count(*) AS size FROM ev GROUP BY 1")(lambda s: V.chunks(s, 64, total=F.sum("value"), size=F.count("*")))
query("window_agg_stride", _EV + "SELECT idx AS start, total, high FROM (SELECT idx, n, cast(sum(value) OVER w AS BIGINT) AS total, max(value) OVER w AS high FROM ev WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE idx % 4 = 0 AND idx + 10 <= n")(
    lambda s: V.windows(s, 10, 4, total=lambda: F.sum("value"), high=lambda: F.max("value"))
)
query("chunk_by_islands", _EV + ", f AS (SELECT idx, value, CASE WHEN lag(value) OVER (ORDER BY idx) <= value THEN 0 ELSE 1 END AS f FROM ev), g AS (SELECT idx, value, sum(f) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS island FROM f) SELECT cast(island AS BIGINT) AS island, min(idx) AS start, count(*) AS size FROM g GROUP BY 1")(
    lambda s: V.chunk_by(s, lambda a, b: a <= b, start=F.min("idx"), size=F.count("*"))
)
query("segments", "SELECT * FROM (SELECT block, min(idx) AS global_offset, count(*) AS size FROM (" + _EV + f"SELECT idx, {_block()} AS block FROM ev) GROUP BY block)", ranks)(V.segments)


@frame_query("tile_agg", _EV + "SELECT (idx // 40) // 8 AS tile_i0, (idx % 40) // 7 AS tile_i1, cast(sum(value) AS BIGINT) AS total, count(*) AS size FROM ev GROUP BY 1, 2")
def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of 40, whatever their number, in tiles of 8 x 7."""
    s = events(spark, sf_dir)
    t = from_flat(s, (s.size // 40, 40))
    return V.tiles(t.df, {"i0": 8, "i1": 7}, total=F.sum("value"), size=F.count("*"))


# orders ------------------------------------------------------------------------------------------------------------
def orders(spark: SparkSession, sf_dir: str) -> Seq:
    """Orders by key, with their price."""
    return from_ordered(table(spark, sf_dir, "orders"), ["o_orderkey"], F.col("o_totalprice"))


_OR = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders) "
query("sort_reindex", _OR + "SELECT row_number() OVER (ORDER BY value, idx) - 1 AS idx, value, idx AS origin FROM o", orders)(O.sort)
query("sort_descending", _OR + "SELECT row_number() OVER (ORDER BY value DESC, idx) - 1 AS idx, value, idx AS origin FROM o", orders)(lambda s: O.sort(s, True))
query("stable_sort", _OR + "SELECT row_number() OVER (ORDER BY floor(value / 50000), idx) - 1 AS idx, floor(value / 50000) AS value, idx AS origin FROM o", orders)(
    lambda s: O.stable_sort(E.transform(s, lambda v: F.floor(v / 50000).cast("double")))
)
query("sort_by_key", _OR + "SELECT row_number() OVER (ORDER BY abs(value - 100000), idx) - 1 AS idx, value, idx AS origin FROM o", orders)(lambda s: O.sort_by(s, lambda v: F.abs(v - 100000)))
query("local_sort", _EV + f", b AS (SELECT *, {_block()} AS block FROM ev) SELECT min(idx) OVER (PARTITION BY block) + row_number() OVER (PARTITION BY block ORDER BY value, idx) - 1 AS idx, value FROM b", ranks)(O.local_sort)
_SORTED = "SELECT coalesce(bool_and(value >= b), true) AS is_sorted FROM (SELECT value, lag(value) OVER (ORDER BY idx) AS b FROM {}) t"
query("is_sorted", _EV + _SORTED.format("ev"))(O.is_sorted)
query("is_sorted_true", _OR + _SORTED.format("(SELECT row_number() OVER (ORDER BY value, idx) AS idx, value FROM o) u"), orders)(lambda s: O.is_sorted(O.sort(s)))
query("is_sorted_in_blocks", _EV + f", b AS (SELECT idx, value, {_block()} AS block FROM ev), c AS (SELECT block, value >= lag(value) OVER (PARTITION BY block ORDER BY idx) AS ok FROM b) SELECT block, coalesce(bool_and(ok), true) AS is_sorted FROM c GROUP BY block", ranks)(O.is_sorted_in_blocks)
_NTH = _OR + ", s AS (SELECT *, row_number() OVER (ORDER BY value, idx) - 1 AS p, count(*) OVER () AS n FROM o) SELECT true AS valid, value, idx FROM s WHERE p = "
frame_query("nth_element", _NTH + "777")(lambda spark, d: O.nth_of(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice", 777))
frame_query("median_upper", _NTH + "n // 2")(lambda spark, d: O.nth_of(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice"))
query("nth_of_sequence", _NTH + "n - 778", orders)(lambda s: O.nth_element(s, 777, descending=True).select("valid", "value", "idx"))
query("partial_sort", _OR + "SELECT value, idx FROM o ORDER BY value, idx LIMIT 100", orders)(lambda s: O.partial_sort(s, 100))
query("top_k", _OR + "SELECT value, idx FROM o ORDER BY value DESC, idx LIMIT 25", orders)(lambda s: O.top_k(s, 25))
query("bottom_k", _OR + "SELECT value, idx FROM o ORDER BY value, idx LIMIT 25", orders)(lambda s: O.bottom_k(s, 25))
query("stable_partition", _EV + "SELECT row_number() OVER (ORDER BY CASE WHEN value % 3 = 0 THEN 0 ELSE 1 END, idx) - 1 AS idx, value, idx AS origin FROM ev")(lambda s: O.partition(s, lambda v: v % 3 == 0))
query("partition_count", _EV + "SELECT count(*) FILTER (WHERE value % 3 = 0) AS count FROM ev")(lambda s: O.partition_count(s, lambda v: v % 3 == 0))
query("is_partitioned", _EV + "SELECT coalesce(max(idx) FILTER (WHERE idx < 500) < min(idx) FILTER (WHERE idx >= 500), true) AS is_partitioned FROM ev")(lambda s: O.is_partitioned(E.transform_indexed(s, lambda i, v: i), lambda v: v < 500))
query("partition_point", _EV + "SELECT coalesce(min(idx) FILTER (WHERE NOT idx < 500), any_value(n)) AS idx FROM ev")(lambda s: O.partition_point(E.transform_indexed(s, lambda i, v: i), lambda v: v < 500))
_U = _EV + ", u AS (SELECT idx, value % 3 AS value, lag(value % 3) OVER (ORDER BY idx) AS b FROM ev) "
query("unique_consecutive", _U + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, value FROM u WHERE b IS NULL OR b <> value")(lambda s: O.unique(E.transform(s, lambda v: v % 3)))
query("local_unique", _EV + f", b AS (SELECT idx, value % 3 AS value, {_block()} AS block FROM ev), c AS (SELECT block, value = lag(value) OVER (PARTITION BY block ORDER BY idx) AS same FROM b) SELECT block, count(*) FILTER (WHERE same) AS removed FROM c GROUP BY block", ranks)(
    lambda s: O.local_unique(E.transform(s, lambda v: v % 3))
)
query("count_duplicates", _U + "SELECT count(*) FILTER (WHERE b = value) AS count FROM u")(lambda s: O.count_duplicates(E.transform(s, lambda v: v % 3)))
query("has_duplicates", _U + "SELECT coalesce(bool_or(b = value), false) AS has_duplicates FROM u")(lambda s: O.has_duplicates(E.transform(s, lambda v: v % 3)))
query("distinct_values", _EV + "SELECT DISTINCT value % 100 AS value FROM ev")(lambda s: O.distinct(E.transform(s, lambda v: v % 100)))


@frame_query("order_by_text", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_name, c_custkey) - 1 AS idx, c_custkey AS value FROM customer")
def _by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ordered(table(spark, sf_dir, "customer"), [Key("c_mktsegment", True), "c_name", "c_custkey"], F.col("c_custkey"), store=False).df


@frame_query(
    "lineitem_running_quantity",
    "SELECT row_number() OVER w - 1 AS idx, cast(sum(cast(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM lineitem "
    "WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus)",
)
def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"]
    return S.inclusive_scan(from_ordered(table(spark, sf_dir, "lineitem"), order, F.col("l_quantity").cast("long"))).df.select("idx", "value")


# maps --------------------------------------------------------------------------------------------------------------
_M = "WITH m AS (SELECT s_suppkey AS key, s_nationkey AS value FROM supplier), r AS (SELECT o_custkey % 200 AS key, cast(o_orderkey % 1000 AS INTEGER) AS value, o_orderkey AS seq FROM orders) "


def _map(spark: SparkSession, sf_dir: str) -> tuple[KVMap, DataFrame]:
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("value"))
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("key"), (F.col("o_orderkey") % 1000).cast("int").alias("value"), F.col("o_orderkey").alias("seq"))
    return KVMap(m), r


def map_query(name: str, sql: str):
    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(*_map(spark, sf_dir))
        ORACLE_SQL[name] = _M + sql
        return make

    return add


map_query("map_insert_keep_first", "SELECT key, value FROM m UNION ALL SELECT key, arg_min(value, seq) FROM r WHERE key NOT IN (SELECT key FROM m) GROUP BY key")(lambda m, r: m.insert(r).df)
map_query("map_assign_keep_last", "SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT key, arg_max(value, seq) FROM r GROUP BY key")(lambda m, r: m.assign(r).df)
map_query("map_erase", "SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM r WHERE value < 300)")(lambda m, r: m.erase(r.where("value < 300")).df)
map_query("map_batch_find", "SELECT r.seq, r.key, coalesce(m.value, -1) AS value FROM r LEFT JOIN m ON r.key = m.key")(lambda m, r: m.find(r.select("seq", "key")).select("seq", "key", F.coalesce("value", F.lit(-1)).alias("value")))
map_query("map_contains", "SELECT r.seq, m.key IS NOT NULL AS contains FROM r LEFT JOIN m ON r.key = m.key")(lambda m, r: m.contains(r.select("seq", "key")).select("seq", "contains"))
map_query("map_word_count", "SELECT key, cast(sum(value) AS BIGINT) AS value FROM (SELECT key, value FROM m UNION ALL SELECT key, 1 FROM r) GROUP BY key")(lambda m, r: m.add(r.withColumn("value", F.lit(1))).df)
map_query("map_size", "SELECT count(*) AS size FROM m")(lambda m, r: m.size())
map_query(
    "map_apply_log",
    ", l AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'assign' ELSE 'erase' END AS op FROM r), i AS (SELECT key, value FROM m UNION ALL SELECT key, arg_min(value, seq) FROM l WHERE op = 'insert' AND key NOT IN (SELECT key FROM m) GROUP BY key), "
    "a AS (SELECT key, value FROM i WHERE key NOT IN (SELECT key FROM l WHERE op = 'assign') UNION ALL SELECT key, arg_max(value, seq) FROM l WHERE op = 'assign' GROUP BY key) SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM l WHERE op = 'erase' AND value < 20)",
)(lambda m, r: m.apply(r.withColumn("op", F.expr("CASE seq % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'assign' ELSE 'erase' END")).where("op <> 'erase' or value < 20")).df)

# partitions, collectives, scatter ----------------------------------------------------------------------------------
query("block_owner", _EV + f"SELECT idx, {_block()} AS owner, idx - min(idx) OVER (PARTITION BY {_block()}) AS local FROM ev", ranks)(lambda s: s.df.select("idx", P.block_owner(s.idx, s.size, BLOCKS).alias("owner"), P.block_to_local(s.idx, s.size, BLOCKS).alias("local")))
query("cyclic_owner", _EV + "SELECT idx, (idx // 5) % 3 AS owner, (idx // 15) * 5 + idx % 5 AS local FROM ev")(lambda s: s.df.select("idx", P.cyclic_owner(s.idx, 3, 5).alias("owner"), P.cyclic_to_local(s.idx, 3, 5).alias("local")))
query("dynamic_owner", _EV + "SELECT idx, CASE WHEN idx < 100 THEN 0 WHEN idx < 350 THEN 1 ELSE 2 END AS owner FROM ev")(lambda s: s.df.select("idx", P.dynamic_owner(s.idx, [100, 250, s.size - 350]).cast("int").alias("owner")))
query("custom_owner", _EV + "SELECT idx, (idx * 7) % 4 AS owner FROM ev")(lambda s: s.df.select("idx", P.custom_owner(s.idx, lambda i: i * 7 % 4).alias("owner")))
query("allreduce_per_block", _EV + f", b AS (SELECT DISTINCT {_block()} AS block FROM ev), t AS (SELECT max(value) AS value FROM ev) SELECT block, value FROM b, t", ranks)(lambda s: C.allreduce(R.with_block(s), "value", "max"))
query("alltoall_counts", _EV + f"SELECT {_block()} AS src, value % {BLOCKS} AS dst, count(*) AS n FROM ev GROUP BY 1, 2", ranks)(lambda s: C.alltoall_counts(s.df, P.block_owner(s.idx, s.size, BLOCKS), s.v % BLOCKS))
query("scatter_counts", _EV + "SELECT idx, value, CASE WHEN idx < 100 THEN 0 WHEN idx < 350 THEN 1 ELSE 2 END AS block FROM ev")(lambda s: C.scatter_counts(s, [100, 250, s.size - 350]).withColumn("block", F.col("block").cast("int")))
query("gather_block_sums", _EV + f", b AS (SELECT {_block()} AS block, cast(sum(value) AS BIGINT) AS local FROM ev GROUP BY 1) SELECT string_agg(cast(local AS VARCHAR), ',' ORDER BY block) AS joined FROM b", ranks)(
    lambda s: C.gather_row(R.block_reduce(s, "sum"), ["block"], "local").select(F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("joined"))
)
query("roles_reduce", _EV + f", b AS (SELECT value, {_block()} AS block FROM ev) SELECT CASE WHEN block < 2 THEN 'coordinator' WHEN block % 2 = 0 THEN 'even' ELSE 'worker' END AS role, cast(sum(value) AS BIGINT) AS value FROM b GROUP BY 1", ranks)(
    lambda s: C.with_role(R.with_block(s), {"coordinator": C.first_n(2), "even": C.every_nth(2), "worker": lambda b: F.lit(True)}).groupBy("role").agg(F.sum("value").alias("value"))
)
query("split_ranks", "SELECT block, block % 3 AS color, row_number() OVER (PARTITION BY block % 3 ORDER BY -block) - 1 AS rank FROM (SELECT range AS block FROM range(8))", ranks)(lambda s: C.split(V.segments(s).select("block"), F.col("block") % 3, -F.col("block")))
query("scatter_accumulate", _EV + ", u AS (SELECT o_custkey AS idx, cast(sum(o_orderkey) AS BIGINT) AS u FROM orders GROUP BY 1) SELECT ev.idx, value + coalesce(u, 0) AS value FROM ev LEFT JOIN u ON ev.idx = u.idx")(lambda s: s)


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idx"), F.col("o_orderkey").alias("value"))
    return C.scatter_reduce(events(spark, sf_dir), updates).df


QUERIES["scatter_accumulate"] = _scatter


# tensors and applications ------------------------------------------------------------------------------------------
#: The events as a tensor of 10 x 4 x k values.
_T = _EV + ", t AS (SELECT idx, value, n // 40 AS k FROM ev WHERE idx < n // 40 * 40) "


def tensor(spark: SparkSession, sf_dir: str) -> Tensor:
    s = events(spark, sf_dir)
    k = s.size // 40
    return from_flat(E.take(s, k * 40), (10, 4, k))


@frame_query("tensor_linearize", _T + "SELECT idx // (4 * k) AS i0, (idx // k) % 4 AS i1, idx % k AS i2, idx AS row_major, idx // (4 * k) + 10 * ((idx // k) % 4) + 40 * (idx % k) AS column_major FROM t")
def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor(spark, sf_dir)
    return t.df.select(*t.names, P.linear(t.coords, t.extents).alias("row_major"), P.linear(t.coords, t.extents, True).alias("column_major"))


@frame_query("tensor_reshape", _T + "SELECT idx // 20 AS i0, idx % 20 AS i1, value FROM t")
def _reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensor(spark, sf_dir)
    return t.reshape(t.size // 20, 20).df


@frame_query("tensor_grid_owner", _T + "SELECT idx // (4 * k) AS i0, (idx // k) % 4 AS i1, idx % k AS i2, (idx // (4 * k)) // 5 * 2 + ((idx // k) % 4) // 2 AS owner FROM t")
def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor(spark, sf_dir).grid_owners((2, 2, 1)).select("i0", "i1", "i2", "owner")
