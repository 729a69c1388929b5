"""More queries: collectives, groups, maps, tensors, Python functions, applications, streams and asynchronous actions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import actions, futures, observe, sources, streaming
from .operators import apps
from .operators import collectives as C
from .operators import elementwise as E
from .operators import groups as G
from .operators import reduce as R
from .operators import scan as S
from .operators import views as V
from .plans.storage import scratch_path
from .queries import _EV, _M, _T, BLOCKS, QUERIES, _block, _map, events, frame_query, map_query, query, ranks, sized, table, tensor
from .seq import Seq

_B = _EV + f", b AS (SELECT idx, value, {_block()} AS block FROM ev) "
_L = _B + ", l AS (SELECT block, cast(sum(value) AS BIGINT) AS value FROM b GROUP BY 1) "

# containers --------------------------------------------------------------------------------------------------------
frame_query("filled", "SELECT unnest(range(n)) AS idx, cast(1.5 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM events)")(lambda spark, d: sources.filled(spark, sized(spark, d), 1.5, "float64").df)
query("fixed_sequence", _EV + "SELECT idx, value * 2 AS value FROM ev")(lambda s: E.transform(Seq(s.df, s.size, fixed=True), lambda v: v * 2))


@frame_query("numpy_round_trip", "SELECT o_orderkey AS idx, o_totalprice * 2 AS value FROM orders WHERE o_orderkey < 0 UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) - 1, cast(n_nationkey * n_regionkey AS DOUBLE) FROM nation")
def _numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table by way of an array: what fits the driver."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").toPandas()
    s = sources.from_numpy(spark, (rows.n_nationkey * rows.n_regionkey).to_numpy("float64"))
    return sources.from_values(spark, sources.to_numpy(s), "float64").df


@frame_query("values_by_type", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS idx, cast(r_regionkey AS SMALLINT) AS value, ((row_number() OVER (ORDER BY r_regionkey) - 1) // 2) % 2 AS owner FROM region")
def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    return sources.from_values(spark, keys, "int16", n_blocks=2, cyclic=2).df


# element-wise with Python, redistribution, side effects -------------------------------------------------------------
query("transform_python", _EV + "SELECT idx, value * 2 + 1 AS value FROM ev")(lambda s: E.transform_python(s, lambda v: v * 2 + 1, "long"))
query("redistribute", _EV + f"SELECT idx, value, {_block('n', 5)} AS block FROM ev")(lambda s: R.with_block(E.redistribute(s, 5)))


@query("for_each", _EV + "SELECT count(*) AS rows, cast(sum(value) AS BIGINT) AS total FROM ev")
def _for_each(s: Seq) -> DataFrame:
    spark = s.df.sparkSession
    rows, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def action(part) -> None:
        n = t = 0
        for row in part:
            n, t = n + 1, t + row.value
        rows.add(n)
        total.add(t)

    E.for_each(s, action)
    return spark.createDataFrame([(rows.value, total.value)], "rows long, total long")


@query("for_each_segment", _B + "SELECT block, first(value ORDER BY idx) AS head, count(*) AS size FROM b GROUP BY 1", ranks)
def _segments(s: Seq) -> DataFrame:
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "head": [pdf["value"].iloc[0]], "size": [len(pdf)]})

    return V.for_each_segment(s, one, "block long, head long, size long")


query("fold_python", _EV + "SELECT cast(sum(value) % 99991 AS BIGINT) AS value FROM ev")(lambda s: R.fold_python(s, 0, lambda a, v: (a + v) % 99991, lambda a, b: (a + b) % 99991, "long"))


@query("named_action", _EV + "SELECT idx, value - 7 AS value FROM ev")
def _named(s: Seq) -> DataFrame:
    if "less_seven" not in actions._ACTIONS:

        @actions.action("less_seven", "idx long, value long")
        def _less(frames):
            for pdf in frames:
                yield pdf.assign(value=pdf["value"] - 7)

    return actions.call(s.df, "less_seven")


@query("metrics", _EV + "SELECT count(*) AS count, cast(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max FROM ev")
def _metrics(s: Seq) -> DataFrame:
    """What passed, seen beside another action."""
    df, seen = observe.observed(s.df, f"events-{uuid.uuid4().hex}", **observe.histogram(s.v))
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return s.df.sparkSession.createDataFrame([tuple(got[k] for k in ("count", "sum", "min", "max"))], "count long, sum long, min long, max long")


# collectives ---------------------------------------------------------------------------------------------------------
def sums(s: Seq) -> DataFrame:
    return R.block_reduce(s, "sum").withColumnRenamed("local", "value")


query("broadcast", _B + f"SELECT p.p AS block, b.idx, b.value FROM b, (SELECT unnest(range({BLOCKS})) AS p) p WHERE b.block = 3", ranks)(lambda s: C.broadcast(R.with_block(s), 3))
query("reduce_to_root", _L + "SELECT block, CASE WHEN block = 2 THEN (SELECT cast(sum(value) AS BIGINT) FROM l) END AS value FROM l", ranks)(lambda s: C.reduce_to_root(sums(s), "value", "sum", 2))
query("gather", _EV + "SELECT cast(1 AS BIGINT) AS block, row_number() OVER (ORDER BY value, idx) - 1 AS idx, value FROM ev")(lambda s: C.gather(s.df.select(F.col("value").alias("v"), "idx", "value"), ["v", "idx"], "value", 1))
query("allgather", _L + "SELECT a.block, row_number() OVER (PARTITION BY a.block ORDER BY l.block) - 1 AS idx, l.value FROM l, (SELECT block FROM l) a", ranks)(lambda s: C.allgather(sums(s), ["block"], "value"))
query("alltoall", _B + f"SELECT value % {BLOCKS} AS src, block AS dst, count(*) AS n FROM b GROUP BY 1, 2", ranks)(
    lambda s: C.alltoall(C.alltoall_counts(R.with_block(s), F.col("block"), F.col("value") % BLOCKS)).select("src", "dst", "n")
)
query("allreduce_by_slot", _B + ", s AS (SELECT block, value % 5 AS slot, cast(sum(value) AS BIGINT) AS value FROM b GROUP BY 1, 2) SELECT block, slot, cast(sum(value) OVER (PARTITION BY slot) AS BIGINT) AS value FROM s", ranks)(
    lambda s: C.allreduce(R.with_block(s).groupBy("block", (F.col("value") % 5).alias("slot")).agg(F.sum("value").alias("value")), "value", "sum", slot="slot").select("block", "slot", "value")
)
query("replicated_operand", _EV + "SELECT idx, value * (n_regionkey + 1) AS value FROM ev JOIN nation ON value % 25 = n_nationkey")(lambda s: s)


def _replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = C.replicated(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    return events(spark, sf_dir).df.join(few, F.col("value") % 25 == F.col("n_nationkey")).select("idx", (F.col("value") * (F.col("n_regionkey") + 1)).alias("value"))


QUERIES["replicated_operand"] = _replicated


@frame_query(
    "get_accumulate",
    _EV + ", u AS (SELECT o_orderkey AS seq, o_custkey AS idx, o_orderkey % 10 AS value FROM orders) "
    "SELECT seq, u.idx, cast(ev.value + coalesce(sum(u.value) OVER (PARTITION BY u.idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS old FROM u JOIN ev ON ev.idx = u.idx",
)
def _fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("idx"), (F.col("o_orderkey") % 10).alias("value"))
    return C.get_accumulate(events(spark, sf_dir), updates)


@frame_query("keyed_scan", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS high FROM orders")
def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys hold all rows: each is scanned by several blocks."""
    rows = S.keyed_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", ["o_orderkey"], F.col("o_totalprice"), "max")
    return rows.select("o_orderkey", F.col("scan").alias("high"))


# groups ----------------------------------------------------------------------------------------------------------------
query("group_transfer", _L + "SELECT block + 4 AS block, value FROM l WHERE block < 4", ranks)(lambda s: G.transfer(sums(s), G.first_n(4), G.last_n(4), BLOCKS))
query("group_multicast", _L + "SELECT g AS group, cast(t AS BIGINT) AS block, value FROM l, (VALUES (0, 1), (0, 3), (0, 5), (0, 7), (1, 6), (1, 7)) v(g, t) WHERE l.block = 0", ranks)(
    lambda s: G.multicast(sums(s), G.first_only(), [G.every_nth(2, 1), G.last_n(2), G.nobody()], BLOCKS)
)
query("group_forward", _L + "SELECT cast(7 AS BIGINT) AS block, value + 3 AS value FROM l WHERE block = 1", ranks)(
    lambda s: G.forward(sums(s), [G.specific([1, 2]), G.between(3, 6), G.last_only()], BLOCKS, [lambda df: df.withColumn("value", F.col("value") + 1), lambda df: df.withColumn("value", F.col("value") + 2)])
)
query("group_reduce", _L + "SELECT cast(4 AS BIGINT) AS block, cast(sum(value) AS BIGINT) AS value FROM l WHERE block < 4", ranks)(lambda s: G.reduce(sums(s), "value", "sum", G.fraction(0.5), G.last_n(4), BLOCKS))
query("group_gather", _L + "SELECT cast(0 AS BIGINT) AS block, block AS local, value FROM l", ranks)(lambda s: G.gather(sums(s), G.everyone(), G.first_only(), BLOCKS))
query("group_receive", _L + "SELECT cast(7 AS BIGINT) AS block, CASE block WHEN 0 THEN 0 ELSE 1 END AS source, value FROM l WHERE block IN (0, 4)", ranks)(lambda s: G.multi_receive(sums(s), [G.first_n(3), G.between(4, 6)], G.last_only(), BLOCKS))
query("group_scatter", _B + "SELECT idx + 6 AS block, idx, value FROM b WHERE idx < 2", ranks)(lambda s: G.scatter(R.with_block(s), "idx", G.first_only(), G.last_n(2), BLOCKS).select("block", "idx", "value"))

# maps --------------------------------------------------------------------------------------------------------------------
map_query("map_merge", "SELECT key, value FROM m WHERE key > 20 UNION ALL SELECT key, 5 FROM m WHERE key <= 20 UNION ALL SELECT -1, 5")(
    lambda m, r: m.merge(type(m)(m.df.where("key <= 20").select("key", F.lit(5).alias("value")).unionAll(m.df.sparkSession.sql("SELECT -1L AS key, 5 AS value"))))
    .df
)
map_query("map_get", "SELECT value FROM m WHERE key = 7")(lambda m, r: m.get(7))
map_query("map_get_or", "SELECT -3 AS value")(lambda m, r: m.get_or(-99, -3))
map_query("map_put_discard", "SELECT key, CASE key WHEN 3 THEN 77 ELSE value END AS value FROM m WHERE key <> 4")(lambda m, r: m.put(3, 77).discard(4).df)
map_query("map_owners", "SELECT key, cast(1 AS BIGINT) AS owners, true AS inside FROM r GROUP BY key")(
    lambda m, r: r.groupBy("key").agg(F.count_distinct(m.owner(4)).alias("owners"), F.bool_and(m.owner(4).between(0, 3)).alias("inside"))
)
map_query("map_local_sizes", "SELECT cast(count(*) AS BIGINT) AS size FROM m")(lambda m, r: m.local_sizes(4).agg(F.sum("size").alias("size")))
map_query("map_items", "SELECT key, value FROM m")(lambda m, r: m.items(4).orderBy("owner", "key").select("key", "value"))
map_query("map_clear", "SELECT key, value FROM m WHERE false")(lambda m, r: m.clear().df)


# tensors -------------------------------------------------------------------------------------------------------------
frame_query("tensor_at", _T + "SELECT value FROM t WHERE idx // (4 * k) = 7 AND (idx // k) % 4 = 2 AND idx % k = 5")(lambda spark, d: tensor(spark, d).at(7, 2, 5))
frame_query("tensor_partition", _T + "SELECT idx // (4 * k) AS i0, (idx // k) % 4 AS i1, idx % k AS i2, CASE WHEN idx // (4 * k) < 4 THEN 0 ELSE ((idx // (4 * k)) - 4) // 3 + 1 END AS owner, CASE WHEN idx // (4 * k) < 4 THEN idx // (4 * k) ELSE ((idx // (4 * k)) - 4) % 3 END AS local FROM t")(
    lambda spark, d: tensor(spark, d).owners(3).select("i0", "i1", "i2", "owner", "local")
)
frame_query("tensor_strides", "SELECT unnest([0, 1, 2]) AS dimension, unnest([4 * k, k, 1]) AS stride FROM (SELECT count(*) // 40 AS k FROM events)")(
    lambda spark, d: spark.createDataFrame(list(enumerate(tensor(spark, d).strides())), "dimension int, stride long")
)
frame_query("tensor_flat", _T + "SELECT idx, value FROM t")(lambda spark, d: tensor(spark, d).flat().df)
frame_query("tile_agg_3d", _T + "SELECT (idx // (4 * k)) // 3 AS tile_i0, ((idx // k) % 4) // 3 AS tile_i1, (idx % k) // 9 AS tile_i2, cast(sum(value) AS BIGINT) AS total, count(*) AS size FROM t GROUP BY 1, 2, 3")(
    lambda spark, d: V.tiles(tensor(spark, d).df, {"i0": 3, "i1": 3, "i2": 9}, total=F.sum("value"), size=F.count("*"))
)


# applications ----------------------------------------------------------------------------------------------------------
_MEAN = "SELECT idx, n, CASE WHEN idx = 0 OR idx = n - 1 THEN value ELSE (lag(value) OVER (ORDER BY idx) + lead(value) OVER (ORDER BY idx)) / 2 END AS value FROM "
query("jacobi", _EV + "SELECT idx, value FROM (" + _MEAN + "(" + _MEAN + "(" + _MEAN + "(SELECT idx, n, cast(value AS DOUBLE) AS value FROM ev) a) b) c) d")(lambda s: apps.jacobi(E.transform(s, lambda v: v.cast("double")), 0.0, 3, 3)[0])

_BODIES = (
    "SELECT vec_id AS id, list_sum(list_transform(embedding[1:21], lambda e: cast(e AS DOUBLE))) AS x, list_sum(list_transform(embedding[22:42], lambda e: cast(e AS DOUBLE))) AS y, "
    "list_sum(list_transform(embedding[43:64], lambda e: cast(e AS DOUBLE))) AS z FROM embeddings"
)


def _pull(of: str) -> str:
    r = "((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) + 0.01)"
    return "SELECT p.id, " + ", ".join(f"sum((q.{c} - p.{c}) / ({r} * sqrt({r}))) AS a{c}" for c in "xyz") + f" FROM {of} p JOIN {of} q ON p.id <> q.id GROUP BY p.id"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body for each embedding: its place is the sums of the three thirds of the vector."""
    part = lambda a, n: F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, e: s + e.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), part(1, 21).alias("x"), part(22, 21).alias("y"), part(43, 22).alias("z"), F.lit(1.0).alias("m"))


@frame_query("nbody_forces", f"WITH s AS ({_BODIES}) SELECT id, round(ax, 4) AS ax, round(ay, 4) AS ay, round(az, 4) AS az FROM ({_pull('s')})")
def _nbody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps.nbody_forces(bodies(spark, sf_dir), softening=0.01).select("id", *(F.round(f"a{c}", 4).alias(f"a{c}") for c in "xyz"))


@frame_query(
    "nbody_step",
    f"WITH s AS ({_BODIES}), f AS ({_pull('s')}), h AS (SELECT id, " + ", ".join(f"{c} + a{c} * 0.0005 * 0.001 AS {c}, a{c} * 0.0005 AS v{c}" for c in "xyz") + f" FROM s JOIN f USING (id)), g AS ({_pull('h')}) "
    "SELECT id, round(x, 6) AS x, round(vx + ax * 0.0005, 6) AS vx FROM h JOIN g USING (id)",
)
def _step(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = bodies(spark, sf_dir).select("id", "x", "y", "z", *(F.lit(0.0).alias(f"v{c}") for c in "xyz"), "m")
    return apps.nbody_step(still, 0.001, softening=0.01).select("id", F.round("x", 6).alias("x"), F.round("vx", 6).alias("vx"))


@query("conjugate_gradient", _EV + "SELECT i.idx, round(sum(CASE WHEN i.idx <= j.idx THEN (i.idx + 1) * (8 - j.idx) ELSE (j.idx + 1) * (8 - i.idx) END / 9.0 * j.value), 2) AS value FROM ev i, ev j WHERE i.idx < 8 AND j.idx < 8 GROUP BY 1")
def _solve(s: Seq) -> DataFrame:
    """As many steps as unknowns, so that many are taken; the solution in closed form is the other side."""
    x, _, _ = apps.conjugate_gradient(E.transform(E.take(s, 8), lambda v: v.cast("double")), 1e-6, 40)
    return x.df.select("idx", F.round("value", 2).alias("value"))


_DRAW = "cast('0x' || substr(md5('{}:' || i), 1, 8) AS BIGINT) / 4294967296.0"
frame_query("monte_carlo_pi", f"SELECT 4 * count(*) FILTER (WHERE pow({_DRAW.format(42)}, 2) + pow({_DRAW.format(43)}, 2) <= 1) / cast(count(*) AS DOUBLE) AS pi FROM (SELECT unnest(range(50 * n)) AS i FROM (SELECT count(*) AS n FROM events))")(
    lambda spark, d: apps.monte_carlo_pi(spark, 50 * sized(spark, d))
)


# streams and asynchronous actions ----------------------------------------------------------------------------------------
@frame_query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, cast(sum(cast(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows over a stream of the events; a last batch closes none early, as all rows of the file come at once."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(F.col("value") * 100).cast("long").alias("value"))
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = streaming.tumbling(stream, "ts", "1 day", "400 days", "event_type", n=F.count("*"), total=F.sum("value"))
    return streaming.drain(out, f"tumbled_{uuid.uuid4().hex}").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("async_sums", _EV + "SELECT cast(sum(value) AS BIGINT) + max(value) AS value, cast(count(*) AS BIGINT) AS count FROM ev")
def _async(s: Seq) -> DataFrame:
    parts = [futures.async_(lambda c=c: s.df.agg(c).first()[0]) for c in (F.sum("value"), F.max("value"), F.count("*"))]
    both = futures.chain(futures.when_all(parts[:2]), sum, int)
    value, count = futures.when_all([both, futures.on_error(parts[2], lambda e: -1)]).result()
    return s.df.sparkSession.createDataFrame([(value, count)], "value long, count long")
