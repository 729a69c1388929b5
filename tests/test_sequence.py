"""Operators on literal sequences with results worked out by hand, for several numbers of blocks."""

import pytest
from pyspark.sql import functions as F

from ordinaut import partition as P
from ordinaut import sources as src
from ordinaut.errors import BadPartition, InvalidArgument, NullValue, OutOfBounds
from ordinaut.operators import elementwise as E
from ordinaut.operators import order as O
from ordinaut.operators import reduce as R
from ordinaut.operators import scan as S
from ordinaut.operators import views as V
from ordinaut.plans.blockscan import Key, by_order, dense_index
from ordinaut.seq import Seq, from_ordered

BLOCKS = (1, 3, 7)


def seq(spark, values, p=3, dtype="int64"):
    return src.from_values(spark, values, dtype, p)


def values(s):
    return [r[0] for r in s.df.orderBy("idx").select(s.value).collect()]


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("p", BLOCKS)
def test_scans_do_not_depend_on_blocks(spark, p):
    s = seq(spark, [1, 2, 3, 4], p)
    ten = F.lit(10).cast("long")
    assert values(S.inclusive_scan(s, "sum", ten)) == [11, 13, 16, 20]
    assert values(S.exclusive_scan(s, "sum", ten)) == [10, 11, 13, 16]
    assert values(S.scan(s, "max")) == [1, 2, 3, 4]
    assert values(S.scan(seq(spark, [1, 2, 3, 4, 5], p, "float64"), "product")) == [1, 2, 6, 24, 120]
    assert values(S.scan(s, "count")) == [1, 2, 3, 4]
    assert values(S.transform_inclusive_scan(s, lambda v: v * 2)) == [2, 6, 12, 20]
    assert values(S.adjacent_difference(seq(spark, [5, 1, 4, 2], p))) == [5, -4, 3, -2]


def test_scans_at_the_edges(spark):
    assert values(S.inclusive_scan(seq(spark, []))) == []
    assert values(S.inclusive_scan(seq(spark, [5]))) == [5]
    assert values(S.local_scan(seq(spark, [1] * 5, 2))) == [1, 2, 3, 1, 2]
    assert values(S.local_scan(seq(spark, [1] * 5, 2), exclusive=True, identity=0)) == [0, 1, 2, 0, 1]
    assert [tuple(r) for r in S.block_scan(seq(spark, [1, 2, 3, 4], 2), exclusive=True).orderBy("block").collect()] == [(0, None), (1, 3)]


@pytest.mark.parametrize("p", BLOCKS)
def test_neighbours(spark, p):
    s = seq(spark, list(range(10)), p)
    wide = S.stencil(s, 2, lambda i, v, a, b: v + sum((F.coalesce(x, F.lit(0)) for x in (*a, *b)), F.lit(0)))
    assert values(wide) == [sum(k for k in range(max(0, i - 2), min(10, i + 3))) for i in range(10)]
    assert values(S.lag(s, 3, -1)) == [-1, -1, -1, 0, 1, 2, 3, 4, 5, 6]
    assert values(S.lead(s, 3, -1)) == [3, 4, 5, 6, 7, 8, 9, -1, -1, -1]


@pytest.mark.parametrize("p", BLOCKS)
def test_runs(spark, p):
    s = seq(spark, [1, 1, 2, 3, 3, 3, 4], p)
    assert values(O.unique(s)) == [1, 2, 3, 4]
    assert one(O.count_duplicates(s)) == {"count": 3}
    assert one(O.has_duplicates(s)) == {"has_duplicates": True}
    assert one(O.has_duplicates(seq(spark, [1, 2, 1], p))) == {"has_duplicates": False}
    assert [tuple(r) for r in V.chunk_by(seq(spark, [1, 1, 2, 2, 2, 1], p)).orderBy("island").collect()] == [(0, 2), (1, 3), (2, 1)]
    assert values(O.unique(seq(spark, [], p))) == []


def test_rotate_and_shift(spark):
    assert values(E.rotate(seq(spark, [10, 20, 30, 40]), 1)) == [20, 30, 40, 10]
    assert values(E.rotate(seq(spark, [1, 2, 3, 4, 5]), 2)) == [3, 4, 5, 1, 2]
    assert values(E.rotate(seq(spark, [1, 2, 3, 4, 5]), -1)) == [5, 1, 2, 3, 4]
    assert values(E.rotate(seq(spark, [1, 2, 3, 4]), 6)) == [3, 4, 1, 2]
    s = seq(spark, [1, 2, 3])
    assert values(E.shift_left(s, 1, 0)) == [2, 3, 0] and values(E.shift_right(s, 1, 0)) == [0, 1, 2]
    assert values(E.shift_left(s, 9, 0)) == [0, 0, 0] and E.shift_kept(s, 9) == 0 and E.shift_kept(s, 1) == 2


def test_locations_take_the_first_place(spark):
    s = seq(spark, [3, 1, 2, 1, 3])
    assert one(R.min_element(s)) == {"value": 1, "idx": 1}
    assert one(R.max_element(s)) == {"value": 3, "idx": 0}
    assert one(R.minmax_element(s)) == {"min_value": 1, "min_idx": 1, "max_value": 3, "max_idx": 0}
    assert one(R.min_element(seq(spark, []))) == {"value": None, "idx": None}
    assert one(R.max_element(seq(spark, []))) == {"value": None, "idx": None}


def test_reductions(spark):
    s = seq(spark, [1, 2, 3, 4])
    for op, want in {"sum": 10, "min": 1, "max": 4, "band": 0, "bor": 7, "bxor": 4}.items():
        assert one(R.reduce(s, op)) == {"value": want}
    assert one(R.reduce(seq(spark, []), "sum", F.lit(7).cast("long"))) == {"value": 7}
    assert one(R.reduce(s, "min", F.lit(0).cast("long"))) == {"value": 0}
    assert one(R.transform_reduce(s, lambda v: v > 2, "lxor")) == {"value": False}
    assert one(R.inner_product(s, s)) == {"value": 30}
    assert one(R.concat_fold(s, "-")) == {"value": "1-2-3-4"}
    assert one(R.ordered_fold(s, F.lit(0).cast("long"), lambda a, v: a * 10 + v)) == {"value": 1234}
    assert one(R.fold_python(s, "", lambda a, v: a + str(v), lambda a, b: a + b, "string")) == {"value": "1234"}
    long = list(range(1, 40))
    want = 0
    for v in long:
        want = (want * 7 + v) % 1009
    assert all(one(R.ordered_fold(seq(spark, long), F.lit(0).cast("long"), lambda a, v: (a * 7 + v) % 1009, most=k)) == {"value": want} for k in (3, 10, 100))
    with pytest.raises(InvalidArgument):
        R.reduce(s, "mean")
    assert {r["local"] for r in R.distributed_reduce(seq(spark, [1, 2, 3, 4], 2), "sum").collect()} == {3, 7}


def test_search(spark):
    s = seq(spark, [2 * i for i in range(10)])
    assert one(R.find(s, 4)) == {"found": True, "idx": 2, "value": 4}
    assert one(R.find(s, 999)) == {"found": False, "idx": None, "value": None}
    assert one(R.find_if(seq(spark, [-1, -1, -1, 42, -1]), lambda v: v > 0))["idx"] == 3
    assert one(R.predicates(seq(spark, []), lambda v: v > 0)) == {"all_of": True, "any_of": False, "none_of": True}


@pytest.mark.parametrize("p", BLOCKS)
def test_sorts(spark, p):
    s = seq(spark, [5, 1, 4, 2, 1], p)
    assert values(O.sort(s)) == [1, 1, 2, 4, 5]
    assert values(O.sort(s, descending=True)) == [5, 4, 2, 1, 1]
    assert [r["origin"] for r in O.sort(s).df.orderBy("idx").collect()] == [1, 4, 3, 2, 0]
    assert values(O.sort_by(s, lambda v: -v)) == [5, 4, 2, 1, 1]
    assert one(O.is_sorted(s)) == {"is_sorted": False} and one(O.is_sorted(O.sort(s))) == {"is_sorted": True}
    assert one(O.is_sorted(seq(spark, [], p))) == {"is_sorted": True}
    assert one(O.median(seq(spark, [5, 1, 4, 2], p)))["value"] == 4
    assert one(O.nth_element(s, 9)) == {"valid": False, "value": None, "idx": None}
    assert values(O.partition(s, lambda v: v > 1)) == [5, 4, 2, 1, 1]
    assert [r["value"] for r in O.top_k(s, 2).collect()] == [5, 4]
    assert [r["value"] for r in O.bottom_k(s, 99).collect()] == [1, 1, 2, 4, 5]
    assert one(O.is_partitioned(s, lambda v: v > 9)) == {"is_partitioned": True}


def test_nth_element_of_many(spark):
    s = src.generated(spark, 200_000, lambda i: i * 7919 % 200_003, 4)
    want = sorted(i * 7919 % 200_003 for i in range(200_000))
    for n in (0, 12_345, 199_999):
        assert one(O.nth_element(s, n))["value"] == want[n]
        assert one(O.nth_element(s, n, descending=True))["value"] == want[-1 - n]


def test_nulls_and_nans_have_their_place(spark):
    """The order is Spark's own, for any number of blocks, few cuts or many."""
    import random

    draw = random.Random(1)
    rows = [(i, None if draw.random() < 0.2 else draw.choice([float("nan"), float(draw.randrange(9)), draw.random(), float("inf"), -0.0]), draw.choice(["a", "é", "\\", '"', "", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v double, t string").repartition(4)
    for order in ([Key("v"), Key("id")], [Key("v", True), Key("t"), Key("id")], [Key("t", True), Key("v"), Key("id", True)]):
        want = [r.id for r in df.orderBy(*(k.column for k in order)).collect()]
        for p in (1, 2, 8, 64, 100):
            assert [r.id for r in dense_index(df, order, 1500, p).orderBy("idx").collect()] == want
        assert by_order(df, order, 1500, 100).groupBy("_block").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("blocks", [1, 3, 20])
def test_keyed_scan_carries_over_blocks(spark, blocks):
    import random

    draw = random.Random(2)
    rows = [(draw.choice(["a", "a", "a", "b", "c", None]), i, draw.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for op, exclusive in (("sum", False), ("sum", True), ("max", False), ("count", False)):
        own, want = {}, {}
        for k, i, v in rows:
            own.setdefault(k, []).append(v)
            seen = own[k][:-1] if exclusive else own[k]
            want[i] = {"sum": sum(seen) if seen else None, "max": max(seen, default=None), "count": len(seen)}[op]
        assert {r.i: r.scan for r in S.keyed_scan(df, "k", ["i"], F.col("v"), op, exclusive, blocks=blocks).collect()} == want


def test_nth_of_a_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 37).cast("double").alias("v"))
    rows = sorted((r.k, r.v) for r in df.collect())
    place = {k: i for i, (k, _) in enumerate(rows)}
    for few in (1 << 17, 50):
        O.FEW = few
        for n in (0, 1, 500, 999):
            for down in (False, True):
                k, v = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))[n]
                assert one(O.nth_of(df, ["k"], "v", n, down)) == {"valid": True, "value": v, "idx": place[k]}
        assert one(O.nth_of(df, ["k"], "v"))["value"] == sorted(r[1] for r in rows)[500]
    O.FEW = 1 << 17
    assert one(O.nth_of(df, ["k"], "v", 1000)) == {"valid": False, "value": None, "idx": None}


def test_views(spark):
    s = seq(spark, list(range(20)))
    starts = [r["start"] for r in V.windows(s, 4, 3, n=lambda: F.count("*")).orderBy("start").collect()]
    assert starts == [0, 3, 6, 9, 12, 15] and V.n_windows(20, 4, 3) == 6
    assert [r["size"] for r in V.chunks(seq(spark, list(range(10))), 4).orderBy("chunk").collect()] == [4, 4, 2]
    assert V.windows(seq(spark, [1, 2]), 5, 1, n=lambda: F.count("*")).collect() == []
    assert [r["values"] for r in V.chunk_values(seq(spark, [1, 2, 3]), 2).orderBy("chunk").collect()] == [[1, 2], [3]]
    assert values(E.strided(s, 7, 3)) == [3, 10, 17] and E.strided(s, 3, 99).size == 0
    assert values(E.pipe(s, lambda x: E.strided(x, 2), lambda x: E.drop(x, 2), lambda x: E.take(x, 3))) == [4, 6, 8]
    with pytest.raises(OutOfBounds):
        E.subview(s, 15, 9)


def test_elementwise(spark):
    s = seq(spark, [3, -1, 4])
    assert values(E.transform(s, lambda v: v * v)) == [9, 1, 16]
    assert values(E.copy_if(s, lambda v: v > 0)) == [3, 4]
    assert values(E.transform_python(s, lambda v: v + 1, "long")) == [4, 0, 5]
    assert values(E.replace(s, 4, 0)) == [3, -1, 0]
    assert values(E.resize(s, 5, 8)) == [3, -1, 4, 8, 8] and values(E.resize(s, 1)) == [3]
    assert values(E.point_put(s, 1, 7)) == [3, 7, 4] and E.point_get(s, 2) == 4
    with pytest.raises(InvalidArgument):
        E.resize(Seq(s.df, 3, fixed=True), 4)
    with pytest.raises(InvalidArgument):
        E.zip_pairs(s, seq(spark, [1]))
    with pytest.raises(OutOfBounds):
        E.point_get(s, 3)


@pytest.mark.parametrize("n", [1000, 1001, 997, 3, 0])
@pytest.mark.parametrize("p", [1, 2, 4, 7])
def test_partitions_cover(spark, n, p):
    idx = F.col("id")
    got = spark.range(n).select(idx, P.block_owner(idx, n, p).alias("b"), P.block_to_local(idx, n, p).alias("l"), P.cyclic_owner(idx, p, 3).alias("c"), P.cyclic_to_local(idx, p, 3).alias("cl"))
    got = got.withColumn("g", P.block_to_global(F.col("b"), F.col("l"), n, p)).withColumn("cg", P.cyclic_to_global(F.col("c"), F.col("cl"), p, 3))
    assert got.where("g <> id or cg <> id or b < 0 or b >= " + str(p)).count() == 0
    sizes = spark.range(p).agg(F.sum(P.block_size(F.col("id"), n, p)), F.sum(P.cyclic_size(F.col("id"), n, p, 3))).first()
    assert tuple(sizes) == (n, n)


def test_checks(spark):
    with pytest.raises(BadPartition):
        P.dynamic_owner(F.col("idx"), [1, 2], 4)
    with pytest.raises(NullValue):
        Seq(spark.sql("select 0L idx, cast(null as int) value"), 1).checked()
    with pytest.raises(InvalidArgument):
        Seq(spark.sql("select 5L idx, 1 value"), 1).checked()
    assert src.from_numpy(spark, __import__("numpy").arange(5)).checked().size == 5
    assert src.to_numpy(src.iota(spark, 4, 1, 2)).tolist() == [1, 3, 5, 7]


def test_dense_index_by_any_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 3), ("a", 2), ("c", 0)], "k string, n int")
    assert [tuple(r) for r in dense_index(df, ["k", "n"], blocks=3).orderBy("idx").collect()] == [("a", 2, 0), ("a", 3, 1), ("b", 1, 2), ("c", 0, 3)]
    assert from_ordered(df, ["n"], F.col("k")).size == 4
    assert by_order(df.limit(0), ["k"], 0).count() == 0


def test_only_block_totals_meet_in_one_task(spark):
    plan = S.inclusive_scan(src.iota(spark, 1000, n_blocks=4)).df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_generated_by_state(spark):
    import itertools

    s = src.generated_by_state(spark, 10, lambda: itertools.count(1.0), 2)
    assert values(s) == [1, 2, 3, 4, 5, 1, 2, 3, 4, 5]


def test_files(spark, tmp_path):
    s = seq(spark, [3, 1, 2])
    for form in ("parquet", "orc", "json"):
        src.write(s, str(tmp_path / form), form)
        back = src.read(spark, str(tmp_path / form), form, None if form != "json" else s.df.schema)
        assert sorted(map(tuple, back.collect())) == [(0, 3), (1, 1), (2, 2)]
