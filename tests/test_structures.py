"""Maps, tensors, collectives, applications, futures and streams."""

import pytest
from pyspark.sql import functions as F

from ordinaut import futures as fu
from ordinaut import sources as src
from ordinaut import streaming as st
from ordinaut.errors import InvalidArgument, OutOfBounds
from ordinaut.operators import apps
from ordinaut.operators import collectives as C
from ordinaut.operators.kvmap import KVMap
from ordinaut.operators.tensor import Tensor, from_flat
from ordinaut.seq import Seq


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value int")


def log(spark, *ops):
    return spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "seq long, op string, key string, value int")


def test_map(spark):
    m = KVMap(kv(spark, ("a", 1), ("b", 2)))
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1), ("c", 4, 2)], "key string, value int, seq long")
    assert rows(m.insert(new).df) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(m.assign(new).df) == [("a", 1), ("b", 9), ("c", 4)]
    assert rows(m.erase(new).df) == [("a", 1)]
    assert rows(m.find(new.select("key")).distinct())[0] == ("b", 2)
    assert rows(m.contains(kv(spark, ("a", 0), ("z", 0)).select("key"))) == [("a", True), ("z", False)]
    assert rows(m.merge(KVMap(kv(spark, ("a", 7)))).df) == [("a", 7), ("b", 2)]
    assert rows(m.add(kv(spark, ("a", 1), ("a", 1))).df) == [("a", 3), ("b", 2)]
    assert m.size().first()[0] == 2 and m.clear().size().first()[0] == 0
    assert m.get("b").first()[0] == 2


def test_map_log_is_applied_by_kind(spark):
    got = KVMap(kv(spark)).apply(log(spark, ("erase", "a", 0), ("assign", "b", 5), ("insert", "a", 1), ("insert", "b", 2), ("insert", "c", 3)))
    assert rows(got.df) == [("b", 5), ("c", 3)]


def test_tensor(spark):
    t = Tensor(src.tensor_frame(spark, (3, 4), lambda i, j: i * 10 + j), (3, 4))
    assert t.at(2, 3).first()[0] == 23 and t.strides() == (4, 1) and t.size == 12
    assert src.to_numpy(t.flat()).tolist() == [i * 10 + j for i in range(3) for j in range(4)]
    assert rows(from_flat(src.iota(spark, 6), (2, 3), True).df)[1] == (0, 1, 2)
    assert t.reshape(2, 6).at(1, 0).first()[0] == 12
    assert t.owners(2).where("owner = 0").count() == 8
    with pytest.raises(InvalidArgument):
        t.reshape(5, 5)
    with pytest.raises(OutOfBounds):
        t.at(3, 0)


def test_collectives(spark):
    ranks = spark.range(5).select(F.col("id").alias("block"), (F.col("id") + 1).alias("value"))
    assert {r["value"] for r in C.allreduce(ranks, "value", "sum").collect()} == {15}
    assert rows(C.reduce_to_root(ranks, "value", "sum", 1))[1] == (1, 15)
    assert rows(C.broadcast(ranks, 3)) == [(b, 4) for b in range(5)]
    assert C.gather_row(ranks, ["block"], "value").first()[0] == [1, 2, 3, 4, 5]
    assert rows(C.gather(ranks, ["block"], "value", 2)) == [(2, b, b + 1) for b in range(5)] and C.allgather(ranks, ["block"], "value").count() == 25
    with pytest.raises(InvalidArgument):
        C.gather_row(ranks, ["block"], "value", most=4)
    assert C.replicated(ranks, 4) is ranks
    assert C.alltoall(spark.sql("select 1 src, 2 dst")).first().asDict() == {"dst": 1, "src": 2}
    assert rows(C.with_role(ranks, {"head": C.first_n(1), "tail": C.last_n(2, 5)}).select("block", F.coalesce("role", F.lit("-"))))[:2] == [(0, "head"), (1, "-")]
    seq = src.from_values(spark, [1, 2, 3])
    up = spark.createDataFrame([(0, 5), (0, 6), (2, 1)], "idx long, value long")
    assert src.to_numpy(C.scatter_reduce(seq, up)).tolist() == [12, 2, 4]
    slots = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "block int, slot int, value long")
    assert {(r["slot"], r["value"]) for r in C.allreduce(slots, "value", "sum", slot="slot").collect()} == {(0, 4), (1, 6)}


def test_applications(spark):
    assert abs(apps.monte_carlo_pi(spark, 200_000).first()[0] - 3.14159) < 0.02
    u, steps, change = apps.jacobi(src.from_values(spark, [1.0, 0.0, 0.0, 0.0, 0.0], "float64", 2), 1e-3, 40)
    assert change <= 1e-3 and abs(src.to_numpy(u) - [1, 0.75, 0.5, 0.25, 0]).max() < 0.02
    x, steps, rest = apps.conjugate_gradient(src.from_values(spark, [1.0, 0.0, 0.0, 1.0], "float64", 2), 1e-9, 20)
    assert rest < 1e-9 and abs(src.to_numpy(x) - 1).max() < 1e-8
    two = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "id int, x double, y double, z double, vx double, vy double, vz double, m double")
    force = {r["id"]: r["ax"] for r in apps.nbody_forces(two).collect()}
    assert abs(force[0] - 0.25) < 1e-6 and abs(force[0] + force[1]) < 1e-12
    assert abs(apps.nbody_step(two, 0.1).agg(F.sum("vx")).first()[0]) < 1e-12


def test_nbody_in_blocks(spark):
    bodies = spark.range(30).selectExpr("id", "sin(id) x", "cos(id * 3) y", "id / 7.0D z", "1.0D + id % 3 m")
    whole = {r["id"]: r for r in apps.nbody_forces(bodies).collect()}
    parts = {r["id"]: r for r in apps.nbody_forces(bodies, most=8).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i][c] - parts[i][c]) <= 1e-9 * (1 + abs(whole[i][c])) for i in whole for c in ("ax", "ay", "az"))


def test_futures(spark):
    count = fu.async_(spark.range(10).count)
    assert fu.then(count, lambda n: n + 1).result() == 11
    assert fu.when_all([fu.ready(1), count]).result() == [1, 10]
    assert fu.when_any([fu.ready(5)]).result() == (0, 5)
    assert fu.on_error(fu.failed(ValueError("x")), lambda e: str(e)).result() == "x"
    assert fu.flat_map(fu.ready(2), lambda v: fu.ready(v * 2)).result() == 4
    with pytest.raises(ValueError):
        fu.then(fu.failed(ValueError("x")), lambda v: v).result()


def test_stream_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = st.drain(st.tumbling(stream, "ts", "1 day", "30 days", "event_type", n=F.count("*")), "tumbled")
    want = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    key = lambda df: sorted((r["window"]["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(want)


def test_sequence_of_empty_blocks(spark):
    assert Seq(spark.range(0).select(F.col("id").alias("idx"), F.col("id").alias("value")), 0).checked().size == 0


def test_actions_and_observations(spark):
    from ordinaut import actions, observe

    if "double" not in actions._ACTIONS:

        @actions.action("double", "id long")
        def _double(frames):
            for pdf in frames:
                yield pdf * 2

    assert rows(actions.call(spark.range(3), "double")) == [(0,), (2,), (4,)]
    with pytest.raises(InvalidArgument):
        actions.call(spark.range(3), "none such")
    actions.register_sql(spark, "plus_one", lambda x: x + 1, "long")
    assert spark.sql("select plus_one(1)").first()[0] == 2
    df, seen = observe.observed(spark.range(5), "passed", **observe.histogram(F.col("id")))
    df.collect()
    assert seen.get == {"count": 5, "sum": 10, "min": 0, "max": 4}
    took = {}
    with observe.timed(took, "x"):
        pass
    assert took["x"] >= 0
