"""A key above the limit is cut into slices; results must not change."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trawlspark.operators import skew
from trawlspark.operators.skew import Running, lay_out, ordered_slices, running


def rows(seed, n=3000):
    rng = random.Random(seed)
    # a third of the rows belong to one key, with many equal times
    return [
        (0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.randrange(50), i, rng.randrange(10))
        for i in range(n)
    ]


def test_running_values_equal_plain_windows(spark):
    df = spark.createDataFrame(rows(1), "k int, t int, id int, v int").repartition(5)
    columns = {
        "n": Running(F.lit(1)),
        "total": Running(F.col("v")),
        "earlier": Running(F.col("v"), before=True),
        "previous": Running(F.col("t"), "max", before=True),
    }
    cut = running(df, ["k"], ["t", "id"], columns, max_rows=100)
    w = Window.partitionBy("k").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "*",
        F.row_number().over(w).alias("n"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("earlier"),
        F.lag("t").over(w).alias("previous"),
    )
    assert sorted(map(tuple, cut.select(plain.columns).collect())) == sorted(
        map(tuple, plain.collect())
    ) or sorted(map(str, cut.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_spread_and_ordered(spark):
    df = spark.createDataFrame(rows(2), "k int, t int, id int, v int")
    cut, hot = ordered_slices(df, ["k"], ["t", "id"], 100)
    assert hot
    per_slice = cut.filter("k = 0").groupBy("_slice").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"),
        F.max(F.struct("t", "id")).alias("hi"),
    ).orderBy("_slice").collect()
    assert len(per_slice) > 3
    assert all(a.hi < b.lo for a, b in zip(per_slice, per_slice[1:]))
    # the other keys stay whole
    assert cut.filter("k <> 0").select("_slice").distinct().count() == 1


def test_bucketed_layout_joins_like_a_plain_join(spark):
    rng = random.Random(3)
    edges = [("hub" if rng.random() < 0.4 else f"p{rng.randrange(50)}", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(edges, "page string, to string")
    left = spark.createDataFrame([("hub", 1), ("p1", 2), ("p2", 3), ("none", 4)], "page string, x int")
    want = sorted(map(tuple, left.join(df, "page").select("page", "x", "to").collect()))
    for limit in (None, 100):
        layout = lay_out(df, "page", "to", limit)
        assert (layout.hot is None) == (limit is None)
        got = sorted(map(tuple, layout.join(left).select("page", "x", "to").collect()))
        assert got == want
        layout.drop()


def test_layout_side_is_not_shuffled(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("page"), F.lit("x").alias("to"))
    layout = lay_out(df, "page", "to")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.join(df.select("page"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    layout.drop()


def test_keys_with_one_hash_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "HASHES", 1)
    df = spark.createDataFrame([(f"p{i}", f"t{i % 3}") for i in range(12)], "page string, to string")
    layout = skew.lay_out(df, "page", "to", 5)
    assert layout.hot is None
    asked = spark.createDataFrame([("p3",), ("x",)], "page string")
    assert [tuple(r) for r in layout.join(asked).collect()] == [("p3", "t0")]
    layout.drop()


def test_given_slices(spark):
    df = spark.createDataFrame([(k, p, p % 3) for k in (1, 2) for p in range(1, 21)], "k int, p int, x int")
    got = skew.running(df, ["k"], ["p"], {"s": skew.Running(F.col("x"), before=True)}, slices=F.floor(F.col("p") / 4))
    assert {(r.k, r.p): r.s for r in got.collect()} == {(k, p): sum(q % 3 for q in range(1, p)) for k in (1, 2) for p in range(1, 21)}
