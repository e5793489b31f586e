"""Skew-safe helpers against plain computations, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mxposture.operators import scale


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows, place = [], {}
    for _ in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}"
        place[key] = place.get(key, -1) + 1
        rows.append((key, place[key], rng.choice([None, 1, 2, 3]), float(rng.randrange(50)) / 7))
    return spark.createDataFrame(rows, "k string, ord bigint, v int, x double")


def test_running_equals_a_plain_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.select(
        "k", "ord", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"), F.last("v", ignorenulls=True).over(w).alias("l")
    )
    for width in (1, 7, 10_000):
        out = scale.running(df, ["k"], ["ord"], {"s": F.coalesce("v", F.lit(0))}, {"l": F.col("v")}, width)
        assert sorted(out.select("k", "ord", "s", "l").collect(), key=str) == sorted(plain.collect(), key=str)


def test_previous_value_crosses_chunks(spark):
    df = skewed(spark)
    plain = df.select("k", "ord", F.lag("v").over(Window.partitionBy("k").orderBy("ord")).alias("p"))
    out = scale.previous_value(df, ["k"], ["ord"], F.col("v"), "p", width=4)
    assert sorted(out.select("k", "ord", "p").collect(), key=str) == sorted(plain.collect(), key=str)


def quantile(values, q):
    ordered = sorted(values)
    rank = (len(ordered) - 1) * q
    low = ordered[int(rank)]
    high = ordered[min(int(rank) + (rank > int(rank)), len(ordered) - 1)]
    return low + (high - low) * (rank - int(rank))


def check_quantiles(spark, rows, edges):
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    groups = {}
    for k, x in rows:
        if x is not None and x == x:
            groups.setdefault(k, []).append(x)
    out = scale.exact_quantiles(df, ["k"], "x", {"med": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}, edges=edges)
    got = {r.k: (r.med, r.p90, r.least, r.most) for r in out.collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for g, q in zip(got[key], (0.5, 0.9, 0.0, 1.0)):
            assert abs(g - quantile(values, q)) <= 1e-9 * max(1, abs(g)), (key, q)


def test_exact_quantiles(spark):
    rows = [(r.k, float(r.x)) for r in skewed(spark).collect()]
    for edges in (2, 7, 1024):
        check_quantiles(spark, rows, edges)


def test_quantiles_over_many_decades_and_of_one_value(spark):
    rng = random.Random(6)
    rows = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6)) for _ in range(1500)]
    rows += [("same", 3.25)] * 900 + [("narrow", 1 + rng.random() * 1e-9) for _ in range(300)]
    rows += [("mixed", rng.choice([0.0, 0.0, 0.0, 1e-300, 1e300])) for _ in range(200)]
    rows += [("odd", None), ("odd", float("nan")), ("odd", 2.0), ("nothing", None), ("ends", float("inf")), ("ends", 1.0), ("ends", 2.0)]
    rows = [r for r in rows if r[0] != "ends"]
    for edges in (8, 1024):
        check_quantiles(spark, rows, edges)
    whole = scale.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), [], "x", {"med": 0.5}).first()
    assert abs(whole.med - quantile([x for _, x in rows if x is not None and x == x], 0.5)) < 1e-9
    assert scale.exact_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", {"med": 0.5}).count() == 0


def test_cumulative_share(spark):
    df = skewed(spark)
    plain = df.select("k", "x", (100 * F.cume_dist().over(Window.partitionBy("k").orderBy("x"))).alias("p")).distinct()
    out = scale.cumulative_share(df, ["k"], "x", F.floor(F.col("x")), "p")
    a = {(r.k, r.x): round(r.p, 9) for r in plain.collect()}
    assert {(r.k, r.x): round(r.p, 9) for r in out.collect()} == a


@pytest.mark.parametrize("most", [5, 60, 10**6])
def test_numbers_inside_a_key_of_any_size(spark, most):
    rng = random.Random(8)
    rows = [("hot", None if k == 3 else k % 700, k) for k in range(1000)] + [(rng.choice(["a", "b", None]), rng.randrange(50), 5000 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, x int, y int").repartition(6)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("x", "y")))
    got = scale.numbered(df, ["k"], ["x", "y"], "n", most=most)
    assert sorted(map(str, got.select("k", "x", "y", "n").collect())) == sorted(map(str, plain.collect()))
    assert scale.numbered(df.limit(0), ["k"], ["x"], "n").count() == 0


def test_exact_quantiles_leave_the_rows_in_place(spark):
    # Exploded rows look small to the planner; they must not be the side that is broadcast.
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.explode(F.expr("transform(sequence(1, 400), x -> double(x))")).alias("x"))
    out = scale.exact_quantiles(rows, ["k"], "x", {"med": 0.5})
    assert [r["med"] for r in out.collect()] == [200.5] * 3
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()


def test_join_few_by_real_size(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    few = scale.settled(spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice")))
    plans = []
    for most in (10, 9):
        monkeypatch.setattr(scale, "FEW_ROWS", most)
        out = scale.join_few(rows, few, ["k"])
        assert out.where("twice = 2 * k").count() == 1000
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]


def test_chain_walk_works_its_input_out_once(spark):
    from mxposture.operators import certificates

    read = spark.sparkContext.accumulator(0)

    def seen(subject):
        read.add(1)
        return subject

    # Ten chains of six certificates; the sixth's issuer is an anchor.
    rows = [(f"u{k}", "server", i, f"s{i}", f"s{i + 1}") for k in range(10) for i in range(6)]
    certs = spark.createDataFrame(rows, "uid string, role string, chain_index int, subject string, issuer string")
    certs = certs.withColumn("subject", F.udf(seen, "string")("subject"))
    anchors = spark.createDataFrame([("s6",)], "subject string")
    found = certificates._reached(certs, anchors, 16)
    assert {(r.uid, r.subject) for r in found.collect()} == {(f"u{k}", f"s{i}") for k in range(10) for i in range(1, 6)}
    assert read.value <= 60


def test_keys_of_ordinary_size_are_moved_once_for_running_values(spark):
    # Rows that no broadcast or local shortcut covers; what follows by key needs no further exchange.
    df = skewed(spark).repartition(4)
    out = scale.running(df, ["k"], ["ord"], {"s": F.coalesce("v", F.lit(0))}, {"l": F.col("v")})
    sums = out.groupBy("k", "s").agg(F.max("l").alias("l")).groupBy("k").agg(F.max("l").alias("l"))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    # A table with at least as many rows of each key may be counted in its place.
    some = df.where("ord < 5")
    want = scale.running(some, ["k"], ["ord"], {"s": F.lit(1)}).select("k", "ord", "s").collect()
    got = scale.running(some, ["k"], ["ord"], {"s": F.lit(1)}, width=9, counted=df).select("k", "ord", "s").collect()
    assert sorted(got) == sorted(want)


def test_rows_without_a_key_are_not_joined_in_one_task(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(8000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("d"), F.col("id") % 7)).alias("t"))
        side = spark.createDataFrame([("d1", 1), ("d2", 2), (None, 9)], "t string, hit int")
        out = scale.join_named(rows, side, "t", ["id"]).withColumn("part", F.spark_partition_id())
        assert max(r["count"] for r in out.groupBy("part").count().collect()) < 4000
        plain = rows.join(side, "t", "left")
        assert sorted(out.select("id", "t", "hit").collect()) == sorted(plain.select("id", "t", "hit").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_large_keys_are_bounded_before_their_rows_are_made(spark):
    df = spark.createDataFrame([("a", "xxxx"), ("a", "xx"), ("b", "xxx"), ("c", None)], "k string, s string")
    made = df.select("k", F.explode(F.split("s", "(?!^)")))
    counted = scale.large_keys(made, ["k"], most=5).collect()
    assert counted == scale.large_keys(df, ["k"], most=5, weight=F.length("s")).collect()
    assert [r.k for r in counted] == ["a"]


def test_rows_of_a_large_key_are_not_gathered_to_be_marked(spark):
    df = skewed(spark)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = scale.marked_large(df, ["k"], scale.large_keys(df, ["k"], 1000))
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.k for r in marked.where("_large").select("k").distinct().collect()} == {"hot"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
