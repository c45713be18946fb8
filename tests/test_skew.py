"""Joins with hot keys: the same rows as a plain join, spread over the partitions."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from weftline.operators import skew
from weftline.operators.fusion import fuse_columns, run_fusion
from weftline.workspace import Workspace

HOWS = ["inner", "left", "right", "outer"]


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _data(spark, n, hot, name, nulls=True, step=1):
    """A third of the rows on key ``hot``, some null keys, the rest on distinct keys."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit(hot))
        .when((F.col("id") % 7 == 0) & F.lit(nulls), F.lit(None))
        .otherwise(F.col("id") * step)
    )
    return spark.range(0, n, 1, 4).select(key.alias("k"), F.col("id").alias(name))


def _same(spark, inputs, keys, how, hot_rows=10):
    workspace = Workspace(spark)
    for name, df in inputs.items():
        workspace.add(name, df)
    names = list(inputs)
    salted = fuse_columns(workspace, names, keys, how, "salt", hot_rows)
    plain = fuse_columns(workspace, names, keys, how, "adaptive")
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)
    return salted


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize(
    "left_hot, right_hot", [(1, None), (None, 1), (1, 1), (1, 2), (-5, None), (None, -5)]
)
def test_two_inputs(spark, how, left_hot, right_hot):
    left = _data(spark, 90, left_hot or 1_000, "l")
    right = _data(spark, 60, right_hot or 2_000, "r", step=2)
    _same(spark, {"left": left, "right": right}, "k", how)


@pytest.mark.parametrize("how", HOWS)
def test_three_inputs(spark, how):
    _same(
        spark,
        {
            "a": _data(spark, 60, 1, "a"),
            "b": spark.range(1, 30).select(F.col("id").alias("k"), F.col("id").alias("b")),
            "c": _data(spark, 45, 2, "c", step=2),
        },
        "k",
        how,
    )


@pytest.mark.parametrize("how", ["left", "outer"])
def test_composite_keys_of_awkward_types(spark, how):
    left = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, F.lit("ab")).otherwise(F.lit("a")).alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("d"),
        F.timestamp_seconds(F.col("id") % 2).alias("t"),
        F.col("id").alias("l"),
    )
    right = left.where("id % 5 <> 1").withColumnRenamed("l", "r").withColumn("d", F.lit(0.0))
    _same(spark, {"left": left, "right": right}, ["k", "d", "t"], how)


def test_frequent_keys_of_a_summary(spark):
    found = skew.summarize(_data(spark, 900, 1, "l"), ["k"])
    assert found.heavy == {1: 301, None: 86} and found.light < 1.1
    assert found.hot(300) and not found.hot(302)
    doubled = skew.summarize(_data(spark, 900, 1, "l"), ["k"], F.lit(2.0))
    assert doubled.heavy == {1: 602, None: 172}
    empty = skew.summarize(_data(spark, 0, 1, "l"), ["k"])
    assert empty.heavy == {} and not empty.hot(1)


def test_joins_that_broadcast_need_no_lookup(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/small")
    spark.range(300_000).write.parquet(f"{tmp_path}/large")
    small, large = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("small", "large"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    both_ways = ([small, large], [large, small])
    expected = {"inner": [True, True], "left": [False, True], "right": [True, False],
                "outer": [False, False]}
    for how, answers in expected.items():
        assert [skew.broadcasts(inputs, how) for inputs in both_ways] == answers
        for inputs, answer in zip(both_ways, answers):
            joined = inputs[0].join(inputs[1], "id", how)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == answer
    assert skew.broadcasts([large, small, small], "left")
    assert not skew.broadcasts([large, small, large], "inner")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert not skew.broadcasts([large, small], "inner")


def test_joined_summary():
    left = skew.KeySummary({"a": 2, "b": 3, None: 4}, 1.5)
    right = skew.KeySummary({"a": 5, "c": 7, None: 6}, 2.0)
    inner = skew.joined_summary(left, right, "inner")
    assert inner.heavy == {"a": 10, "b": 6, "c": 10.5} and inner.light == 3.0
    assert skew.joined_summary(left, right, "left").heavy[None] == 4
    assert skew.joined_summary(left, right, "right").heavy[None] == 6
    assert skew.joined_summary(left, right, "outer").heavy[None] == 10


@pytest.mark.parametrize("how", HOWS)
def test_hot_null_keys(spark, how):
    left = spark.range(0, 300, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("l")
    )
    right = left.select((F.col("k") * 3).alias("k"), F.col("l").alias("r"))
    known = [skew.summarize(df, ["k"]) for df in (left, right)]
    assert [side.heavy for side in known] == [{None: 150}, {None: 150}]
    _same(spark, {"left": left, "right": right, "again": left.select("k")}, "k", how, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = skew.salted_join(left, right, ["k"], how, *known, 20)
    nulls = df.where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(nulls) == 0 if how == "inner" else len(nulls) > 2


@pytest.mark.parametrize("side", ["left", "right"])
def test_a_hot_key_does_not_end_up_in_one_partition(spark, side):
    big = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("big"),
    )
    small = spark.range(0, 40_000, 7).select(F.col("id").alias("k"), F.col("id").alias("small"))
    small = small.union(spark.createDataFrame([(1, 1)], "k long, small long"))
    workspace = Workspace(spark)
    workspace.add("big", big)
    workspace.add("small", small)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    order = ["big", "small"] if side == "left" else ["small", "big"]
    largest = {}
    for mode in ("adaptive", "salt"):
        df = fuse_columns(workspace, order, "k", "outer", mode, 1_000)
        per_partition = df.groupBy(F.spark_partition_id().alias("p")).count()
        largest[mode] = per_partition.agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest["adaptive"] > 16_000  # the hot key's 13,334 rows and a share of the rest
    assert largest["salt"] < 0.75 * largest["adaptive"]


def test_equal_rows_spread_too(spark):
    copies = spark.range(0, 8_000, 1, 8).select(F.lit(1).alias("k"))
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    workspace = Workspace(spark)
    workspace.add("copies", copies)
    workspace.add("one", one)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = fuse_columns(workspace, ["copies", "one"], "k", "outer", "salt", 100)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 8_000 and len(sizes) >= 3


def _largest(df):
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
    return sizes.agg(F.max("count"), F.count("*")).first()


@pytest.mark.parametrize("before", ["one partition", "same key"])
def test_a_hot_key_in_one_partition_spreads(spark, before):
    big = spark.range(0, 16_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("big"),
    )
    big = big.repartition(1) if before == "one partition" else big.repartition(8, "k")
    small = spark.range(0, 16_000, 5).select(F.col("id").alias("k"), F.col("id").alias("small"))
    small = small.union(spark.createDataFrame([(1, 1)], "k long, small long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    known = [skew.summarize(df, ["k"]) for df in (big, small)]
    joined = skew.salted_join(big, small, ["k"], "left", *known, 500)
    largest, used = _largest(joined.where("k = 1"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used >= 3 and largest < 6_000  # of the 16,001 rows of the key


def test_a_key_that_is_hot_in_the_product_only(spark):
    workspace = Workspace(spark)
    for name in "ab":
        workspace.add(name, spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias(name)))
    workspace.add("c", spark.createDataFrame([(1, 5), (2, 6)], "k int, c int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    largest, used = _largest(fuse_columns(workspace, ["a", "b", "c"], "k", "inner", "salt", 1_000))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used >= 3 and largest < 45_000  # of 90,000 rows


def test_a_key_gets_cells_by_its_own_rows():
    assert [skew._cells(n, 100, 200) for n in (100, 350, 10_000, 10**9)] == [2, 4, 128, 256]


def test_a_hot_key_that_is_a_small_part_of_its_table(spark):
    rare = spark.range(0, 1_200_000, 1, 8).select(
        F.when(F.col("id") % 5_000 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    found = skew.summarize(rare, ["k"])
    assert set(found.heavy) == {-1} and 240 <= found.heavy[-1] <= 240 + 3.5 / skew.TRACKED * 1.2e6


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("side", ["left", "right"])
def test_a_key_that_vanishes_after_planning(spark, tmp_path, how, side):
    """The summary saw the key; when the join runs, one side does not hold it any more."""
    full = _data(spark, 300, 1, "v")
    folder = f"{tmp_path}/changing"
    full.write.parquet(folder)
    changing = spark.read.schema(full.schema).parquet(folder)
    steady = _data(spark, 200, 1, "w")
    workspace = Workspace(spark)
    workspace.add("changing", changing)
    workspace.add("steady", steady)
    order = ["changing", "steady"] if side == "left" else ["steady", "changing"]
    planned = fuse_columns(workspace, order, "k", how, "salt", 20)
    assert "__left_cell" in planned._jdf.queryExecution().analyzed().toString()
    full.where("k IS NULL OR k <> 1").write.mode("overwrite").parquet(folder)
    spark.catalog.refreshByPath(folder)
    left = spark.read.parquet(folder) if side == "left" else steady
    right = steady if side == "left" else spark.read.parquet(folder)
    # planned anew on the same files, with the cells that the old summary gave
    fresh = Workspace(spark)
    fresh.add("left", left)
    fresh.add("right", right)
    old = [skew.summarize(df, ["k"]) for df in ((full, steady) if side == "left" else (steady, full))]
    run = skew.salted_join(left, right, ["k"], how, *old, 20)
    assert rows(run) == rows(fuse_columns(fresh, ["left", "right"], "k", how, "adaptive"))


def _five_steps(spark, hot_rows, how="left"):
    workspace = Workspace(spark)
    n = 4_000
    third = F.when(F.col("id") % 3 == 0, F.lit(0))
    workspace.add("a", spark.range(n).select(
        "id", third.otherwise(F.col("id")).alias("b"), (F.col("id") % 50).alias("c")
    ))
    workspace.add("bs", spark.range(n // 2).select(
        F.col("id").alias("b"), third.otherwise(F.col("id") % 200).alias("d")
    ))
    workspace.add("cs", spark.range(50).select(F.col("id").alias("c"), (F.col("id") % 2).alias("e")))
    workspace.add("ds", spark.range(300).select(F.col("id").alias("d"), F.col("id").alias("f")))
    workspace.add("es", spark.range(3).select(F.col("id").alias("e"), F.lit("x").alias("g")))
    workspace.add("fs", spark.range(300).select(F.col("id").alias("f"), F.lit("y").alias("h")))
    before = "a"
    for i, (table, key) in enumerate([("bs", "b"), ("cs", "c"), ("ds", "d"), ("es", "e"), ("fs", "f")]):
        run_fusion(workspace, [{
            "fused_dataset_name": f"s{i}", "datasets_to_fuse": [before, table], "fuse_by": "column",
            "fuse_on": key, "fuse_how": how, "hot_rows": hot_rows,
        }])
        before = f"s{i}"
    return workspace[before]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_look_ups_of_a_chain_run_no_join(spark, monkeypatch, how):
    asked = []
    plain = skew.summarize

    def watched(df, keys, weight=None):
        asked.append(df._jdf.queryExecution().analyzed().toString())
        return plain(df, keys, weight)

    monkeypatch.setattr("weftline.operators.lineage.summarize", watched)
    salted = _five_steps(spark, 100, how)
    assert asked and not any("Join" in plan for plan in asked)
    plan = salted._jdf.queryExecution().analyzed().toString()
    assert plan.count("__left_cell") > 0
    # one join per step; those beside them look up the few hot keys that a side holds
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert sum("__held" not in line for line in joins) == 5
    expected = _five_steps(spark, 10**9, how)
    assert rows(salted) == rows(expected)


def test_a_chain_knows_how_often_earlier_joins_repeat_a_row(spark):
    workspace = Workspace(spark)
    workspace.add("a", spark.range(100).select(
        F.when(F.col("id") < 10, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 10, F.lit(7)).otherwise(F.col("id") + 100).alias("m"),
    ))
    many = spark.range(64).select(F.lit(-1).alias("k"), F.col("id").alias("v"))
    workspace.add("b", many.union(spark.range(10, 100).select("id", "id")))
    run_fusion(workspace, [{
        "fused_dataset_name": "ab", "datasets_to_fuse": ["a", "b"], "fuse_by": "column", "fuse_on": "k",
    }])
    lineage = workspace.lineage("ab")
    assert lineage.summary(["k"]).heavy[-1] == 640
    assert lineage.summary(["m"]).heavy[7] == 640
    # every row of b with the frequent key met ten rows of a: to the next power of two
    assert lineage.summary(["v"]).light > 1
    workspace.update("ab", workspace["ab"].where("m <> 7"))
    assert workspace.lineage("ab") is None
