import os

import pytest
from pyspark.sql import functions as F

from knowloom import runtime


def test_hot_keys_are_few_and_found(spark):
    df = spark.range(0, 9000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id AS string) end AS k", "id")
    assert [r.k for r in runtime.hot_keys(df, ["k"]).collect()] == ["hot"]
    assert runtime.hot_keys(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_ones(spark, how):
    big = spark.range(0, 3000).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else cast(id % 40 AS string) end AS k", "id", "array(id) AS a")
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("5", 3), ("zz", 4), (None, 5)], "k string, v int")
    got = runtime.salted_join(big, small, ["k"], how)
    want = big.join(small, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # the hot key is spread, not in one partition
    if how == "inner":
        parts = got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts >= 1


def test_cut_and_release(spark):
    df = runtime.cut(spark.range(5).withColumn("x", F.rand()), "t")
    assert df.count() == 5 and [r.x for r in df.collect()] == [r.x for r in df.collect()]
    path = df._knowloom_path.removeprefix("file://")
    assert os.path.isdir(path)
    runtime.release(df, None)
    assert not os.path.isdir(path)


def test_columns_once_and_small_checks(spark):
    df = spark.range(3)
    assert runtime.with_once(df, {"y": F.col("id") + 1}).where("y > 1").columns == ["id", "y"]
    assert runtime.is_empty(df.where("id > 9")) and not runtime.is_empty(df)
    assert "BROADCAST" in runtime.broadcast_if_small(df)._jdf.queryExecution().logical().toString().upper()
    assert "RESOLVEDHINT" not in runtime.broadcast_if_small(df, 1)._jdf.queryExecution().analyzed().toString().upper()
    assert [r.x for r in spark.createDataFrame([("a",), ("  ",), ("",), (None,)], "c string").select(runtime.filled("c").alias("x")).collect()] == [True, False, False, False]
