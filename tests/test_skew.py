"""Joins with a key that holds most rows."""

from pyspark.sql import functions as F

from filedeck.operators.skew import salted_join


def test_salted_join(spark):
    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(3000, None)], "id bigint, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), ("k3", 4), ("none", 5), (None, 6)], "k string, w int")
    plain = sorted(map(tuple, large.join(small, "k").select("id", "k", "w").collect()))
    assert sorted(map(tuple, salted_join(large, small, ["k"]).select("id", "k", "w").collect())) == plain
    assert salted_join(large, small.limit(0), ["k"]).count() == salted_join(large.limit(0), small, ["k"]).count() == 0


def test_hot_rows_are_spread(spark):
    large = spark.range(1000).withColumn("k", F.lit(1))
    small = spark.createDataFrame([(1, 2)], "k int, w int")
    assert salted_join(large, small, ["k"]).count() == 1000
