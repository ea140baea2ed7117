import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.operators.ordinal import rank_within_groups, with_row_index
from tablework.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(50, 20, 3000), 1).tolist() + [50.0] * 500  # many ties
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=100)["x"]
    assert got == pytest.approx(np.quantile(vals, probs).tolist())


def test_exact_quantiles_empty_and_single(spark):
    df = spark.createDataFrame([(None, 3.0)], "a double, b double")
    out = exact_quantiles(df, ["a", "b"], [0.5])
    assert out == {"a": [None], "b": [3.0]}


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000).repartition(9)
    rows = with_row_index(df, [F.col("k").asc()], "i").select("i", "k").collect()
    assert sorted(r["i"] for r in rows) == list(range(5000))
    assert all(r["i"] == r["k"] for r in rows)


def test_rank_within_hot_group(spark):
    # one key holds most rows; ranks must be exact inside it
    df = spark.range(0, 4000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(F.lit(99)).alias("g"),
                                     (F.col("id") * 31 % 4000).alias("v"))
    ranked = rank_within_groups(df, ["g"], F.col("v"), "r").where("g = 99").select("r", "v").collect()
    vs = sorted(r["v"] for r in ranked)
    assert {r["v"]: r["r"] for r in ranked} == {v: i for i, v in enumerate(vs)}


def test_hot_tied_group_spreads_over_partitions(spark):
    # one key holds a third of the rows and all its values tie; the range
    # sort used for exact ranks must still cut it across partitions
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.col("id") % 101).cast("double")).alias("v"))
    from tablework.operators.ordinal import rank_order
    tagged, order = rank_order(df, ["g"], F.col("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with_tie = tagged.orderBy(*order).groupBy(F.spark_partition_id().alias("p")).count().collect()
        without = df.orderBy("g", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    biggest_with = max(r["count"] for r in with_tie)
    biggest_without = max(r["count"] for r in without)
    assert biggest_without >= n // 3          # ties alone cannot be split
    assert biggest_with < n // 3 and biggest_with <= 3 * n / len(with_tie)
