import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablework.operators import windows as W


def table(spark, n=400, seed=4):
    r = random.Random(seed)
    rows = [(i, 0 if i % 3 == 0 else r.choice([None, *range(1, 25)]), r.choice([None, *range(6)]), r.choice([None, r.random()])) for i in range(n)]
    rows += [(n + i, 77, 5, 1.0) for i in range(40)]  # a long tie
    return spark.createDataFrame(rows, "id long, k long, o long, x double").repartition(4)


def same(got, want, cols):
    a, b = ([tuple(r) for r in d.select("id", *cols).orderBy("id").collect()] for d in (got, want))
    for x, y in zip(a, b):
        assert x == pytest.approx(y, nan_ok=True), (x, y)
    assert len(a) == len(b)


# hot: keys of more rows take the carried way (0: all of them)
@pytest.mark.parametrize("parts, keys, hot", [(None, ["k"], 0), (12, ["k"], 0), (5, ["k", "o"], 20), (7, [], 1), (None, ["k"], 10_000)])
def test_positions_and_ranks(spark, parts, keys, hot):
    df = table(spark)
    for order, by in (([("o", False), ("id", True)], [F.desc("o"), F.asc("id")]), ([("o", True)], [F.asc("o")])):
        got = W.window_columns(df, keys, order, {"rk": W.rank(), "drk": W.dense_rank(), "prk": W.percent_rank(), "n": W.group_rows()}, parts, hot)
        w = Window.partitionBy(*keys).orderBy(*by)
        want = df.withColumns({"rk": F.rank().over(w), "drk": F.dense_rank().over(w), "prk": F.percent_rank().over(w),
                               "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        same(got, want, ["rk", "drk", "prk", "n"])


@pytest.mark.parametrize("parts, keys, hot", [(None, ["k"], 0), (12, ["k"], 30), (40, [], 1), (None, ["k"], 10_000)])
def test_rows_and_running_state(spark, parts, keys, hot):
    df = table(spark)
    got = W.window_columns(df, keys, [("o", True), ("id", True)], {
        "rn": W.row_number(), "t3": W.ntile(3), "t50": W.ntile(50), "lag1": W.lag(F.col("x")), "lag3": W.lag(F.col("x"), 3), "lead2": W.lead(F.col("id"), 2),
        "f": W.first_value(F.col("x")), "rs": W.running("sum", F.col("x")), "rc": W.running("count", F.col("x")), "rmin": W.running("min", F.col("x")),
        "rmax": W.running("max", F.col("x")), "s": W.rows_between(F.sum, F.col("x"), 2), "a": W.rows_between(F.avg, F.col("x"), 4, 3)}, parts, hot)
    w = Window.partitionBy(*keys).orderBy(F.asc("o"), F.asc("id"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"rn": F.row_number().over(w), "t3": F.ntile(3).over(w), "t50": F.ntile(50).over(w), "lag1": F.lag("x").over(w), "lag3": F.lag("x", 3).over(w),
                           "lead2": F.lead("id", 2).over(w), "f": F.first("x").over(w), "rs": F.sum("x").over(run), "rc": F.count("x").over(run),
                           "rmin": F.min("x").over(run), "rmax": F.max("x").over(run), "s": F.sum("x").over(w.rowsBetween(-2, 0)), "a": F.avg("x").over(w.rowsBetween(-4, 3))})
    same(got, want, ["rn", "t3", "t50", "lag1", "lag3", "lead2", "f", "rs", "rc", "rmin", "rmax", "s", "a"])


@pytest.mark.parametrize("hot", [0, 100, 10_000])
def test_value_ranges(spark, hot):
    df = table(spark)
    got = W.within_range(df, ["k"], "o", F.col("o") - 2, {"n": None, "s": F.col("x")}, 7, hot)
    w = Window.partitionBy("k").orderBy("o").rangeBetween(-2, 0)
    same(got, df.withColumns({"n": F.count(F.lit(1)).over(w), "s": F.coalesce(F.sum("x").over(w), F.lit(0.0))}), ["n", "s"])


def test_no_rows(spark):
    df = table(spark).limit(0)
    assert W.window_columns(df, ["k"], [("o", True)], {"rk": W.rank(), "l": W.lag(F.col("x"))}).collect() == []
    assert W.window_columns(df, [], [("o", True)], {"rk": W.rank(), "l": W.lag(F.col("x"))}).collect() == []
