"""Profile queries over whole tables of their own rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e


@pytest.fixture
def tables(spark, tmp_path):
    lines = spark.range(1, 71).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 9).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"), (F.col("id") % 4).alias("l_linenumber"),
        (F.col("id") * 2.0).alias("l_quantity"), (F.col("id") * 1.5).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"),
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")).alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    people = spark.range(300).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("n"), "id")).alias("c_name"),
                                     (F.col("id") % 4).cast("string").alias("c_mktsegment"))
    people.write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_frame_digest_of_all_numbers_with_missing_ones(spark, tables):
    got = {r["column"]: r for r in e.queries()["frame_digest"](spark, tables).collect()}
    assert list(got) == ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    kept = [2.0 * i for i in range(1, 71) if i % 7]  # every seventh quantity is null
    q = got["l_quantity"]
    assert (q["n_rows"], q["n_columns"], q["min"], q["max"]) == (70, 11, 2.0, 138.0)
    assert q["mean"] == round(sum(kept) / len(kept), 4) and got["l_extendedprice"]["max"] == 105.0
    assert got["l_tax"]["max"] == 0.02  # NaN is missing


def test_categorical_counts_are_whole(spark, tables):
    got = {r["column"]: (r["distinct_count"], r["picked"]) for r in e.queries()["pick_categorical"](spark, tables).collect()}
    assert got == {"c_name": (200, False), "c_mktsegment": (4, True)}


def test_categorical_counts_of_an_empty_column(spark):
    from tablework.operators.profile import categorical_table
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x string, y string")
    assert [tuple(r) for r in categorical_table(df).orderBy("ordinal").collect()] == [("x", 0, 0, True), ("y", 1, 2, False)]
    assert {r["distinct_count"] for r in categorical_table(df.limit(0)).collect()} == {0}
