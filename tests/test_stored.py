import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tablework.operators.profile import few_values
from tablework.operators.series import corr_matrix
from tablework.operators.sketches import distinct_sketches, merged_distinct
from tablework.sources import files as S
from tablework.sources import ledger


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert S.read_prepared(spark, root) is None
    S.save_prepared(spark.range(3), root)
    with pytest.raises(Exception):  # a task fails while the data is written
        S.save_prepared(spark.range(5).select(F.raise_error(F.lit("gone")).alias("id")), root)
    ledger.stage(spark.range(7), f"{root}/prepared_data")  # written whole, died before the commit
    assert rows(S.read_prepared(spark, root)) == [(0,), (1,), (2,)]
    S.save_prepared(spark.range(2), root)
    assert rows(S.read_prepared(spark, root)) == [(0,), (1,)]
    assert ledger.vacuum(spark, f"{root}/prepared_data") == 1
    assert rows(S.read_prepared(spark, root)) == [(0,), (1,)]


def test_results_are_read_by_their_query(spark, tmp_path):
    S.save_result(spark.range(1), "select 1", str(tmp_path))
    S.save_result(spark.range(4), "select 2", str(tmp_path))
    assert S.read_result(spark, "select 1", str(tmp_path)).count() == 1
    assert S.read_result(spark, "select 3", str(tmp_path)) is None


def test_traces_appended_again_count_once(spark, tmp_path):
    def runs(status, *ids):
        return spark.createDataFrame([(f"r{i}", status) for i in ids], "run_id string, status string")
    path = str(tmp_path / "traces")
    S.append_trace(runs("error", 1, 2), path)
    S.append_trace(runs("success", 2, 3), path)
    S.append_trace(runs("success", 2, 3), path)  # the job is run again
    ledger.stage(runs("error", 9), path, "json")
    assert rows(S.read_traces(spark, path).select("run_id", "status")) == [("r1", "error"), ("r2", "success"), ("r3", "success")]


def test_catalogue_reads_heads_in_tasks(spark, tmp_path):
    spark.range(30).select("id", F.lit("x").alias("a b")).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(2).select(F.col("id").alias("n"), F.lit(1).alias("q,r")).coalesce(1).write.option("header", True).csv(str(tmp_path / "text.csv"))
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    got = {r["dataset_id"]: r for r in S.dataset_catalog(spark, str(tmp_path)).collect()}
    assert {k: r["columns"] for k, r in got.items()} == {"many": ["id", "a b"], "text": ["n", "q,r"], "broken": None}
    assert got["broken"]["size_bytes"] == 10
    plan = S.dataset_catalog(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "LocalRelation" not in plan and "LocalTableScan" not in plan  # nothing was read on the driver


def test_sampled_schema_merges_kinds_and_reads_few_rows(spark, tmp_path):
    df = spark.range(60_000).select(
        F.col("id"), (F.col("id") / 2).alias("half"), (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 3 == 0, "7").otherwise("7.5").alias("mixed"), F.when(F.col("id") % 2 == 0, "2024-01-05").alias("day"),
        F.when(F.col("id") % 2 == 0, "2024-01-05").otherwise("3").alias("odd"), F.concat(F.lit("a, "), F.col("id")).alias("text"))
    df.repartition(3).write.option("header", True).csv(str(tmp_path / "t.csv"))
    got = S.sampled_schema(spark, str(tmp_path / "t.csv"), 1000).orderBy("ordinal").collect()
    assert [(r["column"], r["type"]) for r in got] == [("id", "int"), ("half", "double"), ("even", "bool"), ("none", "null"), ("mixed", "double"),
                                                      ("day", "date"), ("odd", "text"), ("text", "text")]
    assert all(0 < r["rows_read"] <= 1000 for r in got)
    few = S.sampled_schema(spark, str(tmp_path / "t.csv"), 32).collect()
    assert all(r["rows_read"] <= 32 for r in few)


def test_digest_tree_cuts_a_file(spark, tmp_path):
    body = os.urandom(100_000)
    (tmp_path / "a.parquet").write_bytes(body)
    got = {r["filename"]: r for r in S.fingerprint_trees(spark, str(tmp_path), leaf_bytes=4096).collect()}
    leaves = [hashlib.sha256(body[i:i + 4096]).hexdigest() for i in range(0, len(body), 4096)]
    assert (got["a.parquet"]["leaves"], got["a.parquet"]["tree_sha256"]) == (25, hashlib.sha256("".join(leaves).encode()).hexdigest())


def test_fingerprint_of_rows_is_a_multiset(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    one = S.fingerprint_rows(df).first()
    assert one == S.fingerprint_rows(df.repartition(3)).first() and one != S.fingerprint_rows(df.distinct()).first()
    digests = [hashlib.md5(t.encode()).hexdigest() for t in ("1|a", "1|a", "2|null")]
    assert tuple(one) == (3, str(sum(int(d[:16], 16) for d in digests)), str(sum(int(d[16:], 16) for d in digests)))


def test_constant_columns_have_no_correlation(spark):
    df = spark.range(100_001).select(F.lit(1e9 + 0.1).alias("one"), F.col("id").alias("x"), (-2.0 * F.col("id")).alias("y"),
                                     F.when(F.col("id") < 500, F.lit(0.1)).otherwise(F.when(F.col("id") < 900, F.col("id").cast("double"))).alias("part"),
                                     F.when(F.col("id") < 400, F.col("id").cast("double")).alias("few"))
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df).collect()}
    assert all(got[p] is None for p in got if "one" in p)
    assert got["x", "y"] == pytest.approx(-1) and got["x", "part"] > 0
    assert got["part", "few"] is None and got["few", "part"] is None  # constant where both are present


def test_sketches_merge_without_the_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 5).alias("g"), (F.col("id") % 31).alias("day"), (F.col("id") % 9001).alias("v"))
    stored = distinct_sketches(df, ["g", "day"], "v")
    for keys, exact in ((["g"], 5), ([], 1)):
        told = merged_distinct(stored, keys).collect()
        assert len(told) == exact and all(abs(r["approx_distinct"] / (8000 if keys else 9001) - 1) < 0.13 if not keys else r["approx_distinct"] > 7000 for r in told)
    assert merged_distinct(distinct_sketches(df.select(F.lit(1).alias("g"), F.lit(None).cast("long").alias("v")), ["g"], "v"), ["g"]).first()["approx_distinct"] == 0


def test_few_values_is_one_narrow_pass(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), F.lit(None).cast("string").alias("c"))
    t = few_values(df, df.columns, 50)
    assert {r["ordinal"]: r["distinct_count"] for r in t.collect()} == {0: 7, 1: 51}
    assert "Expand" not in t._jdf.queryExecution().executedPlan().toString()
