import pytest

from tablework.functions.metrics import MetricError, parse_metrics
from pyspark.sql import functions as F

from tablework.operators import aggregate as A


@pytest.fixture(scope="module")
def ties(spark):
    # FIXTURES §3 ties: ('a',1),('b',3),('c',3), plus a null key and a null value
    return spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), (None, 2.0), ("d", None)],
                                 "k string, v double")


def test_metric_aliases(spark):
    df = spark.createDataFrame([(1, 2.0)], "x int, y double")
    ms = parse_metrics(["sum(x)", "count(*)", "avg(y) AS mean_y", "max(y) - min(y)", "std(y)"], df)
    assert [m.alias for m in ms] == ["sum_x", "count_all", "mean_y", "metric_1", "std_y"]


def test_metric_checks(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(MetricError):
        parse_metrics([], df)
    with pytest.raises(MetricError):
        parse_metrics(["sum(nope)"], df)
    with pytest.raises(A.AggregateError):
        A.aggregate(df, ["nope"], ["sum(x)"])


def test_null_keys_kept_and_last(ties):
    res = A.aggregate(ties, ["k"], ["sum(v)", "count(*)"])
    rows = res.df.collect()
    assert rows[-1]["k"] is None and len(rows) == 5
    assert [r["k"] for r in rows[:-1]] == ["a", "b", "c", "d"]
    assert res.df.where("k = 'd'").first()["sum_v"] is None  # sum of only nulls is null


def test_topk_ties_go_to_lowest_key(ties):
    res = A.aggregate(ties, ["k"], ["sum(v)"])
    top = A.top_k(res.df, ["k"], ["sum_v"], 2).orderBy("rank").collect()
    assert [(r["k"], r["rank"]) for r in top] == [("b", 1), ("c", 2)]
    bottom = A.bottom_k(res.df, ["k"], ["sum_v"], 5).orderBy("rank").collect()
    assert [r["k"] for r in bottom] == ["a", None, "b", "c"]


def test_extrema_tie_break(ties):
    res = A.aggregate(ties, ["k"], ["sum(v)"])
    e = A.extrema(res.df, ["k"], ["sum_v"]).first()
    assert (e["max_k"], e["max_value"], e["min_k"], e["min_value"]) == ("b", 3.0, "a", 1.0)


def test_extrema_null_key_loses_ties(spark):
    df = spark.createDataFrame([(None, 5.0), ("z", 5.0)], "k string, v double")
    e = A.extrema(df, ["k"], ["v"]).first()
    assert e["max_k"] == "z" and e["min_k"] == "z"


def test_share_of_total(ties):
    res = A.aggregate(ties.where("v IS NOT NULL"), ["k"], ["sum(v) AS total_revenue"])
    out = {r["k"]: r["share_pct"] for r in A.share_of_total(res.df, "total_revenue").collect()}
    assert out["a"] == pytest.approx(100 / 9)


def test_spread_functions_match_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = A.aggregate(df, [], ["median(x)", "std(x)", "var(x)", "variance(x)"]).df.first()
    s = pd.Series(vals)
    assert r["median_x"] == pytest.approx(s.median())
    assert r["std_x"] == pytest.approx(s.std())
    assert r["var_x"] == pytest.approx(s.var()) and r["variance_x"] == pytest.approx(s.var())


def test_topk_plan_has_no_global_sort(spark, sf):
    res = A.aggregate(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_suppkey"], ["sum(l_quantity)"])
    df = A.top_k(res.df, res.group_by, res.metrics, 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_aggregate_report(ties):
    rep = A.aggregate_report(ties, ["k"], ["sum(v)", "count(*)"], k=2)
    assert rep.result.metadata["metrics"] == ["sum_v", "count_all"]
    assert rep.topk.where("metric = 'sum_v'").orderBy("rank").first()["k"] == "b"
    cv = {r["name"]: r["value"] for r in rep.computed_values.collect()}
    assert cv["result_count"] == 5.0 and cv["sum_v_max"] == 3.0


def test_run_sql_computed_values(spark):
    from tablework.operators.opensql import run_sql
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    res = run_sql(spark, "SELECT k, v FROM t", {"t": df})
    cv = {r["name"]: r["value"] for r in res.computed_values().collect()}
    assert cv["v_mean"] == 3.0 and res.preview(1).count() == 1


def test_exact_grouped_median_matches_builtin(spark):
    import random
    rnd = random.Random(5)
    rows = [(None if i % 17 == 0 else ("hot" if i % 3 else f"g{i % 5}"), float(rnd.randint(0, 50)) if i % 11 else None)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").union(spark.createDataFrame([("allnull", None)], "k string, v double"))
    mine = {r["k"]: r["median_v"] for r in A.aggregate(df, ["k"], ["median(v)", "count(*)"]).df.collect()}
    theirs = {r["k"]: r["median_v"] for r in df.groupBy("k").agg(F.median("v").alias("median_v")).collect()}
    assert mine == theirs and mine["allnull"] is None
    g1 = A.aggregate(df, [], ["median(v)"]).df.first()[0]
    g2 = df.agg(F.median("v")).first()[0]
    assert g1 == g2


def test_expression_arguments_in_metrics(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 4.0)], "k string, x int, y double")
    r = {row["k"]: row for row in A.aggregate(df, ["k"], ["count(distinct x)", "sum(x * y)", "std(y)"]).df.collect()}
    assert r["a"]["count_distinct_x"] == 1 and r["a"]["sum_x_y"] == 5.0 and r["b"]["std_y"] is None


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("b", nan), ("c", 2.0), ("c", 3.0)], "k string, v double")
    got = {r["k"]: r for r in A.aggregate(df, ["k"], ["sum(v)", "avg(v)", "max(v)", "median(v)", "sum(v * 2) AS twice"]).df.collect()}
    assert got["a"]["sum_v"] == 1.0 and got["a"]["avg_v"] == 1.0 and got["a"]["max_v"] == 1.0 and got["a"]["twice"] == 2.0
    assert got["b"]["sum_v"] is None and got["b"]["median_v"] is None and got["c"]["median_v"] == 2.5
    flat = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, nan, nan)], "v double")
    assert A.aggregate(flat, [], ["median(v)"]).df.first()[0] == 2.0
    agg = spark.createDataFrame([("a", 1.0), ("b", nan), ("c", 2.0)], "k string, t double")
    assert [(r["rank"], r["k"]) for r in A.top_k(agg, ["k"], ["t"], 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]
    assert A.extrema(agg, ["k"], ["t"]).first()["max_k"] == "c"
    assert sorted(r["share_pct"] or 0 for r in A.share_of_total(agg, "t").collect()) == pytest.approx([0, 100 / 3, 200 / 3])
    assert A.top_n_sum(agg, "k", "t").first()["k"] == "c"


def test_metric_alias_after_a_cast_and_missing_columns(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "2")], "k string, v string")
    assert A.aggregate(df, ["k"], ["sum(cast(v as double)) AS y"]).df.first()["y"] == 3.5
    assert A.aggregate(df, ["k"], ["sum(cast(v as double))"]).df.columns == ["k", "sum_cast_v_as_double"]
    with pytest.raises(MetricError):
        A.aggregate(df, ["k"], ["sum(nope) AS x"])


def test_report_reads_its_input_once(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.range(1000).selectExpr("id % 7 AS k", "CAST(id AS DOUBLE) AS v", "id % 3 AS w").write.parquet(src)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.read.parquet(src).mapInArrow(count, "k long, v double, w long")
    rep = A.aggregate_report(df, ["k"], ["sum(v)", "avg(v)", "max(w)"], k=2)
    for frame in (rep.topk, rep.bottomk, rep.extrema, rep.computed_values, rep.result.df):
        assert frame.count() > 0
    assert seen.value == 1000
    seen.value = 0
    assert A.extrema(A.aggregate(df, ["k"], ["sum(v)", "avg(v)"]).df, ["k"], ["sum_v", "avg_v"]).count() == 2
    assert A.top_k(A.aggregate(df, ["k"], ["sum(v)", "avg(v)"]).df, ["k"], ["sum_v", "avg_v"], 2).count() == 4
    assert seen.value == 2000


def test_medians_inside_expressions(spark):
    rows = [(None if i % 7 == 0 else i % 3, float(i * i % 101), None if i % 4 == 0 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    texts = ["median(x) * 2 AS m", "max(x) - median(x)", "round(percentile(y, 0.9) + count(*), 3) AS p", "median(x + y) AS s", "sum(x)",
             "median(x) FILTER (WHERE y > 100) / avg(y) AS f", "coalesce(median(if(k = 99, x, null)), -1) AS none", "median(y)"]
    plain = ["median(x) * 2 AS m", "max(x) - median(x) AS metric_1", "round(percentile(y, 0.9) + count(*), 3) AS p", "median(x + y) AS s", "sum(x) AS sum_x",
             "median(x) FILTER (WHERE y > 100) / avg(y) AS f", "coalesce(median(if(k = 99, x, null)), -1) AS none", "median(y) AS median_y"]
    for keys in (["k"], []):
        res = A.aggregate(df, keys, texts)
        want = df.groupBy(*keys).agg(*[F.expr(t.rsplit(" AS ", 1)[0]).alias(t.rsplit(" AS ", 1)[1]) for t in plain])
        assert res.df.columns == want.columns
        got, want = (sorted((tuple(r) for r in d.collect()), key=lambda r: str(r[:1])) for d in (res.df, want))
        for g, w in zip(got, want):
            assert g == pytest.approx(w)
        assert len(got) == len(want)
        plan = res.df._jdf.queryExecution().toString()
        assert "percentile(" not in plan and "median(" not in plan
    with pytest.raises(MetricError):
        parse_metrics(["median(nope) AS m"], df)


def test_names_with_dots(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, float("nan")), ("b", 5.0, 4.0)], ["k.x", "v.y", "other.z"])
    res = A.aggregate(df, ["k.x"], ["sum(v.y) AS s", "median(v.y) AS m", "count(*)"])
    assert [tuple(r) for r in res.df.collect()] == [("a", 4.0, 2.0, 2), ("b", 5.0, 5.0, 1)]
    assert [tuple(r) for r in A.top_n_sum(df, "k.x", "v.y", 1).collect()] == [("b", 5.0)]
    assert A.share_of_total(res.df, "s").where("`k.x` = 'b'").first()["share_pct"] == pytest.approx(500 / 9)
