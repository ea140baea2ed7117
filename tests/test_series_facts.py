import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablework.functions.text import format_value, question_smallest_first, question_top_n
from tablework.operators import facts as N
from tablework.operators import series as V


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in V.corr_matrix(df).collect()}
    import numpy as np
    assert m[("a", "b")] == pytest.approx(np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.1, 5.9])[0, 1])
    assert m[("a", "c")] is None and m[("c", "c")] is None
    assert m[("a", "a")] == pytest.approx(1.0)


def test_box_whiskers(spark):
    vals = [float(v) for v in range(1, 12)] + [100.0]
    r = V.box_stats(spark.createDataFrame([(v,) for v in vals], "x double")).first()
    assert (r["q1"], r["median"], r["q3"]) == (3.75, 6.5, 9.25)
    assert (r["lower_whisker"], r["upper_whisker"], r["outliers"]) == (1.0, 11.0, 1)


def test_line_series_parses_period_text(spark):
    df = spark.createDataFrame([("2023-01", 1.0), ("2023-01", 2.0), ("2023-02", 5.0), (None, 9.0)],
                               "month string, y double")
    rows = V.line_series(df, "month", "y").collect()
    assert [(r["month"], r["y"]) for r in rows] == [(dt.datetime(2023, 1, 1), 3.0), (dt.datetime(2023, 2, 1), 5.0)]


def test_line_index_series(spark):
    df = spark.createDataFrame([(3, 30.0), (1, 10.0), (2, 20.0)], "t int, y double")
    assert [(r["index"], r["y"]) for r in V.line_index_series(df, ["t"], "y").orderBy("index").collect()] == \
        [(0, 10.0), (1, 20.0), (2, 30.0)]


def test_bar_auto_picks_low_cardinality_text(spark):
    rows = [(f"name{i}", "A" if i % 2 else "B", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, seg string, amount double")
    out = V.bar_auto_series(df).collect()
    assert [r["seg"] for r in out] == ["A", "B"]


def test_trend_facts(spark):
    df = spark.createDataFrame([("2023-01", 100.0), ("2023-02", 150.0), ("2023-03", 130.0)], "month string, revenue double")
    r = N.trend_facts(df, "month", "revenue").first()
    assert r["change_pct"] == pytest.approx(30.0)
    assert (r["peak_period"], r["trough_period"]) == ("2023-02", "2023-01")
    assert (r["direction"], r["movement"], r["remark"]) == ("upward trending", "increased", "strong growth")


def test_topn_facts_and_breakdown(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", 60.0)], "k string, total double")
    rows = N.topn_facts(df, ["k"], "total", 2).orderBy("rank").collect()
    assert [(r["label"], r["share_pct"]) for r in rows] == [("c", 60.0), ("b", 30.0)]
    assert rows[0]["top_share_pct"] == pytest.approx(90.0) and rows[0]["others"] == 1
    b = N.breakdown(df, ["k"], "total").orderBy("rank").collect()
    assert b[0]["text"] == "c: 60.00"


def test_format_value_rules(spark):
    df = spark.createDataFrame([(0.256, 45.5, 1234567.891, 12.0)], "a_ratio double, b_pct double, big double, small double")
    r = df.select(*[format_value(F.col(c), c).alias(c) for c in df.columns]).first()
    assert (r["a_ratio"], r["b_pct"], r["big"], r["small"]) == ("25.6%", "45.5%", "1,234,567.89", "12.00")


def test_question_top_n(spark):
    qs = ["top 5 products", "best 12 customers", "top-7 parts", "top 500 rows", "monthly trend", "worst 3 items"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    out = {r["q"]: (r["n"], r["s"]) for r in
           df.select("q", question_top_n(F.col("q")).alias("n"), question_smallest_first(F.col("q")).alias("s")).collect()}
    assert out == {"top 5 products": (5, False), "best 12 customers": (12, False), "top-7 parts": (7, False),
                   "top 500 rows": (None, False), "monthly trend": (None, False), "worst 3 items": (3, True)}


def test_scalar_and_single_row_text(spark):
    df = spark.createDataFrame([(1500.0,)], "sum_sales double")
    assert N.scalar_fact(df, True).first()["text"] == "sum_sales is 1,500.00 (aggregated result)."
    wide = spark.createDataFrame([(1.0, "x", 0.5)], "a double, b string, c_share double")
    assert N.single_row_text(wide).first()["text"] == "a=1.00 | b=x | c_share=50.0%"


def test_summary_cases(spark):
    from tablework.operators.facts import summary_facts
    empty = spark.createDataFrame([], "a double")
    assert summary_facts(empty)[0] == "empty"
    keys_only = spark.createDataFrame([("a",), ("b",)], "k string")
    case, f = summary_facts(keys_only, {"is_aggregate": True, "group_by": ["k"]})
    assert case == "groups_only" and f.first()["groups"] == 2
    monthly = spark.createDataFrame([("2023-01", 1.0), ("2023-02", 2.0)], "month string, sum_sales double")
    assert summary_facts(monthly, {"is_aggregate": True, "group_by": ["month"]}, "monthly sales trend")[0] == "trend"
    assert summary_facts(monthly, {"is_aggregate": True, "group_by": ["month"]}, "top 1 month")[0] == "top_n"
    assert summary_facts(monthly, {"is_aggregate": True, "group_by": ["month"]})[0] == "groups"
    texts = spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")
    assert summary_facts(texts)[0] == "shape"
    assert summary_facts(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))[0] == "single_row"


def test_heat_values(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) * 2 AS v", "'x' AS s")
    assert V.heat_values(df).count() == 10 and V.heat_values(df).columns == ["id", "v"]


def test_topn_smallest_first(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", 60.0)], "k string, total double")
    rows = N.topn_facts(df, ["k"], "total", 2, smallest_first=True).orderBy("rank").collect()
    assert [r["label"] for r in rows] == ["a", "b"]
