"""Schema-only rules: no data pass needed."""

from tablework.functions.dates import candidate_date_columns, is_date_name
from tablework.functions.filters import parse_literal
from tablework.functions.metrics import metric_columns
from tablework.functions.text import is_percent_name, is_revenue_share
from tablework.operators.aggregate import aggregate
from tablework.operators.profile import first_numeric, numeric_columns


def test_numeric_pick(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "s string, i int, d double")
    assert first_numeric(df) == "i" and numeric_columns(df) == ["i", "d"]
    assert first_numeric(spark.createDataFrame([("a",)], "s string")) is None


def test_metric_columns_prefer_aggregate_names(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0, 3.0)], "k string, ratio double, sum_x double, metric_1 double")
    assert metric_columns(df, ["k"]) == ["sum_x", "metric_1", "ratio"]


def test_date_like_names():
    assert all(is_date_name(n) for n in ("order_date", "pickup_datetime", "created_at", "UpdatedBy", "ts_timestamp"))
    assert is_date_name("lifetime_value")  # the word rule alone catches it ...


def test_date_like_name_needs_date_or_text_type(spark):
    df = spark.createDataFrame([(1.0, "2023-01-01", None)], "lifetime_value double, created string, d date")
    assert candidate_date_columns(df) == ["created", "d"]  # ... the type rule keeps it out


def test_percent_and_revenue_share_rules():
    assert is_percent_name("growth_pct") and is_percent_name("Market_Share") and is_percent_name("percentage")
    assert not is_percent_name("total_sales")
    assert is_revenue_share("What share of revenue per region?", "total_revenue")
    assert not is_revenue_share("What share of users?", "total_revenue")


def test_literal_typing():
    assert (parse_literal("5").kind, parse_literal("5").value) == ("int", 5)
    assert (parse_literal("'2.5'").kind, parse_literal("2.5").value) == ("float", 2.5)
    assert parse_literal("'2023-01-31'").kind == "date"
    assert parse_literal("2023-01").kind == "text"  # only full dates are dates
    assert parse_literal("'North'").value == "North"


def test_aggregate_metadata(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    res = aggregate(df, ["k"], ["sum(v)", "min(k)"])
    assert res.metadata == {"is_aggregate": True, "group_by": ["k"], "metrics": ["sum_v"]}
