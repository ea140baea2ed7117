
from tablework.operators import quality as Q
from tablework.operators.profile import describe_numeric, null_counts


def test_exactly_080_missing_is_not_high(spark):
    # literal frame: 4 of 5 null (0.8) must not be flagged; the constant
    # warning comes from the other column
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, 1.0)], "col1 int, col2 double")
    findings, metrics = Q.preflight(df)
    checks = {(r["check"], r["column"]) for r in findings.collect()}
    assert ("high_missing", "col2") not in checks
    assert ("constant", "col2") in checks
    assert metrics.first()["valid"]


def test_above_080_missing_is_high(spark):
    df = spark.createDataFrame([(i, None if i < 10 else 1.0) for i in range(11)], "a int, b double")
    m = {r["column"]: r["high_missing"] for r in Q.missing_table(df).collect()}
    assert m == {"a": False, "b": True}


def test_empty_table_is_error(spark):
    findings, metrics = Q.preflight(spark.createDataFrame([], "a int"))
    assert [r["check"] for r in findings.collect()] == ["empty"]
    assert not metrics.first()["valid"]


def test_linear_quartiles_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    d = describe_numeric(df).first()
    assert (d["p25"], d["p50"], d["p75"]) == (1.75, 2.5, 3.25)
    vals = [float(v) for v in range(1, 12)] + [100.0]
    t = Q.outlier_table(spark.createDataFrame([(v,) for v in vals], "x double")).first()
    assert t["outliers"] == 1
    small = Q.outlier_table(spark.createDataFrame([(v,) for v in [1.0, 2.0, 100.0]], "x double")).first()
    assert small["outliers"] == 0  # ten rows or fewer are not checked


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert null_counts(df).first()["null_count"] == 2


def test_date_parse_risk(spark):
    df = spark.createDataFrame([("2023-01-01",), ("garbage",), (None,)], "created_at string")
    assert Q.date_parse_table(df).first()["bad_values"] == 1


def test_validate_schema(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "name string, age int, salary double")
    f, ok = Q.validate_schema(df, ["name", "age"], {"age": "int", "salary": "float", "name": "object"})
    assert ok and f.count() == 0
    f, ok = Q.validate_schema(df, ["missing"], {"age": "float"})
    assert not ok and {r["check"] for r in f.collect()} == {"required_columns", "column_type"}
