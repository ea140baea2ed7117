"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators import quality as Q
from tablework.plans.common import rounded, table
from tablework.plans.q_aggregate import L_NULLS, lineitem_nulls
from tablework.plans.q_filters import O_TEXT_DATE_SQL, orders_text_dates

MOSTLY = "CASE WHEN l_orderkey % 10 = 0 THEN l_tax END"
NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "mostly")
DQ_COLS = (*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")
DQ_FRAME = f"(SELECT * REPLACE ({L_NULLS} AS l_quantity), {MOSTLY} AS mostly FROM lineitem)"


def dq_frame(spark, sf):
    """lineitem whole, with missing quantities and a column that is mostly null."""
    return lineitem_nulls(spark, sf).withColumn("mostly", F.expr(MOSTLY))


def _outlier_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(f"""
          SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
                 CASE WHEN q3 - q1 = 0 THEN 0 ELSE
                   (SELECT count(*) FROM {tbl} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) END AS outliers
          FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {tbl})""")
    inner = " UNION ALL ".join(parts)
    return (f"SELECT \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, "
            f"round(lower, 4) AS lower, round(upper, 4) AS upper, outliers FROM ({inner})")


def register(reg):
    @reg.add("dq_missing_ratio", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
        f"round(count_if({c} IS NULL) / count(*), 4) AS missing_ratio, "
        f"count_if({c} IS NULL) / count(*) > 0.8 AS high_missing FROM {DQ_FRAME}"
        for c in DQ_COLS))
    def dq_missing_ratio(spark, sf):
        return rounded(Q.missing_table(dq_frame(spark, sf)))

    @reg.add("dq_date_parse", f"""
        SELECT 'order_date_text' AS "column",
               CAST(count_if(order_date_text IS NOT NULL AND try_strptime(order_date_text, '%Y-%m-%d') IS NULL) AS BIGINT) AS bad_values
        FROM (SELECT {O_TEXT_DATE_SQL} AS order_date_text FROM orders)""")
    def dq_date_parse(spark, sf):
        df = orders_text_dates(spark, sf).withColumnRenamed("order_day", "order_date_text") \
            .select("o_orderkey", "o_orderpriority", "order_date_text")
        return Q.date_parse_table(df)

    @reg.add("dq_constant", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, min({c}) = max({c}) AS is_constant "
        f"FROM (SELECT *, CAST(1.0 AS DOUBLE) AS one FROM {DQ_FRAME})" for c in (*NUMBERS, "one")))
    def dq_constant(spark, sf):
        return rounded(Q.constant_table(dq_frame(spark, sf).withColumn("one", F.lit(1.0))))

    @reg.add("dq_outliers", _outlier_sql("events", ("event_id", "user_id", "value")))
    def dq_outliers(spark, sf):
        return rounded(Q.outlier_table(table(spark, sf, "events")))

    @reg.add("dq_outliers_none", _outlier_sql("part", ("p_partkey", "p_size", "p_retailprice")))
    def dq_outliers_none(spark, sf):
        return rounded(Q.outlier_table(table(spark, sf, "part")))

    @reg.add("dq_preflight", f"""
        SELECT count(*) AS row_count, {len(DQ_COLS)} AS column_count, {len(NUMBERS)} AS numeric_columns,
               CAST({" + ".join(f"(count_if({c} IS NULL) / count(*) > 0.8)::INT" for c in DQ_COLS)} AS INTEGER) AS high_missing_columns,
               count(*) >= 1 AS valid
        FROM {DQ_FRAME}""")
    def dq_preflight(spark, sf):
        findings, metrics = Q.preflight(dq_frame(spark, sf))
        checks = {r["check"] for r in findings.collect()}
        if "high_missing" not in checks:
            raise AssertionError(f"preflight missed the mostly-null column: {checks}")
        return metrics

    @reg.add("dq_schema", """
        WITH have AS (SELECT column_name, lower(column_type) AS kind FROM (DESCRIBE lineitem)),
             gone AS (SELECT c FROM (VALUES ('l_orderkey'), ('no_such_column')) w(c) WHERE c NOT IN (SELECT column_name FROM have)),
             odd AS (SELECT c, kind, want FROM have JOIN (VALUES ('l_quantity', 'float', 'float|double|decimal.*'),
                       ('l_orderkey', 'object', 'string|varchar'), ('l_tax', 'float', 'float|double|decimal.*')) w(c, want, fits)
                     ON column_name = c WHERE NOT regexp_full_match(kind, fits))
        SELECT 'required_columns' AS "check", string_agg(c, ',') AS "column", 'error' AS severity, CAST(count(*) AS DOUBLE) AS value,
               'Columns wanted and not there: ' || string_agg(c, ', ') AS message FROM gone HAVING count(*) > 0
        UNION ALL SELECT 'column_type', c, 'warning', NULL, c || ': ' || kind || ' where ' || want || ' was wanted' FROM odd
        UNION ALL SELECT 'min_rows', NULL, 'error', 0, '0 rows, at least 1 wanted' WHERE (SELECT count(*) FROM lineitem) = 0""")
    def dq_schema(spark, sf):
        findings, _ = Q.validate_schema(table(spark, sf, "lineitem"),
                                        required=["l_orderkey", "no_such_column"],
                                        types={"l_quantity": "float", "l_orderkey": "object", "l_tax": "float"})
        return findings
