"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.functions.metrics import looks_aggregate
from tablework.operators import profile as P
from tablework.plans.common import rounded, table
from tablework.plans.q_aggregate import L_NULLS, lineitem_nulls

L_NAN_TAX = "CASE WHEN l_orderkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END"
LINEITEM_NN = f"(SELECT * REPLACE ({L_NULLS} AS l_quantity, {L_NAN_TAX} AS l_tax) FROM lineitem)"

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_nan(spark, sf):
    return lineitem_nulls(spark, sf).withColumn("l_tax", F.expr(L_NAN_TAX))


def _nn(c):
    return f"CASE WHEN NOT isnan({c}) THEN {c} END" if c in ("l_tax",) else c


def _describe_sql():
    parts = []
    for c in LINEITEM_NUMERIC:
        v = f"CAST({_nn(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({v}) AS count, round(avg({v}), 4) AS mean, "
            f"round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, "
            f"round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50, "
            f"round(quantile_cont({v}, 0.75), 4) AS p75, round(max({v}), 4) AS max FROM {LINEITEM_NN}")
    return " UNION ALL ".join(parts)


def _nulls_sql():
    parts = []
    for c in LINEITEM_COLUMNS:
        cond = f"{c} IS NULL OR isnan({c})" if c == "l_tax" else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS \"column\", CAST(count_if({cond}) AS BIGINT) AS null_count FROM {LINEITEM_NN}")
    return " UNION ALL ".join(parts)


def _computed_sql():
    parts = ["SELECT 'result_count' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders"]
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        for stat, fn in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):
            parts.append(f"SELECT '{c}_{stat}', round(CAST({fn}(CAST({c} AS DOUBLE)) AS DOUBLE), 4) FROM orders")
    return " UNION ALL ".join(parts)


# Query texts for the aggregate-detector check.
SQL_TEXTS = ("SELECT region, SUM(sales) FROM t GROUP BY region",
             "select * from t where x > 1",
             "select avg (fare) from trips",
             "select summary from notes",
             "select count(*) from t",
             "select x from t order by x")


def register(reg):
    @reg.add("inspect_schema", """
        WITH d AS (SELECT column_name, column_type, row_number() OVER () - 1 AS ordinal FROM (DESCRIBE orders))
        SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name,
               CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS data_type,
               (SELECT count(*) FROM orders) AS total_rows, 6 AS column_count
        FROM d""")
    def inspect_schema(spark, sf):
        out, sample = P.inspect_schema(table(spark, sf, "orders"))
        if len(sample.take(10)) != 5:
            raise AssertionError("sample must hold five rows")
        return out

    @reg.add("describe_numeric", _describe_sql())
    def describe_numeric(spark, sf):
        return rounded(P.describe_numeric(lineitem_nan(spark, sf)))

    @reg.add("null_counts", _nulls_sql())
    def null_counts(spark, sf):
        return P.null_counts(lineitem_nan(spark, sf))

    @reg.add("computed_values", _computed_sql())
    def computed_values(spark, sf):
        return rounded(P.computed_values(table(spark, sf, "orders")))

    @reg.add("frame_digest", " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, 11 AS n_columns, '{c}' AS \"column\", round(avg({_nn(c)}), 4) AS mean, "
        f"round(CAST(min({_nn(c)}) AS DOUBLE), 4) AS min, round(CAST(max({_nn(c)}) AS DOUBLE), 4) AS max FROM {LINEITEM_NN}"
        for c in LINEITEM_NUMERIC))
    def frame_digest(spark, sf):
        df = lineitem_nan(spark, sf)
        return rounded(P.frame_digest(df, len(P.numeric_columns(df))))

    @reg.add("pick_categorical", """
        WITH c AS (SELECT 'c_name' AS "column", 0 AS ordinal, count(DISTINCT c_name) AS distinct_count FROM customer
                   UNION ALL SELECT 'c_mktsegment', 1, count(DISTINCT c_mktsegment) FROM customer)
        SELECT "column", ordinal, distinct_count,
               ordinal = coalesce((SELECT min(ordinal) FROM c WHERE distinct_count <= 50), 0) AS picked
        FROM c""")
    def pick_categorical(spark, sf):
        df = table(spark, sf, "customer")
        t = P.categorical_table(df)
        if P.pick_categorical(df) != "c_mktsegment":
            raise AssertionError("categorical pick")
        return t.withColumn("ordinal", F.col("ordinal").cast("int"))

    @reg.add("flag_aggregate_queries", " UNION ALL ".join(
        [f"SELECT '{t}' AS text" for t in SQL_TEXTS] + ["SELECT text FROM conversations"]).join(
        ["SELECT text, contains(lower(text), ' group by ') OR regexp_matches(lower(text), "
         "'\\b(sum|avg|count|min|max|median|stddev|std|var|variance)\\s*\\(') AS is_aggregate FROM (", ")"]))
    def flag_aggregate_queries(spark, sf):
        lit = spark.createDataFrame([(t,) for t in SQL_TEXTS], "text string")
        texts = lit.unionByName(table(spark, sf, "conversations").select("text"))
        return texts.select("text", looks_aggregate(F.col("text")).alias("is_aggregate"))
