"""Prepare-data operation queries and the prepare → aggregate chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.functions.dates import coerce_if_dates
from tablework.functions.text import chart_label, format_value
from tablework.operators import aggregate as A
from tablework.operators.prepare import add_date_parts, auto_dates, prepare_data
from tablework.plans.common import as_double, rounded, table
from tablework.plans.q_aggregate import LINEITEM_N, lineitem_nulls
from tablework.plans.q_filters import ORDERS_TD, orders_text_dates


def parts_sql(expr: str, prefix: str, num: str = "INTEGER") -> str:
    """DuckDB text of the six date parts of ``expr``."""
    return (f"CAST(year({expr}) AS {num}) AS {prefix}_year, CAST(month({expr}) AS {num}) AS {prefix}_month, "
            f"CAST(day({expr}) AS {num}) AS {prefix}_day, CAST(week({expr}) AS {num}) AS {prefix}_week, "
            f"CAST(quarter({expr}) AS {num}) AS {prefix}_quarter, strftime({expr}, '%Y-%m') AS {prefix}_ym")


NUM_PARTS = ("year", "month", "day", "week", "quarter")


SHIPPED = ("CASE WHEN o_orderkey % 3 <> 0 THEN date_format(date_add(o_orderdate, 3), 'yyyy-MM-dd') "
           "ELSE 'unknown' END")
SHIPPED_SQL = ("CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') "
               "ELSE 'unknown' END")


def register(reg):
    @reg.add("op_rename", "SELECT o_orderkey, round(o_totalprice, 4) AS price FROM orders")
    def op_rename(spark, sf):
        p = prepare_data(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                         ["rename: o_totalprice->price", "rename: no_such->other"], detect_dates=False)
        return rounded(p.df)

    @reg.add("op_percentage", """
        SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0) * 100, 4) AS tax_percentage
        FROM lineitem""")
    def op_percentage(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
        p = prepare_data(df, ["calculate: tax_percentage = (l_tax / l_discount) * 100",
                              "calculate: growth = a + b"], detect_dates=False)
        if not p.warnings:
            raise AssertionError("unsupported calculation must warn")
        return rounded(p.df.select("l_orderkey", "l_linenumber", "tax_percentage"))

    @reg.add("op_parse_dates", f"""
        SELECT o_orderkey, try_strptime(order_day, '%Y-%m-%d') AS order_day,
               {parts_sql("try_strptime(order_day, '%Y-%m-%d')", "order_day", "DOUBLE")}
        FROM {ORDERS_TD}""")
    def op_parse_dates(spark, sf):
        df = orders_text_dates(spark, sf).select("o_orderkey", "order_day")
        out = prepare_data(df, ["parse_dates: order_day"], detect_dates=False).df
        return as_double(out, *[f"order_day_{x}" for x in NUM_PARTS])

    @reg.add("auto_dates", f"""
        WITH t AS (SELECT o_orderkey, o_orderdate, try_strptime({SHIPPED_SQL}, '%Y-%m-%d') AS shipped,
                          o_orderpriority FROM orders)
        SELECT *, {parts_sql("o_orderdate", "o_orderdate")}, {parts_sql("shipped", "shipped", "DOUBLE")},
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               CAST(day(o_orderdate) AS INTEGER) AS day, strftime(o_orderdate, '%Y-%m') AS ym
        FROM t""")
    def auto_dates_q(spark, sf):
        df = table(spark, sf, "orders").select(
            "o_orderkey", "o_orderdate", F.expr(SHIPPED).alias("shipped"), "o_orderpriority")
        p = prepare_data(df, [])
        if p.date_columns != ["o_orderdate", "shipped"]:
            raise AssertionError(f"date detection found {p.date_columns}")
        return as_double(p.df, *[f"shipped_{x}" for x in NUM_PARTS])

    @reg.add("date_parts", f"""
        SELECT l_orderkey, l_linenumber, l_shipdate, {parts_sql("l_shipdate", "l_shipdate")} FROM lineitem""")
    def date_parts(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
        return add_date_parts(df, "l_shipdate")

    @reg.add("date_generic", """
        SELECT event_id, 'keep' AS month, CAST(year(ts) AS INTEGER) AS year, CAST(day(ts) AS INTEGER) AS day,
               strftime(ts, '%Y-%m') AS ym FROM events""")
    def date_generic(spark, sf):
        df = table(spark, sf, "events").select("event_id", "ts", F.lit("keep").alias("month"))
        out, _ = auto_dates(df)
        return out.select("event_id", "month", "year", "day", "ym")

    @reg.add("op_extract_month", """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS year
        FROM orders""")
    def op_extract_month(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
        return prepare_data(df, ["extract_month"]).df.select("o_orderkey", "month", "year")

    @reg.add("op_extract_year", """
        SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders""")
    def op_extract_year(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
        return prepare_data(df, ["extract_year"]).df.select("o_orderkey", "year")

    @reg.add("op_extract_quarter", """
        SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter
        FROM orders""")
    def op_extract_quarter(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
        return prepare_data(df, ["extract_quarter"], detect_dates=False).df.select("o_orderkey", "quarter")

    @reg.add("axis_dates", """
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS seen_at,
               CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'later' END AS maybe
        FROM events""")
    def axis_dates(spark, sf):
        df = table(spark, sf, "events").select(
            "event_id",
            F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
             .otherwise(F.lit("x")).alias("seen_at"),
            F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd"))
             .otherwise(F.lit("later")).alias("maybe"))
        df, yes = coerce_if_dates(df, "seen_at", 0.5)
        df, no = coerce_if_dates(df, "maybe", 0.5)
        if not yes or no:
            raise AssertionError("axis date rule misjudged a column")
        return df

    @reg.add("format_values", """
        WITH a AS (SELECT l_returnflag, avg(l_discount) AS discount_ratio, sum(l_extendedprice) AS total_sales,
                          avg(l_quantity) AS avg_qty, avg(l_tax) * 100 AS tax_pct, -sum(l_tax) AS net_tax
                   FROM lineitem GROUP BY l_returnflag)
        SELECT l_returnflag,
               printf('%.1f%%', discount_ratio * 100) AS discount_ratio_text,
               format('{:,.2f}', total_sales) AS total_sales_text,
               printf('%.2f', avg_qty) AS avg_qty_text,
               printf('%.1f%%', tax_pct) AS tax_pct_text,
               CASE WHEN abs(net_tax) >= 1000 THEN format('{:,.2f}', net_tax) ELSE printf('%.2f', net_tax) END AS net_tax_text
        FROM a""")
    def format_values(spark, sf):
        a = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
            F.avg("l_discount").alias("discount_ratio"), F.sum("l_extendedprice").alias("total_sales"),
            F.avg("l_quantity").alias("avg_qty"), (F.avg("l_tax") * 100).alias("tax_pct"),
            (-F.sum("l_tax")).alias("net_tax"))
        return a.select("l_returnflag", *[
            format_value(F.col(c), c).alias(f"{c}_text")
            for c in ("discount_ratio", "total_sales", "avg_qty", "tax_pct", "net_tax")])

    @reg.add("chart_labels", """
        WITH t AS (SELECT p_partkey, p_name || ' / ' || p_type || ' / ' || p_brand || ' / size ' || CAST(p_size AS VARCHAR) AS s
                   FROM part)
        SELECT p_partkey, CASE WHEN length(s) > 36 THEN substr(s, 1, 35) || '…' ELSE s END AS label FROM t""")
    def chart_labels(spark, sf):
        df = table(spark, sf, "part")
        s = F.concat_ws(" / ", "p_name", "p_type", "p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string")))
        return df.select("p_partkey", chart_label(s, 36).alias("label"))

    @reg.add("prepare_chain", f"""
        SELECT DISTINCT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price,
               round(l_tax / nullif(l_discount, 0) * 100, 4) AS tax_percentage,
               CAST(year(l_shipdate) AS VARCHAR) AS year
        FROM {LINEITEM_N}
        WHERE l_returnflag IN ('R', 'A') AND l_discount > 0.02 AND l_quantity IS NOT NULL""")
    def prepare_chain(spark, sf):
        p = prepare_data(lineitem_nulls(spark, sf), [
            "filter: l_returnflag IN ('R','A') AND l_discount > 0.02",
            "drop_na: l_quantity",
            "rename: l_extendedprice->price",
            "calculate: tax_percentage = (l_tax / l_discount) * 100",
            "extract_year",
            "sort: price",
            "bogus_op: 1",
        ])
        if not any("Unknown operation" in w for w in p.warnings):
            raise AssertionError("unknown op must warn")
        out = p.df.select("l_orderkey", "l_linenumber", "price", "tax_percentage", "year")
        return rounded(out.transform(lambda d: d.dropDuplicates()))

    @reg.add("prepare_then_aggregate", """
        SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
               round(avg(o_totalprice), 4) AS avg_o_totalprice, count(*) AS count_all
        FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
    def prepare_then_aggregate(spark, sf):
        p = prepare_data(table(spark, sf, "orders"), ["filter: o_orderstatus != 'P'", "extract_quarter"])
        return rounded(A.aggregate(p.df, ["quarter"], ["avg(o_totalprice)", "count(*)"]).df)
