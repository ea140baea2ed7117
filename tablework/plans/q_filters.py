"""Filter-language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.functions.filters import apply_filter
from tablework.operators.prepare import drop_na, remove_duplicates
from tablework.plans.common import rounded, table
from tablework.plans.q_aggregate import (LINEITEM_N, ORDERS_NK, lineitem_nulls,
                                         orders_null_keys)

# Text dates with bad rows (FIXTURES §3): yyyy-MM-dd, ``n/a`` where o_orderkey % 13 = 0.
O_TEXT_DATE = "CASE WHEN o_orderkey % 13 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'n/a' END"
O_TEXT_DATE_SQL = "CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END"


def orders_text_dates(spark, sf):
    return table(spark, sf, "orders").withColumn("order_day", F.expr(O_TEXT_DATE))


ORDERS_TD = f"(SELECT *, {O_TEXT_DATE_SQL} AS order_day FROM orders)"


def _keys(df, *cols):
    return rounded(df.select(*cols))


def register(reg):
    @reg.add("filter_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
    def filter_eq(spark, sf):
        return _keys(apply_filter(table(spark, sf, "orders"), "o_orderstatus == 'O'"),
                     "o_orderkey", "o_orderstatus")

    @reg.add("filter_ne", f"""
        SELECT o_orderkey, o_orderpriority FROM {ORDERS_NK}
        WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'""")
    def filter_ne(spark, sf):
        return _keys(apply_filter(orders_null_keys(spark, sf), "o_orderpriority != '1-URGENT'"),
                     "o_orderkey", "o_orderpriority")

    @reg.add("filter_cmp", f"""
        SELECT l_orderkey, l_linenumber, l_quantity FROM {LINEITEM_N}
        WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.05 AND l_tax > 0.02""")
    def filter_cmp(spark, sf):
        df = apply_filter(lineitem_nulls(spark, sf),
                          "l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.05 AND l_tax > 0.02")
        return _keys(df, "l_orderkey", "l_linenumber", "l_quantity")

    @reg.add("filter_cmp_coerce", """
        SELECT o_orderkey FROM orders
        WHERE TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) > 250000.5""")
    def filter_cmp_coerce(spark, sf):
        df = table(spark, sf, "orders").withColumn("price_text", F.col("o_totalprice").cast("string"))
        return _keys(apply_filter(df, "price_text > 250000.5"), "o_orderkey")

    @reg.add("filter_date", f"""
        SELECT o_orderkey, order_day FROM {ORDERS_TD}
        WHERE o_orderdate >= TIMESTAMP '1996-01-01'
          AND try_strptime(order_day, '%Y-%m-%d') < TIMESTAMP '1998-06-30'""")
    def filter_date(spark, sf):
        df = apply_filter(orders_text_dates(spark, sf),
                          "o_orderdate >= '1996-01-01' AND order_day < '1998-06-30'")
        return _keys(df, "o_orderkey", "order_day")

    @reg.add("filter_in", """
        SELECT l_orderkey, l_linenumber FROM lineitem
        WHERE l_linenumber IN (1, 3) AND l_returnflag IN ('R', 'A')""")
    def filter_in(spark, sf):
        df = apply_filter(table(spark, sf, "lineitem"),
                          "l_linenumber in [1, 3] AND l_returnflag IN ('R', 'A')")
        return _keys(df, "l_orderkey", "l_linenumber")

    @reg.add("filter_between", f"""
        SELECT l_orderkey, l_linenumber FROM {LINEITEM_N}
        WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'N'""")
    def filter_between(spark, sf):
        df = apply_filter(lineitem_nulls(spark, sf), "l_quantity BETWEEN 10 AND 20 AND l_returnflag == 'N'")
        return _keys(df, "l_orderkey", "l_linenumber")

    @reg.add("filter_between_dates", f"""
        SELECT o_orderkey FROM {ORDERS_TD}
        WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
           OR try_strptime(order_day, '%Y-%m-%d') BETWEEN TIMESTAMP '2000-03-01' AND TIMESTAMP '2000-03-31'""")
    def filter_between_dates(spark, sf):
        df = apply_filter(orders_text_dates(spark, sf),
                          "o_orderdate between '1996-01-01' and '1996-12-31' "
                          "or order_day BETWEEN '2000-03-01' AND '2000-03-31'")
        return _keys(df, "o_orderkey")

    @reg.add("filter_contains", """
        SELECT p_partkey, p_name FROM (
          SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS p_name FROM part)
        WHERE coalesce(regexp_matches(p_name, '(?i)R[eo]d|GEAR'), false)""")
    def filter_contains(spark, sf):
        df = table(spark, sf, "part").select(
            "p_partkey", F.expr("CASE WHEN p_partkey % 9 <> 0 THEN p_name END").alias("p_name"))
        return _keys(apply_filter(df, "p_name CONTAINS 'R[eo]d|GEAR'"), "p_partkey", "p_name")

    @reg.add("filter_isnull", f"SELECT o_orderkey FROM {ORDERS_NK} WHERE o_orderpriority IS NULL")
    def filter_isnull(spark, sf):
        return _keys(apply_filter(orders_null_keys(spark, sf), "o_orderpriority ISNULL"), "o_orderkey")

    @reg.add("filter_notnull", f"""
        SELECT l_orderkey, l_linenumber FROM {LINEITEM_N} WHERE l_quantity IS NOT NULL AND l_linenumber = 2""")
    def filter_notnull(spark, sf):
        df = apply_filter(lineitem_nulls(spark, sf), "l_quantity notnull and l_linenumber == 2")
        return _keys(df, "l_orderkey", "l_linenumber")

    @reg.add("filter_and_or", """
        SELECT o_orderkey FROM orders
        WHERE (o_orderstatus = 'F' AND o_totalprice > 400000)
           OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
    def filter_and_or(spark, sf):
        df = apply_filter(table(spark, sf, "orders"),
                          "o_orderstatus == 'F' AND o_totalprice > 400000 "
                          "OR o_orderpriority == '1-URGENT' and o_orderstatus == 'P'")
        return _keys(df, "o_orderkey")

    @reg.add("filter_unknown", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
    def filter_unknown(spark, sf):
        warnings = []
        df = apply_filter(table(spark, sf, "orders"),
                          "no_such_column == 5 AND o_orderstatus == 'P' AND this is not a predicate",
                          warnings=warnings)
        if len(warnings) != 2:
            raise AssertionError(f"expected two warnings, got {warnings}")
        return _keys(df, "o_orderkey")

    @reg.add("filter_quoted", """
        WITH t AS (SELECT n_nationkey,
                          n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' AND y' ELSE ' OR y' END AS label
                   FROM nation)
        SELECT n_nationkey, label FROM t
        WHERE label = 'NATION_4 AND y' OR label = 'NATION_7 OR y' OR label = 'NATION_9 AND y'""")
    def filter_quoted(spark, sf):
        df = table(spark, sf, "nation").select(
            "n_nationkey",
            F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit(" AND y"))
                     .otherwise(F.lit(" OR y"))).alias("label"))
        out = apply_filter(df, "label == 'NATION_4 AND y' OR label == \"NATION_7 OR y\" "
                               "OR label == 'NATION_9 AND y'")
        return _keys(out, "n_nationkey", "label")

    @reg.add("op_drop_na", f"""
        SELECT l_orderkey, l_linenumber FROM {LINEITEM_N} WHERE l_quantity IS NOT NULL""")
    def op_drop_na(spark, sf):
        return _keys(drop_na(lineitem_nulls(spark, sf), "l_quantity"), "l_orderkey", "l_linenumber")

    @reg.add("op_dedupe", """
        SELECT DISTINCT * FROM (
          SELECT * FROM nation
          UNION ALL SELECT * FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region))""")
    def op_dedupe(spark, sf):
        nation = table(spark, sf, "nation")
        first_region = table(spark, sf, "region").agg(F.min("r_regionkey")).scalar()
        both = nation.unionByName(nation.where(F.col("n_regionkey") == first_region))
        return remove_duplicates(both)
