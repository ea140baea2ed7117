"""Aggregation, sort and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.functions.text import question_smallest_first, question_top_n
from tablework.operators import aggregate as A
from tablework.operators.prepare import prepare_data, sort_by
from tablework.plans.common import rounded, table

# Edge rules made inside queries (same rule in the oracle SQL).
L_NULLS = "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END"
O_NULL_KEYS = "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END"

LINEITEM_N = f"(SELECT * REPLACE ({L_NULLS} AS l_quantity) FROM lineitem)"
ORDERS_NK = f"(SELECT * REPLACE ({O_NULL_KEYS} AS o_orderpriority) FROM orders)"


def lineitem_nulls(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_quantity", F.expr(L_NULLS))


def orders_null_keys(spark, sf):
    return table(spark, sf, "orders").withColumn("o_orderpriority", F.expr(O_NULL_KEYS))


def brand_revenue(spark, sf):
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return A.aggregate(j, ["p_brand"], [
        "sum(l_extendedprice * (1 - l_discount)) AS revenue", "count(*)"])


BRAND_REVENUE_SQL = """
  SELECT p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS count_all
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""


def register(reg):
    @reg.add("agg_monthly", """
        SELECT strftime(o_orderdate, '%Y-%m') AS month,
               round(sum(o_totalprice), 4) AS sum_o_totalprice, count(*) AS count_all
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
    def agg_monthly(spark, sf):
        prep = prepare_data(table(spark, sf, "orders"),
                            ["filter: o_orderstatus == 'F'", "extract_month"], detect_dates=False)
        res = A.aggregate(prep.df, ["month"], ["sum(o_totalprice)", "count(*)"])
        return rounded(res.df)

    @reg.add("agg_quarterly", """
        SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
               round(sum(o_totalprice), 4) AS sum_o_totalprice, count(*) AS count_all
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
    def agg_quarterly(spark, sf):
        df = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
        return rounded(A.period_aggregate(df, "quarter", ["sum(o_totalprice)", "count(*)"]).df)

    @reg.add("agg_yearly", """
        SELECT CAST(year(o_orderdate) AS VARCHAR) AS year,
               round(avg(o_totalprice), 4) AS avg_o_totalprice, count(*) AS count_all
        FROM orders GROUP BY 1""")
    def agg_yearly(spark, sf):
        df = table(spark, sf, "orders")
        return rounded(A.period_aggregate(df, "year", ["avg(o_totalprice)", "count(*)"]).df)

    @reg.add("agg_grouped", f"""
        SELECT o_orderpriority, round(sum(o_totalprice), 4) AS sum_o_totalprice,
               round(avg(o_totalprice), 4) AS avg_o_totalprice, count(*) AS count_all
        FROM {ORDERS_NK} GROUP BY o_orderpriority""")
    def agg_grouped(spark, sf):
        res = A.aggregate(orders_null_keys(spark, sf), ["o_orderpriority"],
                          ["sum(o_totalprice)", "avg(o_totalprice)", "count(*)"])
        return rounded(res.df)

    @reg.add("agg_two_keys", f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_l_quantity,
               count(l_quantity) AS count_l_quantity, round(max(l_extendedprice), 4) AS max_l_extendedprice
        FROM {LINEITEM_N} GROUP BY l_returnflag, l_linestatus""")
    def agg_two_keys(spark, sf):
        res = A.aggregate(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus"],
                          ["sum(l_quantity)", "count(l_quantity)", "max(l_extendedprice)"])
        return rounded(res.df)

    @reg.add("agg_global", f"""
        SELECT round(sum(l_extendedprice), 4) AS sum_l_extendedprice, min(l_shipdate) AS min_l_shipdate,
               count(*) AS count_all, round(avg(l_quantity), 4) AS avg_l_quantity
        FROM {LINEITEM_N}""")
    def agg_global(spark, sf):
        res = A.aggregate(lineitem_nulls(spark, sf), [],
                          ["sum(l_extendedprice)", "min(l_shipdate)", "count(*)", "avg(l_quantity)"])
        return rounded(res.df)

    @reg.add("agg_count_all", """
        SELECT l_returnflag, count(1) AS count_all FROM lineitem GROUP BY l_returnflag""")
    def agg_count_all(spark, sf):
        return A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag"], ["count(1)"]).df

    @reg.add("agg_expr", """
        SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM lineitem GROUP BY l_returnflag""")
    def agg_expr(spark, sf):
        res = A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag"],
                          ["sum(l_extendedprice*(1-l_discount)) AS revenue"])
        return rounded(res.df)

    @reg.add("agg_count_distinct", """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
        FROM lineitem GROUP BY l_returnflag""")
    def agg_count_distinct(spark, sf):
        res = A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag"],
                          ["count(distinct l_partkey) AS parts", "count(distinct l_suppkey) AS suppliers"])
        return res.df

    @reg.add("agg_bare", f"""
        SELECT l_linestatus, round(max(l_quantity) - min(l_quantity), 4) AS metric_1,
               round(sum(l_tax) / count(*), 4) AS metric_2
        FROM {LINEITEM_N} GROUP BY l_linestatus""")
    def agg_bare(spark, sf):
        res = A.aggregate(lineitem_nulls(spark, sf), ["l_linestatus"],
                          ["max(l_quantity) - min(l_quantity)", "sum(l_tax) / count(*)"])
        return rounded(res.df)

    @reg.add("agg_functions", f"""
        SELECT l_linestatus, round(sum(l_quantity), 4) AS sum_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity,
               count(l_quantity) AS count_l_quantity, round(min(l_quantity), 4) AS min_l_quantity,
               round(max(l_quantity), 4) AS max_l_quantity, min(l_returnflag) AS min_l_returnflag,
               max(l_shipdate) AS max_l_shipdate
        FROM {LINEITEM_N} GROUP BY l_linestatus""")
    def agg_functions(spark, sf):
        res = A.aggregate(lineitem_nulls(spark, sf), ["l_linestatus"], [
            "sum(l_quantity)", "avg(l_quantity)", "count(l_quantity)", "min(l_quantity)",
            "max(l_quantity)", "min(l_returnflag)", "max(l_shipdate)"])
        return rounded(res.df)

    @reg.add("agg_spread", f"""
        SELECT l_returnflag, round(median(l_quantity), 4) AS median_l_quantity,
               round(stddev_samp(l_extendedprice), 4) AS stddev_l_extendedprice,
               round(stddev_samp(l_extendedprice), 4) AS std_l_extendedprice,
               round(var_samp(l_discount), 4) AS variance_l_discount,
               round(var_samp(l_tax), 4) AS var_l_tax
        FROM {LINEITEM_N} GROUP BY l_returnflag""")
    def agg_spread(spark, sf):
        res = A.aggregate(lineitem_nulls(spark, sf), ["l_returnflag"], [
            "median(l_quantity)", "stddev(l_extendedprice)", "std(l_extendedprice)",
            "variance(l_discount)", "var(l_tax)"])
        return rounded(res.df)

    topk_sql = """
        WITH agg AS ({agg}), m AS (
          SELECT 'revenue' AS metric, p_brand, revenue AS value FROM agg
          UNION ALL SELECT 'count_all', p_brand, CAST(count_all AS DOUBLE) FROM agg)
        SELECT metric, p_brand, round(value, 4) AS value, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value {dir}, p_brand ASC NULLS LAST) AS rank
          FROM m {where}) WHERE rank <= 5"""

    @reg.add("agg_order_expr", """
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS grp, round(median(l_extendedprice) * 2, 4) AS m,
               round(max(l_extendedprice) - median(l_extendedprice), 4) AS above, round(quantile_cont(l_quantity, 0.9) / avg(l_quantity), 4) AS p90_ratio,
               round(median(l_extendedprice * (1 - l_discount)), 4) AS net, count(*) AS n
        FROM lineitem GROUP BY 1""")
    def agg_order_expr(spark, sf):
        items = table(spark, sf, "lineitem").withColumn("grp", F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END"))
        res = A.aggregate(items, ["grp"], ["median(l_extendedprice) * 2 AS m", "max(l_extendedprice) - median(l_extendedprice) AS above",
                                           "percentile(l_quantity, 0.9) / avg(l_quantity) AS p90_ratio", "median(l_extendedprice * (1 - l_discount)) AS net", "count(*) AS n"])
        return rounded(res.df)

    @reg.add("agg_order_expr_global", """
        SELECT round(median(o_totalprice) - min(o_totalprice), 4) AS lift, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, count(*) AS n FROM orders""")
    def agg_order_expr_global(spark, sf):
        res = A.aggregate(table(spark, sf, "orders"), [], ["median(o_totalprice) - min(o_totalprice) AS lift", "percentile(o_totalprice, 0.25) AS q1", "count(*) AS n"])
        return rounded(res.df)

    @reg.add("agg_topk", topk_sql.format(agg=BRAND_REVENUE_SQL, dir="DESC NULLS LAST", where=""))
    def agg_topk(spark, sf):
        res = brand_revenue(spark, sf)
        return rounded(A.top_k(res.df, res.group_by, res.metrics, 5))

    @reg.add("agg_bottomk", topk_sql.format(agg=BRAND_REVENUE_SQL, dir="ASC", where="WHERE value IS NOT NULL"))
    def agg_bottomk(spark, sf):
        res = brand_revenue(spark, sf)
        return rounded(A.bottom_k(res.df, res.group_by, res.metrics, 5))

    @reg.add("agg_extrema", f"""
        WITH agg AS ({BRAND_REVENUE_SQL}), m AS (
          SELECT 'revenue' AS metric, p_brand, revenue AS value FROM agg
          UNION ALL SELECT 'count_all', p_brand, CAST(count_all AS DOUBLE) FROM agg),
        hi AS (SELECT metric, p_brand AS max_p_brand, value AS max_value FROM (
          SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, p_brand ASC NULLS LAST) AS r
          FROM m WHERE value IS NOT NULL) WHERE r = 1),
        lo AS (SELECT metric, p_brand AS min_p_brand, value AS min_value FROM (
          SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value ASC, p_brand ASC NULLS LAST) AS r
          FROM m WHERE value IS NOT NULL) WHERE r = 1)
        SELECT hi.metric, round(max_value, 4) AS max_value, round(min_value, 4) AS min_value,
               max_p_brand, min_p_brand
        FROM hi JOIN lo USING (metric)""")
    def agg_extrema(spark, sf):
        res = brand_revenue(spark, sf)
        return rounded(A.extrema(res.df, res.group_by, res.metrics))

    @reg.add("share_of_total", """
        WITH agg AS (
          SELECT r_name, sum(o_totalprice) AS total_revenue
          FROM orders JOIN customer ON o_custkey = c_custkey
                      JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey
          GROUP BY r_name)
        SELECT r_name, round(total_revenue, 4) AS total_revenue,
               round(total_revenue / (SELECT sum(total_revenue) FROM agg) * 100, 4) AS share_pct
        FROM agg""")
    def share_of_total(spark, sf):
        res = A.aggregate(region_orders(spark, sf), ["r_name"], ["sum(o_totalprice) AS total_revenue"])
        return rounded(A.share_of_total(res.df, "total_revenue"))

    @reg.add("agg_dict", """
        SELECT l_returnflag, round(sum(l_quantity), 4) AS "sum(l_quantity)",
               round(max(l_tax), 4) AS "max(l_tax)"
        FROM lineitem GROUP BY l_returnflag""")
    def agg_dict(spark, sf):
        return rounded(A.aggregate_dict(table(spark, sf, "lineitem"), ["l_returnflag"],
                                        {"l_quantity": "sum", "l_tax": "max"}))

    @reg.add("op_sort", f"""
        SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice
        FROM {ORDERS_NK}""")
    def op_sort(spark, sf):
        df = orders_null_keys(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice")
        return rounded(sort_by(df, "o_orderpriority"))

    @reg.add("sort_limit", """
        SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
    def sort_limit(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        return rounded(df.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10))

    @reg.add("topn_sum", """
        SELECT p_brand, round(sum(l_extendedprice), 4) AS l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_brand IS NOT NULL GROUP BY p_brand
        ORDER BY sum(l_extendedprice) DESC, p_brand LIMIT 30""")
    def topn_sum(spark, sf):
        li = table(spark, sf, "lineitem")
        part = table(spark, sf, "part")
        j = li.join(part, li.l_partkey == part.p_partkey).select("p_brand", "l_extendedprice")
        return rounded(A.top_n_sum(j, "p_brand", "l_extendedprice", 30))

    @reg.add("question_top_n", f"""
        WITH q AS ({QUESTIONS_SQL})
        SELECT question,
               CAST(coalesce(
                 CASE WHEN TRY_CAST(regexp_extract(lower(question), '\\b(?:top|best|highest|most|largest|first|biggest)\\s+(\\d+)\\b', 1) AS INTEGER) BETWEEN 1 AND 100
                      THEN TRY_CAST(regexp_extract(lower(question), '\\b(?:top|best|highest|most|largest|first|biggest)\\s+(\\d+)\\b', 1) AS INTEGER) END,
                 CASE WHEN TRY_CAST(regexp_extract(lower(question), '\\b(?:worst|lowest|smallest|bottom)\\s+(\\d+)\\b', 1) AS INTEGER) BETWEEN 1 AND 100
                      THEN TRY_CAST(regexp_extract(lower(question), '\\b(?:worst|lowest|smallest|bottom)\\s+(\\d+)\\b', 1) AS INTEGER) END,
                 CASE WHEN TRY_CAST(regexp_extract(lower(question), '\\btop-(\\d+)\\b', 1) AS INTEGER) BETWEEN 1 AND 100
                      THEN TRY_CAST(regexp_extract(lower(question), '\\btop-(\\d+)\\b', 1) AS INTEGER) END) AS DOUBLE) AS n,
               regexp_extract(lower(question), '\\b(?:top|best|highest|most|largest|first|biggest)\\s+(\\d+)\\b', 1) = ''
               AND regexp_extract(lower(question), '\\b(?:worst|lowest|smallest|bottom)\\s+(\\d+)\\b', 1) <> '' AS smallest_first
        FROM q""")
    def question_top_n_q(spark, sf):
        q = questions(spark, sf)
        return q.select("question", question_top_n(F.col("question")).cast("double").alias("n"),
                        question_smallest_first(F.col("question")).alias("smallest_first"))


# Question texts of the top-N check (FIXTURES.md §3).
QUESTIONS = ("top 5 products", "best 12 customers", "highest 3 regions", "top-7 parts",
             "top 500 rows", "monthly trend", "worst 4 suppliers", "lowest 2 nations")

QUESTIONS_SQL = " UNION ALL ".join(f"SELECT '{q}' AS question" for q in QUESTIONS) + \
    " UNION ALL SELECT text AS question FROM conversations"


def questions(spark, sf):
    lit = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    conv = table(spark, sf, "conversations").select(F.col("text").alias("question"))
    return lit.unionByName(conv)


def region_orders(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))
