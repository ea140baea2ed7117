"""Summary-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators import aggregate as A
from tablework.operators import facts as N
from tablework.operators.prepare import prepare_data
from tablework.plans.common import rounded, table
from tablework.plans.q_aggregate import BRAND_REVENUE_SQL, brand_revenue, region_orders

REGION_SQL = """
  SELECT r_name, sum(o_totalprice) AS total_revenue, avg(o_totalprice) AS avg_o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""

MONTHLY_SQL = """
  SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1"""


def fmt_sql(v: str) -> str:
    v = f"CAST({v} AS DOUBLE)"
    return f"CASE WHEN abs({v}) >= 1000 THEN format('{{:,.2f}}', {v}) ELSE printf('%.2f', {v}) END"


def pct_sql(v: str) -> str:
    return (f"CASE WHEN {v} >= 0 AND {v} <= 1 THEN printf('%.1f%%', {v} * 100) "
            f"WHEN {v} > 1 AND {v} <= 100 THEN printf('%.1f%%', {v}) ELSE {fmt_sql(v)} END")


def region_agg(spark, sf):
    return A.aggregate(region_orders(spark, sf), ["r_name"],
                       ["sum(o_totalprice) AS total_revenue", "avg(o_totalprice)"])


def register(reg):
    @reg.add("summary_scalar", f"""
        SELECT 'sum_l_extendedprice' AS "column", round(s, 4) AS value,
               'sum_l_extendedprice is ' || {fmt_sql('s')} || ' (aggregated result).' AS text
        FROM (SELECT sum(l_extendedprice) AS s FROM lineitem)""")
    def summary_scalar(spark, sf):
        res = A.aggregate(table(spark, sf, "lineitem"), [], ["sum(l_extendedprice)"])
        return rounded(N.scalar_fact(res.df, is_aggregate=True))

    @reg.add("summary_groups", f"""
        WITH a AS ({REGION_SQL}), m AS (
          SELECT 'total_revenue' AS metric, r_name, total_revenue AS v FROM a
          UNION ALL SELECT 'avg_o_totalprice', r_name, avg_o_totalprice FROM a),
        hi AS (SELECT * FROM (SELECT metric, r_name, v, row_number() OVER (PARTITION BY metric ORDER BY v DESC, r_name) AS r FROM m) WHERE r = 1),
        lo AS (SELECT * FROM (SELECT metric, r_name, v, row_number() OVER (PARTITION BY metric ORDER BY v ASC, r_name) AS r FROM m) WHERE r = 1)
        SELECT hi.metric, 'r_name=' || hi.r_name AS top_label, round(hi.v, 4) AS top_value,
               'r_name=' || lo.r_name AS bottom_label, round(lo.v, 4) AS bottom_value,
               (SELECT count(*) FROM a) AS groups
        FROM hi JOIN lo USING (metric)""")
    def summary_groups(spark, sf):
        res = region_agg(spark, sf)
        return rounded(N.group_facts(res.df, res.group_by, res.metrics))

    @reg.add("summary_trend", f"""
        WITH a AS ({MONTHLY_SQL}), s AS (
          SELECT count(*) AS periods, arg_min(revenue, month) AS first_value, arg_max(revenue, month) AS last_value,
                 avg(revenue) AS mean, stddev_samp(revenue) AS std FROM a),
        pk AS (SELECT month AS peak_period, revenue AS peak_value FROM a ORDER BY revenue DESC, month LIMIT 1),
        tr AS (SELECT month AS trough_period, revenue AS trough_value FROM a ORDER BY revenue ASC, month LIMIT 1),
        f AS (SELECT s.*, pk.*, tr.*,
                 CASE WHEN first_value <> 0 THEN (last_value - first_value) / first_value * 100 ELSE 0 END AS change_pct,
                 CASE WHEN trough_value <> 0 THEN (peak_value - trough_value) / trough_value * 100 ELSE 0 END AS peak_to_trough_pct,
                 CASE WHEN mean <> 0 THEN coalesce(std, 0) / mean * 100 ELSE 0 END AS cv_pct
              FROM s, pk, tr)
        SELECT periods, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value,
               round(change_pct, 4) AS change_pct, peak_period, round(peak_value, 2) AS peak_value,
               trough_period, round(trough_value, 2) AS trough_value, round(peak_to_trough_pct, 4) AS peak_to_trough_pct,
               round(mean, 2) AS mean, round(cv_pct, 4) AS cv_pct,
               CASE WHEN abs(change_pct) < 5 THEN 'relatively stable'
                    WHEN change_pct > 0 THEN CASE WHEN change_pct > 15 THEN 'upward trending' ELSE 'moderately increasing' END
                    ELSE CASE WHEN change_pct < -15 THEN 'declining' ELSE 'moderately decreasing' END END AS direction,
               CASE WHEN cv_pct > 30 THEN 'highly volatile' WHEN cv_pct > 15 THEN 'moderately volatile' ELSE 'stable' END AS volatility,
               CASE WHEN abs(change_pct) >= 1 THEN CASE WHEN change_pct > 0 THEN 'increased' ELSE 'decreased' END
                    ELSE 'minimal change' END AS movement,
               CASE WHEN change_pct < -10 THEN 'declining revenue' WHEN change_pct > 15 THEN 'strong growth'
                    WHEN cv_pct > 25 THEN 'high volatility' END AS remark
        FROM f""")
    def summary_trend(spark, sf):
        p = prepare_data(table(spark, sf, "orders"), ["extract_month"], detect_dates=False)
        res = A.aggregate(p.df, ["month"], ["sum(o_totalprice) AS revenue"])
        # money columns are exact to cents; round them there (sum order noise)
        facts = N.trend_facts(res.df, "month", "revenue")
        money = ("first_value", "last_value", "peak_value", "trough_value", "mean")
        return rounded(facts.withColumns({c: F.round(c, 2) for c in money}))

    @reg.add("summary_breakdown_pct", f"""
        WITH a AS ({REGION_SQL}), s AS (SELECT r_name, total_revenue / (SELECT sum(total_revenue) FROM a) * 100 AS share_pct FROM a)
        SELECT row_number() OVER (ORDER BY share_pct DESC, r_name) AS rank, r_name AS label, round(share_pct, 4) AS value,
               r_name || ': ' || {pct_sql('share_pct')} AS text
        FROM s QUALIFY rank <= 10""")
    def summary_breakdown_pct(spark, sf):
        res = region_agg(spark, sf)
        shares = A.share_of_total(res.df, "total_revenue", "share_pct")
        return rounded(N.breakdown(shares, ["r_name"], "share_pct", question="revenue share by region"))

    @reg.add("summary_breakdown_raw", f"""
        WITH a AS ({REGION_SQL})
        SELECT row_number() OVER (ORDER BY avg_o_totalprice DESC, r_name) AS rank, r_name AS label,
               round(avg_o_totalprice, 4) AS value, r_name || ': ' || {fmt_sql('avg_o_totalprice')} AS text
        FROM a QUALIFY rank <= 10""")
    def summary_breakdown_raw(spark, sf):
        res = region_agg(spark, sf)
        return rounded(N.breakdown(res.df, ["r_name"], "avg_o_totalprice"))

    @reg.add("summary_topn", f"""
        WITH a AS ({BRAND_REVENUE_SQL}),
        t AS (SELECT row_number() OVER (ORDER BY revenue DESC, p_brand) AS rank, p_brand AS label, revenue FROM a QUALIFY rank <= 5)
        SELECT rank, label, round(revenue, 4) AS value,
               round(revenue / (SELECT sum(revenue) FROM a) * 100, 4) AS share_pct,
               round((SELECT sum(revenue) FROM t) / (SELECT sum(revenue) FROM a) * 100, 4) AS top_share_pct,
               greatest((SELECT count(*) FROM a) - 5, 0) AS others
        FROM t""")
    def summary_topn(spark, sf):
        res = brand_revenue(spark, sf)
        return rounded(N.topn_facts(res.df, ["p_brand"], "revenue", 5))

    @reg.add("summary_single_row", f"""
        WITH a AS (SELECT sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS count_all,
                          avg(l_discount) AS discount_ratio, max(l_shipdate) AS last_ship, min(l_returnflag) AS first_flag,
                          max(l_tax) AS max_tax
                   FROM lineitem)
        SELECT 'sum_qty=' || {fmt_sql('sum_qty')} || ' | avg_price=' || {fmt_sql('avg_price')}
               || ' | count_all=' || {fmt_sql('count_all')} || ' | discount_ratio=' || {pct_sql('discount_ratio')}
               || ' | last_ship=' || CAST(last_ship AS VARCHAR) || ' | first_flag=' || first_flag AS text
        FROM a""")
    def summary_single_row(spark, sf):
        res = A.aggregate(table(spark, sf, "lineitem"), [], [
            "sum(l_quantity) AS sum_qty", "avg(l_extendedprice) AS avg_price", "count(*)",
            "avg(l_discount) AS discount_ratio", "max(l_shipdate) AS last_ship",
            "min(l_returnflag) AS first_flag", "max(l_tax) AS max_tax"])
        return N.single_row_text(res.df)
