"""Chart series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators import series as V
from tablework.operators.prepare import prepare_data
from tablework.plans.common import rounded, table
from tablework.plans.q_aggregate import LINEITEM_N, lineitem_nulls

CORR_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "one")


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 4) END AS corr "
                         f"FROM (SELECT *, CAST(1.0 AS DOUBLE) AS one FROM {LINEITEM_N})")
    return " UNION ALL ".join(parts)


def _box_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(f"""
          SELECT '{c}' AS "column", q[1] AS q1, q[2] AS median, q[3] AS q3,
                 (SELECT min({c}) FROM {tbl} WHERE {c} >= q[1] - 1.5 * (q[3] - q[1])) AS lower_whisker,
                 (SELECT max({c}) FROM {tbl} WHERE {c} <= q[3] + 1.5 * (q[3] - q[1])) AS upper_whisker,
                 (SELECT count(*) FROM {tbl} WHERE {c} < q[1] - 1.5 * (q[3] - q[1]) OR {c} > q[3] + 1.5 * (q[3] - q[1])) AS outliers
          FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM {tbl})""")
    inner = " UNION ALL ".join(parts)
    return (f"SELECT \"column\", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
            f"round(lower_whisker, 4) AS lower_whisker, round(upper_whisker, 4) AS upper_whisker, outliers FROM ({inner})")


LINEITEM_NUM8 = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                 "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def register(reg):
    @reg.add("chart_line", """
        SELECT strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m') AS month, round(sum(o_totalprice), 4) AS o_totalprice
        FROM orders GROUP BY 1""")
    def chart_line(spark, sf):
        p = prepare_data(table(spark, sf, "orders").select("o_orderdate", "o_totalprice"),
                         ["extract_month"], detect_dates=False)
        return rounded(V.line_series(p.df, "month", "o_totalprice"))

    @reg.add("chart_line_index", """
        SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS "index", round(value, 4) AS value FROM events""")
    def chart_line_index(spark, sf):
        df = table(spark, sf, "events").select("ts", "event_id", "value")
        return rounded(V.line_index_series(df, ["ts", "event_id"], "value"))

    @reg.add("chart_bar", """
        SELECT p_type, round(sum(l_extendedprice), 4) AS l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL
        GROUP BY p_type ORDER BY sum(l_extendedprice) DESC, p_type LIMIT 5""")
    def chart_bar(spark, sf):
        li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
        j = li.join(part, li.l_partkey == part.p_partkey).select("p_type", "l_extendedprice")
        return rounded(V.bar_series(j, "p_type", "l_extendedprice", 5))

    @reg.add("chart_bar_auto", """
        SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS c_custkey FROM customer
        WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment ORDER BY sum(c_custkey) DESC, c_mktsegment LIMIT 30""")
    def chart_bar_auto(spark, sf):
        return rounded(V.bar_auto_series(table(spark, sf, "customer")))

    @reg.add("chart_box", _box_sql("events", ("value",)))
    def chart_box(spark, sf):
        return rounded(V.box_stats(table(spark, sf, "events"), ["value"]))

    @reg.add("chart_box_all", _box_sql(LINEITEM_N, LINEITEM_NUM8))
    def chart_box_all(spark, sf):
        return rounded(V.box_stats(lineitem_nulls(spark, sf)))

    @reg.add("chart_scatter", f"""
        SELECT l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM {LINEITEM_N}
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
    def chart_scatter(spark, sf):
        return rounded(V.scatter_series(lineitem_nulls(spark, sf), "l_quantity", "l_extendedprice"))

    @reg.add("chart_scatter_auto", """
        SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL""")
    def chart_scatter_auto(spark, sf):
        return rounded(V.scatter_auto_series(table(spark, sf, "lineitem")))

    @reg.add("chart_corr", _corr_sql())
    def chart_corr(spark, sf):
        df = lineitem_nulls(spark, sf).withColumn("one", F.lit(1e9 + 0.1))
        return rounded(V.corr_matrix(df))
