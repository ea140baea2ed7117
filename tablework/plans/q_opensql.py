"""Open SQL queries: one query per SQL family, run through
``run_sql`` over the driver's tables.  Where the two dialects agree the same
text is the oracle; otherwise the oracle is written in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators.opensql import asof_join, range_join, run_sql
from tablework.plans.common import as_double, rounded, table

SAME = object()

# (name, tables, Spark SQL, oracle SQL | SAME | None)
SQL_QUERIES = [
    ("sql_project_filter", ["orders"], """
        SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS price_up, lower(o_orderstatus) AS status
        FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '1%'""", SAME),
    ("sql_join_inner", ["customer", "nation"], """
        SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", SAME),
    ("sql_join_left", ["customer", "orders"], """
        SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 4) AS spent
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
        GROUP BY c_custkey""", SAME),
    ("sql_join_right", ["customer", "nation"], """
        SELECT n_nationkey, count(c_custkey) AS customers
        FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c RIGHT JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_nationkey""", SAME),
    ("sql_join_full", ["nation", "region"], """
        SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name
        FROM nation FULL OUTER JOIN region ON n_regionkey = r_regionkey + 2""", SAME),
    ("sql_semi", ["customer", "orders", "nation"], """
        SELECT c_custkey FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
          AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""", SAME),
    ("sql_anti", ["customer", "orders"], """
        SELECT c_custkey, c_mktsegment FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""",
     SAME),
    ("sql_join_theta", ["supplier", "region"], """
        SELECT s_suppkey, r_regionkey
        FROM supplier JOIN region
          ON s_acctbal >= r_regionkey * 2000 - 1000 AND s_acctbal < r_regionkey * 2000 + 1500""", SAME),
    ("sql_having", ["lineitem"], """
        SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, round(sum(l_quantity), 4) AS qty
        FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15000 AND count(*) > 10""", SAME),
    ("sql_rollup", ["lineitem"], """
        SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INT) AS g,
               count(*) AS n, round(sum(l_extendedprice), 4) AS total
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""", SAME),
    ("sql_cube", ["lineitem"], """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS avg_disc
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""", SAME),
    ("sql_grouping_sets", ["orders"], """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 4) AS top
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""", SAME),
    ("sql_window_filter", ["orders"], """
        SELECT o_custkey, o_orderkey, rn FROM (
          SELECT o_custkey, o_orderkey,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
          FROM orders) t
        WHERE rn <= 2""", SAME),
    ("sql_limit_offset", ["orders"], """
        SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""", SAME),
    ("sql_union", ["customer", "supplier", "nation"], """
        SELECT c_nationkey AS nationkey, 'c' AS kind FROM customer WHERE c_acctbal > 9500
        UNION ALL SELECT s_nationkey, 's' FROM supplier WHERE s_acctbal > 9000
        UNION SELECT n_nationkey, 'n' FROM nation WHERE n_regionkey = 0""", SAME),
    ("sql_intersect", ["customer", "supplier"], """
        SELECT c_nationkey AS nationkey FROM customer WHERE c_mktsegment = 'BUILDING'
        INTERSECT ALL SELECT s_nationkey FROM supplier""", SAME),
    ("sql_except", ["customer", "supplier"], """
        SELECT c_nationkey AS nationkey FROM customer
        EXCEPT ALL SELECT s_nationkey FROM supplier""", SAME),
    ("sql_cte", ["orders", "customer"], """
        WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
             seg AS (SELECT c_mktsegment, avg(spent) AS avg_spent, count(*) AS n
                     FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
        SELECT c_mktsegment, round(avg_spent, 4) AS avg_spent, n FROM seg""", SAME),
    ("sql_subquery", ["customer"], """
        SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above_all
        FROM customer c
        WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)""", SAME),
    ("sql_strings", ["part"], """
        SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, substring(p_name, 2, 4) AS sub,
               trim(concat('  ', p_type, '  ')) AS trimmed, replace(p_brand, 'Brand#', 'B') AS rep,
               concat(p_type, '/', CAST(p_size AS STRING)) AS cat, split_part(p_name, ' ', 2) AS word2,
               regexp_replace(p_name, '[aeiou]', '*') AS masked
        FROM part""", """
        SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, substring(p_name, 2, 4) AS sub,
               trim(concat('  ', p_type, '  ')) AS trimmed, replace(p_brand, 'Brand#', 'B') AS rep,
               concat(p_type, '/', CAST(p_size AS VARCHAR)) AS cat, split_part(p_name, ' ', 2) AS word2,
               regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked
        FROM part"""),
    ("sql_dates", ["orders"], """
        SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS month_start,
               CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(DAYOFWEEK FROM o_orderdate) AS INT) AS dow,
               datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS age_days,
               CAST(date_add(CAST(o_orderdate AS DATE), 30) AS TIMESTAMP_NTZ) AS due
        FROM orders""", """
        SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start,
               CAST(year(o_orderdate) AS INT) AS y, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow,
               CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS age_days,
               CAST(CAST(o_orderdate AS DATE) + 30 AS TIMESTAMP) AS due
        FROM orders"""),
    ("sql_math", ["lineitem"], """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS r1, CAST(floor(l_extendedprice / 7) AS BIGINT) AS fl,
               CAST(ceil(l_quantity / 3) AS BIGINT) AS ce, round(abs(l_discount - 0.05), 4) AS ab,
               round(ln(l_extendedprice), 4) AS lnp, round(power(l_quantity, 2), 4) AS sq,
               l_orderkey % 7 AS m7, CAST(pmod(l_linenumber - 4, 3) AS BIGINT) AS pm
        FROM lineitem""", """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS r1, CAST(floor(l_extendedprice / 7) AS BIGINT) AS fl,
               CAST(ceil(l_quantity / 3) AS BIGINT) AS ce, round(abs(l_discount - 0.05), 4) AS ab,
               round(ln(l_extendedprice), 4) AS lnp, round(power(l_quantity, 2), 4) AS sq,
               l_orderkey % 7 AS m7, CAST(((l_linenumber - 4) % 3 + 3) % 3 AS BIGINT) AS pm
        FROM lineitem"""),
    ("sql_conditional", ["orders"], """
        SELECT o_orderkey,
               CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
               CAST(o_totalprice AS BIGINT) AS whole,
               try_cast(substring(o_orderpriority, 1, 1) AS INT) AS prio,
               CAST(try_cast(o_orderstatus AS INT) AS DOUBLE) AS not_a_number
        FROM orders""", """
        SELECT o_orderkey,
               CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
               CAST(trunc(o_totalprice) AS BIGINT) AS whole,
               try_cast(substring(o_orderpriority, 1, 1) AS INT) AS prio,
               CAST(try_cast(o_orderstatus AS INT) AS DOUBLE) AS not_a_number
        FROM orders"""),
    ("sql_arrays", ["embeddings"], """
        SELECT vec_id, size(embedding) AS dims,
               size(filter(embedding, x -> x > 0)) AS positives,
               round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), CAST(0 AS DOUBLE),
                               (acc, x) -> acc + x), 4) AS sq_norm,
               round(CAST(embedding[0] AS DOUBLE), 4) AS first
        FROM embeddings""", """
        SELECT vec_id, len(embedding) AS dims,
               len(list_filter(embedding, lambda x: x > 0)) AS positives,
               round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))),
                                 lambda acc, x: acc + x), 4) AS sq_norm,
               round(CAST(embedding[1] AS DOUBLE), 4) AS first
        FROM embeddings"""),
    ("sql_explode", ["embeddings"], """
        SELECT label, count(*) AS n, round(avg(x), 4) AS mean_x
        FROM embeddings LATERAL VIEW explode(transform(embedding, v -> CAST(v AS DOUBLE))) t AS x
        GROUP BY label""", """
        SELECT label, count(*) AS n, round(avg(x), 4) AS mean_x
        FROM (SELECT label, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings)
        GROUP BY label"""),
    ("sql_json", ["events"], """
        SELECT CAST(get_json_object(props, '$.k') AS INT) % 10 AS k10,
               count(*) AS n, sum(from_json(props, 'k INT').k) AS k_sum
        FROM events GROUP BY 1""", """
        SELECT CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k10,
               count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k_sum
        FROM events GROUP BY 1"""),
    ("sql_maps", ["events"], """
        SELECT event_id, m['type'] AS t, s.value AS v, array_join(map_keys(m), ',') AS ks FROM (
          SELECT event_id,
                 map_from_entries(array(struct('type' AS k, event_type AS v), struct('user' AS k, CAST(user_id AS STRING) AS v))) AS m,
                 struct(event_id, value) AS s
          FROM events)""", """
        SELECT event_id, event_type AS t, value AS v, 'type,user' AS ks FROM events"""),
    ("sql_pivot", ["lineitem"], """
        SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
        PIVOT (round(sum(l_quantity), 4) FOR l_linestatus IN ('O' AS open_qty, 'F' AS filled_qty))""", """
        SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS open_qty,
               round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS filled_qty
        FROM lineitem GROUP BY l_returnflag"""),
    ("sql_unpivot", ["customer"], """
        SELECT c_custkey, metric, round(val, 4) AS val FROM (
          SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer)
        UNPIVOT (val FOR metric IN (c_acctbal, nation))""", """
        SELECT c_custkey, metric, round(val, 4) AS val FROM (
          UNPIVOT (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer)
          ON c_acctbal, nation INTO NAME metric VALUE val)"""),
    ("sql_approx_distinct", ["lineitem"], """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS exact_parts,
               abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near
        FROM lineitem GROUP BY l_returnflag""", """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS exact_parts, true AS near FROM lineitem GROUP BY l_returnflag"""),
]


def _make(tables, sql):
    def run(spark, sf):
        return run_sql(spark, sql, {t: table(spark, sf, t) for t in tables}).df
    return run


def register(reg):
    for name, tables, sql, oracle in SQL_QUERIES:
        reg.add(name, (sql if oracle is SAME else oracle))(_make(tables, sql))

    @reg.add("sql_sample", """
        SELECT l_returnflag, count(*) AS all_rows, true AS near FROM lineitem GROUP BY l_returnflag""")
    def sql_sample(spark, sf):
        """Bernoulli sample with a fixed seed (the sample is the feature): its
        size per flag lies within five standard deviations of a tenth."""
        items = table(spark, sf, "lineitem").select("l_returnflag")
        taken = items.sample(fraction=0.1, seed=42).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("taken"))
        whole = items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("all_rows")).join(taken, "l_returnflag", "left")
        away = F.abs(F.coalesce("taken", F.lit(0)) - 0.1 * F.col("all_rows"))
        return whole.select("l_returnflag", "all_rows", (away <= 5 * F.sqrt(0.09 * F.col("all_rows"))).alias("near"))

    @reg.add("asof_join", """
        WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
             v AS (SELECT event_id AS view_id, user_id, ts AS vts, value FROM events WHERE event_type = 'view')
        SELECT p.event_id, v.vts AS asof_ts, CAST(v.view_id AS DOUBLE) AS asof_event_id, round(v.value, 4) AS asof_value
        FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.vts""")
    def asof_join_q(spark, sf):
        ev = table(spark, sf, "events")
        p = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
        v = ev.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
        out = asof_join(p, v, ["user_id"], "ts", ["event_id", "value"])
        return rounded(as_double(out.select("event_id", "asof_ts", "asof_event_id", "asof_value"), "asof_event_id"))

    @reg.add("sql_join_range", """
        WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
             bands AS (SELECT b, lo + b * (hi - lo) / 10 AS b_lo, lo + (b + 1) * (hi - lo) / 10 AS b_hi
                       FROM s, range(10) t(b))
        SELECT b AS band, count(*) AS parts, round(avg(p_retailprice), 4) AS avg_price
        FROM part JOIN bands ON p_retailprice >= b_lo AND p_retailprice <= b_hi AND (p_retailprice < b_hi OR b = 9)
        GROUP BY b""")
    def sql_join_range(spark, sf):
        part = table(spark, sf, "part")
        lo, hi = part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
        step = (hi - lo) / 10
        # ten equal-width price bands over the observed range (one small aggregate)
        bands = spark.createDataFrame([(b, lo + b * (hi - lo) / 10, lo + (b + 1) * (hi - lo) / 10) for b in range(10)],
                                      "band long, b_lo double, b_hi double")
        j = range_join(part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "b_lo", "b_hi")
        j = j.where((F.col("p_retailprice") < F.col("b_hi")) | (F.col("band") == 9))
        return rounded(j.groupBy("band").agg(F.count(F.lit(1)).alias("parts"),
                                             F.avg("p_retailprice").alias("avg_price")))
