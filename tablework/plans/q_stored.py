"""Stored tables, catalogues and whole-table reports (SURVEY S7, S8, S10, S14, S15,
R10, P2, P6, X25, Q4, Q9, N1, N3, N8, N13, V10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators import aggregate as A
from tablework.operators import facts as N
from tablework.operators import profile as P
from tablework.operators import quality as Q
from tablework.operators import series as V
from tablework.operators.prepare import prepare_data
from tablework.operators.sketches import distinct_sketches, merged_distinct
from tablework.plans.common import rounded, table
from tablework.session import shared_path
from tablework.sources import files as S
from tablework.sources import ledger

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# lineitem whole, with a column that is mostly null, a constant one and a text named like a date
FINDINGS_FRAME = """(SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS mostly, CAST(1000000000.1 AS DOUBLE) AS one,
    CASE WHEN l_orderkey % 50 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS ship_date_text FROM lineitem)"""
NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "mostly", "one")
ALL = (*NUMBERS[:8], "l_returnflag", "l_linestatus", "l_shipdate", "mostly", "one", "ship_date_text")


def _findings_sql() -> str:
    parts = [f"SELECT 'high_missing' AS \"check\", '{c}' AS \"column\", count_if({c} IS NULL) / count(*) AS value FROM f HAVING value > 0.8" for c in ALL]
    parts += [f"SELECT 'constant', '{c}', CAST(min({c}) AS DOUBLE) FROM f HAVING min({c}) = max({c})" for c in NUMBERS]
    parts += ["SELECT 'date_parse', 'ship_date_text', CAST(count_if(try_strptime(ship_date_text, '%Y-%m-%d') IS NULL) AS DOUBLE) AS v FROM f HAVING v > 0"]
    for c in NUMBERS:
        parts.append(f"""SELECT 'outliers', '{c}', CAST(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS v
            FROM f, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM f) WHERE q3 > q1 HAVING v > 0""")
    return f"WITH f AS MATERIALIZED {FINDINGS_FRAME}, x AS (" + " UNION ALL ".join(parts) + ") SELECT \"check\", \"column\", 'warning' AS severity, round(value, 4) AS value FROM x"


def _findings_frame(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.withColumns({"mostly": F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax")), "one": F.lit(1000000000.1),
                          "ship_date_text": F.when(F.col("l_orderkey") % 50 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))})


def register(reg):
    @reg.add("prepared_sink", """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 4) AS total
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
    def prepared_sink(spark, sf):
        run = shared_path(spark, "runs")
        prep = prepare_data(table(spark, sf, "orders"), ["filter: o_orderstatus == 'F'", "extract_month"])
        S.save_prepared(prep.df, run)
        back = S.read_prepared(spark, run)
        return rounded(back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))

    @reg.add("result_versions", """
        SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
    def result_versions(spark, sf):
        """A result that is saved again: the newest commit counts, staged data does not."""
        root, query = shared_path(spark, "results"), "rows and mean quantity by return flag"
        items = table(spark, sf, "lineitem")
        whole = A.aggregate(items, ["l_returnflag"], ["count(*) AS n", "avg(l_quantity) AS mean"]).df
        S.save_result(whole.limit(0), query, root)
        S.save_result(rounded(whole), query, root)
        ledger.stage(whole.limit(1), f"{root}/frames/{S.result_name(query)}")
        return S.read_result(spark, query, root)

    @reg.add("trace_append", """
        SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INT) AS step_id, role AS action, CAST(length(text) AS DOUBLE) AS result_count FROM conversations""")
    def trace_append(spark, sf):
        """Runs appended, half of them a second time: every step is there once."""
        steps = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(F.collect_list(F.struct(
            F.col("turn").cast("int").alias("step_id"), F.col("role").alias("action"),
            F.struct(F.length("text").cast("long").alias("rows")).alias("result"))).alias("steps"))
        runs, path = steps.withColumn("status", F.lit("success")), shared_path(spark, "traces")
        S.append_trace(runs, path)
        S.append_trace(runs.where(F.col("run_id").cast("long") % 2 == 0), path)
        told = S.steps_of_traces(S.read_traces(spark, path))
        return told.select("run_id", "step_id", "action", F.col("result_count").cast("double").alias("result_count"))

    @reg.add("task_list", """
        SELECT conv_id * 1000 + turn AS id, 'sales' AS dataset_id, text AS question, CAST(turn % 3 AS INT) AS asked FROM conversations WHERE role = 'user'""")
    def task_list(spark, sf):
        path = shared_path(spark, "tasks")
        turns = table(spark, sf, "conversations").where("role = 'user'")
        names = F.array(F.lit("chart_created"), F.lit("trend_analysis"))
        turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("sales").alias("dataset_id"), F.col("text").alias("question"),
                     F.slice(names, 1, (F.col("turn") % 3).cast("int")).alias("assertions")).write.json(path)
        return S.read_tasks(spark, path).select("id", "dataset_id", "question", F.size("assertions").alias("asked"))

    @reg.add("dataset_columns", f"""
        SELECT table_name AS dataset_id, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns
        FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)}) GROUP BY 1""")
    def dataset_columns(spark, sf):
        return S.dataset_catalog(spark, sf).select("dataset_id", F.concat_ws(",", "columns").alias("columns"))

    @reg.add("sampled_schema", """
        SELECT CAST(ordinal_position - 1 AS INT) AS ordinal, column_name AS "column", true AS bounded,
               CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'text' ELSE 'date' END AS type
        FROM information_schema.columns WHERE table_name = 'orders'""")
    def sampled_schema(spark, sf):
        path = shared_path(spark, "sampled.csv")
        table(spark, sf, "orders").repartition(5).write.option("header", True).csv(path)
        return S.sampled_schema(spark, path, 1000).select("ordinal", "column", "type", (F.col("rows_read") <= 1000).alias("bounded"))

    @reg.add("sketch_distinct", """
        SELECT l_returnflag, count(l_partkey) AS rows, count(DISTINCT l_partkey) AS exact_parts, true AS near FROM lineitem GROUP BY l_returnflag""")
    def sketch_distinct(spark, sf):
        """Parts per return flag from sketches stored per flag and month."""
        items = table(spark, sf, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey")
        stored = distinct_sketches(items, ["l_returnflag", "month"], "l_partkey")
        exact = items.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact_parts"))
        both = merged_distinct(stored, ["l_returnflag"]).join(exact, "l_returnflag")
        return both.select("l_returnflag", "rows", "exact_parts", (F.abs(F.col("approx_distinct") - F.col("exact_parts")) <= 0.03 * F.col("exact_parts")).alias("near"))

    @reg.add("frame_preview", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem LIMIT 3")
    def frame_preview(spark, sf):
        return P.frame_preview(table(spark, sf, "lineitem"))

    @reg.add("heat_values", "SELECT c_acctbal FROM customer LIMIT 10")
    def heat_values(spark, sf):
        return V.heat_values(table(spark, sf, "customer").select("c_name", "c_acctbal", "c_mktsegment"))

    @reg.add("dq_findings", _findings_sql())
    def dq_findings(spark, sf):
        findings, _ = Q.preflight(_findings_frame(spark, sf))
        return rounded(findings.select("check", "column", "severity", "value"))

    @reg.add("dq_findings_metrics", f"""
        SELECT count(*) AS row_count, {len(ALL)} AS column_count, {len(NUMBERS)} AS numeric_columns, 1 AS high_missing_columns, true AS valid FROM lineitem""")
    def dq_findings_metrics(spark, sf):
        return Q.preflight(_findings_frame(spark, sf))[1]

    @reg.add("dq_empty", "SELECT 'empty' AS \"check\", 'error' AS severity, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_totalprice < 0")
    def dq_empty(spark, sf):
        return Q.preflight(table(spark, sf, "orders").where("o_totalprice < 0"))[0].select("check", "severity", "value")

    @reg.add("summary_share", """
        WITH a AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1)
        SELECT CAST(row_number() OVER (ORDER BY v DESC, o_orderpriority) AS INT) AS rank, o_orderpriority AS label, round(v, 2) AS value,
               round(v / sum(v) OVER () * 100, 4) AS share_pct, round(sum(v) OVER (), 2) AS total FROM a""")
    def summary_share(spark, sf):
        res = A.aggregate(table(spark, sf, "orders"), ["o_orderpriority"], ["sum(o_totalprice) AS total_revenue"])
        case, facts = N.summary_facts(res.df, res.metadata, "share of revenue by priority")
        if case != "share_of_total":
            raise AssertionError(case)
        return facts.select("rank", "label", F.round("value", 2).alias("value"), F.round("share_pct", 4).alias("share_pct"), F.round("total", 2).alias("total"))

    for name, sql, frame in (
            ("summary_empty", "SELECT 'No rows returned.' AS text FROM orders WHERE o_totalprice < 0 HAVING count(*) = 0",
             lambda spark, sf: (table(spark, sf, "orders").where("o_totalprice < 0"), {})),
            ("summary_groups_only", "SELECT 'o_orderstatus' AS group_by, count(DISTINCT o_orderstatus) AS groups FROM orders",
             lambda spark, sf: (A.aggregate(table(spark, sf, "orders"), ["o_orderstatus"], ["min(o_orderpriority)"]).df, {"is_aggregate": True, "group_by": ["o_orderstatus"]})),
            ("summary_shape", "SELECT count(*) AS rows, 2 AS columns FROM customer",
             lambda spark, sf: (table(spark, sf, "customer").select("c_name", "c_mktsegment"), {}))):
        reg.add(name, sql)(lambda spark, sf, frame=frame: N.summary_facts(*frame(spark, sf))[1])
