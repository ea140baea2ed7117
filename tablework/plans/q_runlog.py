"""Run-record queries.  ``runs`` and ``steps`` are built
from ``events`` by the fixed rule of FIXTURES.md §4, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.operators import runlog as R
from tablework.operators.ordinal import rank_within_groups
from tablework.plans.common import rounded, table

ACTION = {"view": "inspect_schema", "signup": "prepare_data", "click": "aggregate",
          "purchase": "visualize", "error": "interpret"}
CHARTS = ("line", "bar", "boxplot", "scatter", "heatmap")


def runs_from_events(spark, sf):
    ev = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    return ev.select(F.col("event_id").alias("run_id"), (F.col("event_id") % 8 + 1).alias("task_id"),
                     status.alias("status"),
                     ((status == "success") & (F.col("event_id") % 10 != 0)).alias("success"),
                     F.col("value").alias("duration"))


def steps_from_events(spark, sf, numbered: bool = True):
    """Steps by the FIXTURES rule; ``numbered=False`` skips the step numbers
    (an exact-rank job) for checks that never look at them."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    if numbered:
        ranked = rank_within_groups(ev, ["user_id"], F.struct("ts", "event_id"), "pos")
    else:
        ranked = ev.withColumn("pos", F.lit(None).cast("long"))
    eid = F.col("event_id")
    action = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in ACTION.items()])
    empty = F.array().cast("array<string>")
    group_by = (F.when(eid % 4 == 0, F.array(F.lit("month"))).when(eid % 4 == 1, F.array(F.lit("region")))
                 .when(eid % 4 == 2, F.array(F.lit("category"))).otherwise(empty))
    metrics = (F.when(eid % 3 == 0, F.array(F.lit("avg(fare)"))).when(eid % 3 == 1, F.array(F.lit("sum(tip)")))
                .otherwise(F.array(F.lit("count(*)"))))
    chart = F.element_at(F.array(*[F.lit(c) for c in CHARTS]), (eid % 5 + 1).cast("int"))
    steps = ranked.select(F.col("user_id").alias("run_id"), (F.col("pos") + 1).alias("step_id"),
                          action.alias("action"), group_by.alias("group_by"), metrics.alias("metrics"),
                          chart.alias("chart_type"), (eid % 7).alias("result_count"))
    query = F.when(F.col("action") == "aggregate", F.concat(
        F.lit("SELECT "), F.array_join(F.concat("group_by", "metrics"), ", "), F.lit(" FROM data"),
        F.when(F.size("group_by") > 0, F.concat(F.lit(" GROUP BY "), F.array_join("group_by", ", "))).otherwise(F.lit(""))))
    return steps.withColumns({"query": query, "columns": F.concat("group_by", "metrics")})


RUNS_SQL = """(SELECT event_id AS run_id, event_id % 8 + 1 AS task_id,
                      CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
                      event_type <> 'error' AND event_id % 10 <> 0 AS success, value AS duration FROM events)"""

STEPS_SQL = """(SELECT *, list_concat(group_by, metrics) AS columns,
       CASE WHEN action = 'aggregate' THEN 'SELECT ' || array_to_string(list_concat(group_by, metrics), ', ') || ' FROM data'
            || CASE WHEN len(group_by) > 0 THEN ' GROUP BY ' || array_to_string(group_by, ', ') ELSE '' END END AS query
  FROM (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_id,
         CASE event_type WHEN 'view' THEN 'inspect_schema' WHEN 'signup' THEN 'prepare_data' WHEN 'click' THEN 'aggregate'
              WHEN 'purchase' THEN 'visualize' WHEN 'error' THEN 'interpret' END AS action,
         CASE event_id % 4 WHEN 0 THEN ['month'] WHEN 1 THEN ['region'] WHEN 2 THEN ['category'] ELSE []::VARCHAR[] END AS group_by,
         CASE event_id % 3 WHEN 0 THEN ['avg(fare)'] WHEN 1 THEN ['sum(tip)'] ELSE ['count(*)'] END AS metrics,
         ['line', 'bar', 'boxplot', 'scatter', 'heatmap'][event_id % 5 + 1] AS chart_type,
         event_id % 7 AS result_count
  FROM events))"""


def _has(arr, word):
    return f"len(list_filter({arr}, lambda x: lower(x) LIKE '%{word}%')) > 0"


def _mentions(word):
    return f"({_has('columns', word)} OR coalesce(lower(query) LIKE '%{word}%', false))"


CHECKS_SQL = {
    "chart_created": "action = 'visualize'",
    "monthly_aggregation": f"action = 'aggregate' AND {_has('group_by', 'month')}",
    "regional_analysis": f"action = 'aggregate' AND {_has('group_by', 'region')}",
    "average_calculation": f"action = 'aggregate' AND ({_has('metrics', 'avg')} OR {_has('metrics', 'mean')})",
    "category_analysis": f"action = 'aggregate' AND ({_has('group_by', 'category')} OR {_mentions('category')})",
    "distribution_analysis": "action = 'visualize' AND chart_type = 'bar'",
    "boxplot_visualization": "action = 'visualize' AND chart_type = 'boxplot'",
    "scatter_plot": "action = 'visualize' AND chart_type = 'scatter'",
    "correlation_analysis": "action = 'visualize' AND chart_type IN ('scatter', 'heatmap')",
    "relationship_analysis": "action = 'visualize' AND chart_type IN ('scatter', 'heatmap')",
    "comparison_made": "(action = 'aggregate' AND len(group_by) > 0) OR (action = 'visualize' AND chart_type IN ('bar', 'scatter'))",
    "outlier_detection": "action = 'visualize' AND chart_type = 'boxplot'",
    "aggregation_result": "action = 'aggregate' AND result_count > 0",
    "top_5_ranking": "action = 'aggregate' AND (result_count = 5 OR (coalesce(lower(query) LIKE '%limit%', false) AND coalesce(query LIKE '% 5%', false)))",
    "distance_analysis": _mentions("distance"),
    "fare_analysis": _mentions("fare"),
    "passenger_analysis": _mentions("passenger"),
    "payment_analysis": _mentions("payment"),
    "tip_analysis": _mentions("tip"),
}

RUN_CHECKS_SQL = ("SELECT run_id, " + ", ".join(f"coalesce(bool_or({c}), false) AS {n}" for n, c in CHECKS_SQL.items())
                  + f", false AS trend_analysis FROM {STEPS_SQL} GROUP BY run_id")

TASKS_SQL = " UNION ALL ".join(f"SELECT {t} AS task_id, {list(c)} AS assertions" for t, c in R.TASK_CHECKS.items())


def register(reg):
    @reg.add("run_metrics", f"""
        WITH r AS {RUNS_SQL},
        m AS (SELECT task_id, duration FROM (
                SELECT task_id, duration, row_number() OVER (PARTITION BY task_id ORDER BY duration) - 1 AS pos,
                       count(*) OVER (PARTITION BY task_id) AS n FROM r WHERE duration IS NOT NULL)
              WHERE pos = n // 2)
        SELECT a.task_id, runs, successes, round(mean_duration, 4) AS mean_duration,
               round(m.duration, 4) AS median_duration, round(successes / runs, 4) AS success_rate
        FROM (SELECT task_id, count(*) AS runs, CAST(count_if(success) AS BIGINT) AS successes,
                     avg(duration) AS mean_duration FROM r GROUP BY task_id) a
        LEFT JOIN m ON a.task_id = m.task_id""")
    def run_metrics(spark, sf):
        return rounded(R.run_metrics(runs_from_events(spark, sf), ["task_id"]))

    @reg.add("run_failures", f"""
        SELECT status, count(*) AS failures FROM {RUNS_SQL} WHERE NOT success GROUP BY status""")
    def run_failures(spark, sf):
        return R.failures_by_status(runs_from_events(spark, sf))

    @reg.add("run_best_result", f"""
        SELECT run_id, b.step_id AS step_id, b.priority AS priority FROM (
          SELECT run_id, max({{'priority': prio, 'step_id': step_id}}) AS b FROM (
            SELECT run_id, step_id,
                   CASE WHEN action = 'aggregate' AND len(group_by) > 0 THEN 3 WHEN action = 'aggregate' THEN 2
                        WHEN result_count > 0 THEN 1 ELSE 0 END AS prio
            FROM {STEPS_SQL}) WHERE prio > 0 GROUP BY run_id)""")
    def run_best_result(spark, sf):
        return R.best_result(steps_from_events(spark, sf))

    @reg.add("run_checks", RUN_CHECKS_SQL)
    def run_checks(spark, sf):
        return R.step_checks(steps_from_events(spark, sf, numbered=False))

    @reg.add("run_verdicts", f"""
        WITH c AS ({RUN_CHECKS_SQL}),
        l AS (UNPIVOT c ON COLUMNS(* EXCLUDE (run_id)) INTO NAME "check" VALUE passed),
        t AS ({TASKS_SQL}),
        a AS (SELECT c.run_id, t.task_id, unnest(t.assertions) AS "check" FROM c JOIN t ON t.task_id = c.run_id % 8 + 1)
        SELECT a.run_id, a.task_id, bool_and(coalesce(l.passed, true)) AS all_passed,
               CAST(count_if(coalesce(l.passed, true)) AS BIGINT) AS passed_count, count(*) AS total_count
        FROM a LEFT JOIN l ON a.run_id = l.run_id AND a."check" = l."check"
        GROUP BY a.run_id, a.task_id""")
    def run_verdicts(spark, sf):
        checks = R.step_checks(steps_from_events(spark, sf, numbered=False))
        run_tasks = checks.select("run_id", (F.col("run_id") % 8 + 1).cast("int").alias("task_id"))
        return R.verdicts(run_tasks, checks, R.tasks_table(spark))

    @reg.add("run_missing_artifacts", f"""
        WITH s AS {STEPS_SQL},
        listing AS (SELECT DISTINCT run_id, name FROM (
            SELECT run_id, 'trace.json' AS name FROM s
            UNION ALL SELECT run_id, 'summary.md' FROM s WHERE action = 'interpret'
            UNION ALL SELECT run_id, 'analysis.ipynb' FROM s WHERE action = 'inspect_schema'
            UNION ALL SELECT run_id, 'charts/' || CAST(step_id AS VARCHAR) || '.png' FROM s WHERE action = 'visualize')),
        runs AS (SELECT DISTINCT run_id FROM s),
        need AS (SELECT run_id, unnest(['analysis.ipynb', 'summary.md', 'trace.json']) AS missing FROM runs)
        SELECT run_id, missing FROM need WHERE NOT EXISTS (
            SELECT 1 FROM listing WHERE listing.run_id = need.run_id AND listing.name = need.missing)
        UNION ALL
        SELECT run_id, 'charts/*.png' FROM runs WHERE run_id NOT IN (
            SELECT run_id FROM listing WHERE regexp_matches(name, '^charts/[^/]+\\.png$'))""")
    def run_missing_artifacts(spark, sf):
        steps = steps_from_events(spark, sf)
        names = F.array_compact(F.array(
            F.lit("trace.json"),
            F.when(F.col("action") == "interpret", F.lit("summary.md")),
            F.when(F.col("action") == "inspect_schema", F.lit("analysis.ipynb")),
            F.when(F.col("action") == "visualize", F.concat(F.lit("charts/"), F.col("step_id").cast("string"), F.lit(".png")))))
        listing = steps.select("run_id", F.explode(names).alias("name")).distinct()
        runs = steps.select("run_id").distinct()
        return R.missing_artifacts(runs, listing)
