"""Analytics over run records: metrics, failures, best result, checks,
verdicts and artifact completeness.

Inputs are flat tables — ``runs(run_id, task_id, status, success, duration)``
and ``steps(run_id, step_id, action, group_by array, metrics array,
chart_type, result_count, query, columns array)`` — so every per-run check
is a ``bool_or`` in one grouped aggregate (partial per task, skew-safe)
instead of an array collected per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.ordinal import rank_within_groups, with_row_index

# The check names a task can ask for, and the eight tasks with
# the checks each one asks for (task id → checks), in task order.
TASK_CHECKS = {
    1: ("chart_created", "monthly_aggregation", "trend_analysis"),
    2: ("chart_created", "regional_analysis", "average_calculation"),
    3: ("aggregation_result", "top_5_ranking", "category_analysis"),
    4: ("average_calculation", "distance_analysis", "fare_analysis"),
    5: ("chart_created", "distribution_analysis", "passenger_analysis"),
    6: ("chart_created", "outlier_detection", "boxplot_visualization"),
    7: ("payment_analysis", "tip_analysis", "comparison_made"),
    8: ("correlation_analysis", "relationship_analysis", "scatter_plot"),
}
# Artifacts every run directory must hold.
REQUIRED_ARTIFACTS = ("analysis.ipynb", "summary.md", "trace.json")
# Words looked for in a step's columns or query text.
MENTION_WORDS = ("distance", "fare", "passenger", "payment", "tip")


def run_metrics(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs, successes, success rate, upper median (``sorted[n // 2]``) and
    mean of ``duration`` per group.  The median row is found by exact
    positions (range-sorted, no per-group collection)."""
    by = by or []
    base = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("success")).alias("successes"),
        F.avg("duration").alias("mean_duration"))
    valid = runs.where(F.col("duration").isNotNull())
    if by:
        ranked = rank_within_groups(valid, by, F.col("duration"), "pos")
        med = ranked.where(F.col("pos") == F.floor(F.col("group_rows") / 2)).select(
            *by, F.col("duration").alias("median_duration"))
        med = med.toDF(*[f"__{c}" for c in by], "median_duration")
        same = [base[c].eqNullSafe(med[f"__{c}"]) for c in by]
        out = base.join(med, on=same, how="left").drop(*[f"__{c}" for c in by])
    else:
        idx = with_row_index(valid.select("duration"), [F.col("duration").asc()], "pos")
        n = valid.agg(F.count(F.lit(1))).scalar()
        med_value = idx.where(F.col("pos") == F.floor(n / 2)).agg(F.max("duration")).scalar()
        out = base.select("*", med_value.alias("median_duration"))
    return out.withColumn("success_rate", F.col("successes") / F.col("runs"))


def failures_by_status(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("success")).groupBy("status").agg(F.count(F.lit(1)).alias("failures"))


def _has(arr: str, word: str) -> Column:
    return F.exists(F.col(arr), lambda x: F.lower(x).contains(word))


def _mentions(word: str) -> Column:
    return _has("columns", word) | F.coalesce(F.lower(F.col("query")).contains(word), F.lit(False))


def best_result(steps: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Per run, the step whose result feeds the summary: for a percent or
    share question the last step with a percent column, else the last
    grouped aggregate, else the last aggregate, else the last step with rows.
    ``questions`` holds ``run_id, question``."""
    is_agg = F.col("action") == "aggregate"
    prio = (F.when(is_agg & (F.size("group_by") > 0), 3)
             .when(is_agg, 2)
             .when(F.col("result_count") > 0, 1)
             .otherwise(0))
    if questions is not None:
        steps = steps.join(questions.select("run_id", "question"), "run_id", "left")
        pct_question = F.lower(F.coalesce(F.col("question"), F.lit(""))).rlike("percentage|percent|share")
        pct_column = F.exists(F.col("columns"), lambda c: F.lower(c).contains("percent"))
        prio = F.when(pct_question & pct_column, 4).otherwise(prio)
    best = (steps.where(prio > 0)
                 .groupBy("run_id").agg(F.max(F.struct(prio.alias("priority"), F.col("step_id"))).alias("b")))
    return best.select("run_id", F.col("b.step_id").alias("step_id"), F.col("b.priority").alias("priority"))


def step_checks(steps: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per run, one boolean per check (``bool_or`` over the run's
    steps; ``summaries(run_id, summary, status)`` adds the text checks)."""
    agg = F.col("action") == "aggregate"
    viz = F.col("action") == "visualize"
    chart = F.lower(F.col("chart_type"))
    conds = {
        "chart_created": viz,
        "monthly_aggregation": agg & _has("group_by", "month"),
        "regional_analysis": agg & _has("group_by", "region"),
        "average_calculation": agg & (_has("metrics", "avg") | _has("metrics", "mean")),
        "category_analysis": agg & (_has("group_by", "category") | _mentions("category")),
        "distribution_analysis": viz & (chart == "bar"),
        "boxplot_visualization": viz & (chart == "boxplot"),
        "scatter_plot": viz & (chart == "scatter"),
        "correlation_analysis": viz & chart.isin("scatter", "heatmap"),
        "relationship_analysis": viz & chart.isin("scatter", "heatmap"),
        "comparison_made": (agg & (F.size("group_by") > 0)) | (viz & chart.isin("bar", "scatter")),
        "outlier_detection": viz & (chart == "boxplot"),
        "aggregation_result": agg & (F.col("result_count") > 0),
        "top_5_ranking": agg & ((F.col("result_count") == 5) |
                                (F.lower(F.col("query")).contains("limit") & F.col("query").contains(" 5"))),
    }
    for w in MENTION_WORDS:
        conds[f"{w}_analysis"] = _mentions(w)
    out = steps.groupBy("run_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conds.items()])
    if summaries is None:
        return out.withColumn("trend_analysis", F.lit(False))
    s = summaries.select("run_id", F.lower("summary").alias("s"), "status")
    out = out.join(s, "run_id", "left")
    text_words = {"trend_analysis": "trend", "correlation_analysis": "correlation",
                  "relationship_analysis": "relationship"}
    for w in MENTION_WORDS:
        text_words[f"{w}_analysis"] = w
    fixes = {}
    for name, word in text_words.items():
        has = F.coalesce(F.col("s").contains(word), F.lit(False))
        if name == "trend_analysis":
            fixes[name] = has & (F.col("status") == "success")
        else:
            fixes[name] = F.col(name) | has
    return out.withColumns(fixes).drop("s", "status")


def checks_long(checks: DataFrame) -> DataFrame:
    names = [c for c in checks.columns if c != "run_id"]
    args = ", ".join(f"'{n}', `{n}`" for n in names)
    return checks.selectExpr("run_id", f"stack({len(names)}, {args}) AS (check, passed)")


def tasks_table(spark) -> DataFrame:
    rows = [(t, list(c)) for t, c in TASK_CHECKS.items()]
    return spark.createDataFrame(rows, "task_id int, assertions array<string>")


def verdicts(run_tasks: DataFrame, checks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per run: every asked check true (a check we do not know passes)."""
    asked = (run_tasks.join(tasks, "task_id")
                      .select("run_id", "task_id", F.explode("assertions").alias("check")))
    joined = asked.join(checks_long(checks), ["run_id", "check"], "left") \
                  .withColumn("ok", F.coalesce(F.col("passed"), F.lit(True)))
    return joined.groupBy("run_id", "task_id").agg(
        F.bool_and("ok").alias("all_passed"),
        F.count_if("ok").alias("passed_count"),
        F.count(F.lit(1)).alias("total_count"))


def missing_artifacts(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """``run_id, missing`` rows: each required file absent from the run's
    listing, and ``charts/*.png`` when the run has no chart.  ``listing``
    holds ``run_id, name`` (names relative to the run directory)."""
    need = runs.select("run_id", F.explode(F.array(*[F.lit(n) for n in REQUIRED_ARTIFACTS])).alias("missing"))
    absent = need.join(listing.select("run_id", F.col("name").alias("missing")), ["run_id", "missing"], "left_anti")
    charts = listing.where(F.col("name").rlike(r"^charts/[^/]+\.png$")).select("run_id").distinct()
    no_chart = runs.select("run_id").join(charts, "run_id", "left_anti").withColumn("missing", F.lit("charts/*.png"))
    return absent.unionByName(no_chart)


def list_run_artifacts(spark, runs_dir: str) -> DataFrame:
    """Listing of ``<runs_dir>/<run_id>/...`` from file metadata only
    (``binaryFile`` with the content column pruned)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(runs_dir)
               .select("path", "length", "modificationTime"))
    base = runs_dir.rstrip("/")
    rel = F.regexp_extract(F.col("path"), r"^.*?" + base.split(":")[-1].replace(".", r"\.") + r"/(.*)$", 1)
    return df.select(F.regexp_extract(rel, r"^([^/]+)/", 1).alias("run_id"),
                     F.regexp_extract(rel, r"^[^/]+/(.*)$", 1).alias("name"), "length")


# A summary shorter than this (after trimming) is flagged.
SHORT_SUMMARY_CHARS = 50


def artifact_facts(spark, runs_dir: str) -> DataFrame:
    """One row per run directory: which artifacts exist, chart count, and
    the trimmed length of ``summary.md`` (the only file whose content is
    read; summaries are small)."""
    listing = list_run_artifacts(spark, runs_dir)
    facts = listing.groupBy("run_id").agg(
        *[F.bool_or((F.col("name") == n) & (F.col("length") >= 0)).alias(f"has_{n.split('.')[0]}")
          for n in REQUIRED_ARTIFACTS],
        *[F.bool_or((F.col("name") == n) & (F.col("length") > 0)).alias(f"filled_{n.split('.')[0]}")
          for n in REQUIRED_ARTIFACTS],
        F.count_if(F.col("name").rlike(r"^charts/[^/]+\.png$")).alias("charts"))
    summaries = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                      .option("pathGlobFilter", "summary.md").load(runs_dir)
                      .select(F.regexp_extract("path", r"([^/]+)/summary\.md$", 1).alias("run_id"),
                              F.length(F.trim(F.decode("content", "UTF-8"))).alias("summary_chars")))
    return facts.join(summaries, "run_id", "left")


def postflight(facts: DataFrame) -> DataFrame:
    """Findings ``run_id, severity, message`` per run: missing required
    files and charts are errors, a short summary is a warning."""
    checks = [(F.col(f"has_{n.split('.')[0]}") == F.lit(False), "error", f"The run left no {n}")
              for n in REQUIRED_ARTIFACTS]
    checks.append((F.col("charts") == 0, "error", "The run left no chart"))
    checks.append((F.col("summary_chars") < SHORT_SUMMARY_CHARS, "warning", f"The summary has under {SHORT_SUMMARY_CHARS} characters"))
    rows = F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message")))
        for c, sev, msg in checks]))
    return facts.select("run_id", F.explode(rows).alias("f")).select("run_id", "f.severity", "f.message")


def criteria_met(criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """``run_id, criterion, met`` for each stated success criterion:
    chart saved → a chart exists; summary / notebook → the file exists and is
    not empty; anything else passes."""
    c = F.lower(F.col("criterion"))
    met = (F.when(c.contains("chart saved"), F.col("charts") > 0)
             .when(c.contains("summary"), F.coalesce(F.col("filled_summary"), F.lit(False)))
             .when(c.contains("notebook"), F.coalesce(F.col("filled_analysis"), F.lit(False)))
             .otherwise(F.lit(True)))
    return criteria.join(facts, "run_id", "left").select(
        "run_id", "criterion", F.coalesce(met, F.lit(False)).alias("met"))
