import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablework.operators import runlog as R
from tablework.sources import files as S
from tablework.sources.scan import DatasetNotFound, UnsupportedSource, dataset_exists, load_dataset, resolve_dataset


def test_verdict_unknown_check_passes(spark):
    checks = spark.createDataFrame([(1, True, False)], "run_id long, chart_created boolean, monthly_aggregation boolean")
    tasks = spark.createDataFrame([(1, ["chart_created", "monthly_aggregation", "made_up_check"])],
                                  "task_id int, assertions array<string>")
    run_tasks = spark.createDataFrame([(1, 1)], "run_id long, task_id int")
    v = R.verdicts(run_tasks, checks, tasks).first()
    assert (v["all_passed"], v["passed_count"], v["total_count"]) == (False, 2, 3)


def test_missing_artifacts(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    listing = spark.createDataFrame([(1, "trace.json"), (1, "summary.md"), (1, "analysis.ipynb"), (1, "charts/a.png"),
                                     (2, "trace.json")], "run_id long, name string")
    got = sorted((r["run_id"], r["missing"]) for r in R.missing_artifacts(runs, listing).collect())
    assert got == [(2, "analysis.ipynb"), (2, "charts/*.png"), (2, "summary.md")]


def test_run_metrics_upper_median(spark):
    runs = spark.createDataFrame([(i, 1 if i < 4 else 2, "success", i % 2 == 0, float(d))
                                  for i, d in enumerate([4, 1, 3, 2, 7, 5, 6])],
                                 "run_id long, task_id int, status string, success boolean, duration double")
    m = {r["task_id"]: r["median_duration"] for r in R.run_metrics(runs, ["task_id"]).collect()}
    assert m == {1: 3.0, 2: 6.0}  # sorted[n // 2]
    assert R.run_metrics(runs).first()["median_duration"] == 4.0


def test_traces_roundtrip_and_steps(spark):
    d = tempfile.mkdtemp(prefix="tw-trace-")
    trace = {"run_id": "r1", "question": "q", "dataset_id": "sales", "status": "success",
             "steps": [{"step_id": 1, "action": "aggregate",
                        "result": {"rows": 5, "group_by": ["month"], "metrics": ["sum(x)"], "query": "select 1",
                                   "computed_values": {"result_count": 5}}}]}
    with open(os.path.join(d, "trace.json"), "w") as f:
        json.dump(trace, f, indent=2)
    t = S.read_traces(spark, d)
    steps = S.steps_of_traces(t)
    assert R.step_checks(steps).first()["monthly_aggregation"]
    out = tempfile.mkdtemp(prefix="tw-trace-out-")
    S.append_trace(t, out + "/table")
    S.append_trace(t, out + "/table")
    assert S.read_traces(spark, out + "/table").count() == 1  # a job that is run again adds nothing


def test_list_run_artifacts(spark):
    d = tempfile.mkdtemp(prefix="tw-runs-")
    for rel in ("r1/trace.json", "r1/charts/c.png", "r2/summary.md"):
        os.makedirs(os.path.dirname(os.path.join(d, rel)), exist_ok=True)
        open(os.path.join(d, rel), "w").write("x")
    got = sorted((r["run_id"], r["name"]) for r in R.list_run_artifacts(spark, d).collect())
    assert got == [("r1", "charts/c.png"), ("r1", "trace.json"), ("r2", "summary.md")]


def test_resolve_ingest_catalog_and_fingerprints(spark):
    d = tempfile.mkdtemp(prefix="tw-data-")
    src = os.path.join(d, "upload.csv")
    with open(src, "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    assert resolve_dataset(spark, d, "upload").endswith("upload.csv")
    assert dataset_exists(spark, d, "upload") and not dataset_exists(spark, d, "nope")
    with pytest.raises(DatasetNotFound):
        resolve_dataset(spark, d, "nope")
    with pytest.raises(UnsupportedSource):
        S.ingest_dataset(spark, os.path.join(d, "x.xlsx"), d)
    store = tempfile.mkdtemp(prefix="tw-store-")
    S.ingest_dataset(spark, src, store)
    assert load_dataset(spark, store, "upload").count() == 2
    cat = S.dataset_catalog(spark, d).first()
    assert (cat["dataset_id"], cat["columns"], cat["rows"]) == ("upload", ["a", "b"], None)
    parts = S.fingerprint_files(spark, store).collect()
    assert parts and {p["dataset"] for p in parts} == {"upload.parquet"}
    for p in parts:
        body = open(os.path.join(store, "upload.parquet", p["filename"]), "rb").read()
        assert (p["size_bytes"], p["sha256"]) == (len(body), hashlib.sha256(body).hexdigest())
    fp = S.fingerprint_files(spark, d, "*.csv").first()
    assert fp["sha256"] == hashlib.sha256(open(src, "rb").read()).hexdigest()


def test_fingerprint_rows_is_order_free(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    a = S.fingerprint_rows(df).first()
    b = S.fingerprint_rows(df.orderBy(F.desc("k")).repartition(3)).first()
    c = S.fingerprint_rows(df.dropDuplicates()).first()
    assert a == b and a["high_sum"] != c["high_sum"]


def test_read_tasks(spark):
    d = tempfile.mkdtemp(prefix="tw-tasks-")
    with open(os.path.join(d, "tasks.jsonl"), "w") as f:
        f.write(json.dumps({"id": 1, "dataset_id": "sales", "question": "q", "assertions": ["chart_created"]}) + "\n")
    t = S.read_tasks(spark, d).first()
    assert t["assertions"] == ["chart_created"]


def test_result_sink_name(spark):
    assert S.result_name("select 1") == "result_" + hashlib.sha1(b"select 1").hexdigest()[:12]


def test_postflight_and_criteria(spark):
    d = tempfile.mkdtemp(prefix="tw-post-")
    files = {"r1/analysis.ipynb": "{}", "r1/summary.md": "x" * 80, "r1/trace.json": "{}", "r1/charts/a.png": "p",
             "r2/summary.md": "  short  ", "r2/trace.json": "{}"}
    for rel, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, rel)), exist_ok=True)
        open(os.path.join(d, rel), "w").write(body)
    facts = R.artifact_facts(spark, d)
    found = sorted((r["run_id"], r["severity"], r["message"]) for r in R.postflight(facts).collect())
    assert found == [("r2", "error", "The run left no analysis.ipynb"),
                     ("r2", "error", "The run left no chart"),
                     ("r2", "warning", "The summary has under 50 characters")]
    crit = spark.createDataFrame([("r1", "Chart saved"), ("r2", "chart saved"), ("r2", "summary written"),
                                  ("r2", "notebook built"), ("r2", "numbers grounded")], "run_id string, criterion string")
    got = {(r["run_id"], r["criterion"]): r["met"] for r in R.criteria_met(crit, facts).collect()}
    assert got == {("r1", "Chart saved"): True, ("r2", "chart saved"): False, ("r2", "summary written"): True,
                   ("r2", "notebook built"): False, ("r2", "numbers grounded"): True}


def test_best_result_priorities(spark):
    steps = spark.createDataFrame([
        (1, 1, "aggregate", ["region"], ["sum(x)"], None, 3, None, ["region", "revenue_percentage"]),
        (1, 2, "aggregate", [], ["sum(x)"], None, 1, None, ["sum_x"]),
        (1, 3, "visualize", [], [], "bar", 0, None, []),
        (2, 1, "prepare_data", [], [], None, 10, None, []),
        (2, 2, "aggregate", [], ["avg(y)"], None, 1, None, ["avg_y"])],
        "run_id long, step_id long, action string, group_by array<string>, metrics array<string>, "
        "chart_type string, result_count long, query string, columns array<string>")
    plain = {r["run_id"]: (r["step_id"], r["priority"]) for r in R.best_result(steps).collect()}
    assert plain == {1: (1, 3), 2: (2, 2)}
    qs = spark.createDataFrame([(1, "What percentage of revenue?"), (2, "average y")], "run_id long, question string")
    asked = {r["run_id"]: (r["step_id"], r["priority"]) for r in R.best_result(steps, qs).collect()}
    assert asked == {1: (1, 4), 2: (2, 2)}
