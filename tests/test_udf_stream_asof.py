import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablework.operators import opensql
from tablework.operators.opensql import asof_join, range_join, range_totals, run_sql
from tablework.operators.prepare import PrepareError
from tablework.operators.sample import reservoir_sample
from tablework.operators.udf import GroupAggregate, aggregate_groups, apply_in_pandas, map_batches, register_step, run_step
from tablework.streaming.prepare_stream import prepare_stream, read_stream


def test_step_registry(spark):
    @register_step("double_it")
    def _double(df, col):
        return df.withColumn(col, F.col(col) * 2)
    df = spark.createDataFrame([(1,)], "x int")
    assert run_step("double_it", df, col="x").first()["x"] == 2
    with pytest.raises(KeyError):
        run_step("nope", df)


def test_map_batches_and_apply_in_pandas(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "g long, v double")
    out = map_batches(df, lambda p: p.assign(v=p.v + 1), "g long, v double")
    assert out.agg(F.sum("v")).first()[0] == sum(range(30)) + 30
    grp = apply_in_pandas(df, ["g"], lambda p: p.assign(v=p.v - p.v.mean()), "g long, v double")
    assert abs(grp.agg(F.sum("v")).first()[0]) < 1e-9


def test_run_sql_flags_aggregates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "x int, k string")
    res = run_sql(spark, "SELECT k, sum(x) AS s FROM t GROUP BY k", {"t": df})
    assert res.is_aggregate and res.df.first()["s"] == 3
    assert not run_sql(spark, "SELECT k, ' group by sum(' AS s FROM t", {"t": df}).is_aggregate
    assert run_sql(spark, "SELECT * FROM (SELECT max(x) AS m FROM t) AS q", {"t": df}).is_aggregate
    assert not run_sql(spark, "SELECT s FROM u", {"u": df.groupBy("k").agg(F.sum("x").alias("s"))}).is_aggregate


def _brute_asof(left, right):
    out = {}
    for lid, lu, lt in left:
        best = None
        for rid, ru, rt, rv in right:
            if ru == lu and rt <= lt and (best is None or rt > best[0] or (rt == best[0] and rid > best[1])):
                best = (rt, rid, rv)
        out[lid] = best[1] if best else None
    return out


@pytest.mark.parametrize("span", [20000, 40, 1])
def test_asof_join_matches_brute_force(spark, span):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    left = [(i, rnd.randint(0, 3), t0 + dt.timedelta(seconds=rnd.randint(0, span))) for i in range(200)]
    right = [(1000 + i, rnd.choice([0, 0, 0, 1, 2]), t0 + dt.timedelta(seconds=rnd.randint(0, span)), float(i))
             for i in range(300)]
    L = spark.createDataFrame(left, "id long, u long, ts timestamp_ntz")
    Rt = spark.createDataFrame(right, "rid long, u long, ts timestamp_ntz, v double")
    got = {r["id"]: r["asof_rid"] for r in asof_join(L, Rt, ["u"], "ts", ["rid", "v"]).collect()}
    assert got == _brute_asof(left, right)


def test_asof_join_with_null_keys_and_times(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    L = spark.createDataFrame([(1, 7, t[2]), (2, None, t[2]), (3, 7, None), (4, 7, t[0]), (5, 8, t[4])], "id long, u long, ts timestamp_ntz")
    R = spark.createDataFrame([(10, 7, t[1]), (11, 7, t[1]), (12, None, t[1]), (13, 7, None), (14, 7, t[3])], "rid long, u long, ts timestamp_ntz")
    got = {r["id"]: r["asof_rid"] for r in asof_join(L, R, ["u"], "ts", ["rid"]).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_range_join_kinds_and_wide_ranges(spark, how):
    pts = [(i, float(i)) for i in range(-3, 30)] + [(99, None)]
    rngs = [(0, 2.0, 2.0), (1, -1e9, 1e9), (2, 5.0, 4.0), (3, 0.5, 17.25), (4, None, 3.0), (5, 28.0, float("inf")), (6, 500.0, 501.0)]
    P = spark.createDataFrame(pts, "pid long, x double")
    G = spark.createDataFrame(rngs, "rid long, lo double, hi double")
    got = sorted(((r["pid"], r["rid"]) for r in range_join(P, G, "x", "lo", "hi", how).collect()), key=str)
    hits = [(p, r) for p, x in pts for r, lo, hi in rngs if None not in (x, lo, hi) and lo <= x <= hi]
    want = list(hits)
    if how in ("left", "full"):
        want += [(p, None) for p, _ in pts if p not in {h[0] for h in hits}]
    if how in ("right", "full"):
        want += [(None, r) for r, _, _ in rngs if r not in {h[1] for h in hits}]
    assert got == sorted(want, key=str)


def test_range_join_matches_brute_force(spark):
    pts = [(i, float(i) * 0.7) for i in range(100)]
    rngs = [(j, float(j * 5), float(j * 5 + 12)) for j in range(15)]
    P = spark.createDataFrame(pts, "pid long, x double")
    Rg = spark.createDataFrame(rngs, "rid long, lo double, hi double")
    got = sorted((r["pid"], r["rid"]) for r in range_join(P, Rg, "x", "lo", "hi").collect())
    want = sorted((p, r) for p, x in pts for r, lo, hi in rngs if lo <= x <= hi)
    assert got == want


KINDS = {
    "date": lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i), "timestamp_ntz": lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=i),
    "long": lambda i: 2**53 + i, "string": lambda i: f"{i + 50:04d}", "decimal(38,2)": lambda i: Decimal(10) ** 20 + i}


@pytest.mark.parametrize("kind", KINDS)
def test_range_join_on_any_ordered_type(spark, kind, monkeypatch):
    monkeypatch.setattr(opensql, "BLOCK", 8)
    make, r = KINDS[kind], random.Random(6)
    pts = [(i, None if i % 17 == 0 else r.randint(0, 120)) for i in range(150)] + [(200 + i, 60) for i in range(30)]
    rngs = [(j, a, a + r.choice([-3, 0, 0, 1, 5, 90])) for j, a in enumerate(r.choices(range(121), k=60))] + [(90, None, 5), (91, 5, None)]
    P = spark.createDataFrame([(i, None if x is None else make(x)) for i, x in pts], f"id long, x {kind}")
    G = spark.createDataFrame([(j, *[None if v is None else make(v) for v in (a, b)]) for j, a, b in rngs], f"id long, lo {kind}, hi {kind}")
    hits = [(p, g) for p, x in pts for g, a, b in rngs if None not in (x, a, b) and a <= x <= b]
    want = hits + [(p, None) for p, _ in pts if p not in {h[0] for h in hits}] + [(None, g) for g, _, _ in rngs if g not in {h[1] for h in hits}]
    for parts in (None, 6):
        got = [(r[0], r[2]) for r in range_join(P, G, "x", "lo", "hi", "full", parts).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_range_join_of_overlapping_ranges(spark):
    P = spark.range(5000).withColumn("x", F.col("id") * 3)
    G = spark.range(2000).select(F.col("id").alias("g"), (F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 9000).alias("hi"))
    got = range_join(P, G, "x", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"), F.sum("g").alias("g")).first()
    want = [(range(-(-2 * g // 3), min(5000, (2 * g + 9000) // 3 + 1)), g) for g in range(2000)]
    assert tuple(got) == (sum(len(r) for r, _ in want), sum(sum(r) for r, _ in want), sum(len(r) * g for r, g in want))


@pytest.mark.parametrize("long", [0, 40])
def test_range_join_tries_no_more_than_three_times_its_points(spark, long):
    P = spark.range(4000).withColumn("x", F.col("id"))
    G = spark.range(50).select(F.col("id").alias("g"), (F.col("id") * 61).alias("lo"), (F.col("id") * 61 + long).alias("hi"))
    met = range_join(P, G, "x", "lo", "hi")
    size, listed = opensql._levels(), range(50)
    most = max([n for n in size if n <= long + 1] or size[-1:])
    assert met.count() == 50 * (long + 1) and most <= max(long + 1, opensql.STEP)
    tried = sum(most * ((g * 61 + long) // most - g * 61 // most + 1) for g in listed)
    assert tried <= 3 * 50 * max(long + 1, opensql.STEP)


@pytest.mark.parametrize("kind", ["date", "string", "decimal(38,2)", "double"])
def test_range_totals_match_brute_force(spark, kind):
    make, r = {**KINDS, "double": lambda i: float("nan") if i == 120 else i * 0.5}[kind], random.Random(8)
    pts = [(i, None if i % 17 == 0 else r.randint(0, 120)) for i in range(150)] + [(200 + i, 60) for i in range(30)]
    rngs = [(j if j % 9 else None, a, min(120, a + r.choice([-3, 0, 0, 1, 5, 90]))) for j, a in enumerate(r.choices(range(121), k=60))] + [(90, None, 5), (91, 5, None)] * 2
    P = spark.createDataFrame([(i, None if x is None else make(x)) for i, x in pts], f"id long, x {kind}")
    G = spark.createDataFrame([(j, *[None if v is None else make(v) for v in (a, b)]) for j, a, b in rngs], f"g long, lo {kind}, hi {kind}")
    got = range_totals(P, G, "x", "lo", "hi", {"n": F.lit(1), "keys": F.col("g")}, 4).select("id", "n", "keys").collect()
    met = {p: [g for g, a, b in rngs if None not in (x, a, b) and a <= x <= b] for p, x in pts}
    assert sorted(map(tuple, got)) == sorted((p, len(g), sum(k or 0 for k in g)) for p, g in met.items())


def test_range_join_dates_makes_no_pairs(spark, sf):
    import __spark_entry__ as e
    plan = e.queries()["range_join_dates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def _spread_of(rows):
    return GroupAggregate(lambda: (0, 0.0, None), lambda s, p: (s[0] + len(p), s[1] + p.v.sum(), max([x for x in (s[2], p.v.max()) if x is not None and x == x], default=None)),
                          lambda a, b: (a[0] + b[0], a[1] + b[1], max([x for x in (a[2], b[2]) if x is not None], default=None)),
                          lambda s: {"n": s[0], "total": s[1], "top": s[2]})


@pytest.mark.parametrize("keys", [["g"], ["g", "h"], []])
def test_group_aggregate_cuts_groups(spark, keys):
    rows = [(None if i % 50 == 0 else i % 4 if i % 3 else 0, str(i % 2), None if i % 11 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, h string, v double").repartition(9)
    got = apply_in_pandas(df, keys, _spread_of(df), "n long, total double, top double")
    by = df.groupBy(*keys) if keys else df.groupBy()
    want = by.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert aggregate_groups(df.limit(0), keys, _spread_of(df), "n long, total double, top double").collect() == []
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_group_aggregate_hands_states_on(spark, monkeypatch):
    from tablework.operators import udf
    monkeypatch.setattr(udf, "HELD_GROUPS", 3)
    df = spark.range(2000).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: (r["n"], r["total"]) for r in aggregate_groups(df, ["g"], _spread_of(df), "n long, total double, top double").collect()}
    assert got == {g: (50, float(sum(range(g, 2000, 40)))) for g in range(40)}


def test_group_aggregate_folds_grow_with_groups_plus_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(0, 20_000, 1, 4).select((F.col("id") * 7919 % 200).alias("g"), F.col("id").cast("double").alias("v"))
        folds = GroupAggregate(lambda: (0, 0), lambda s, p: (s[0] + 1, s[1] + len(p)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: {"folds": s[0], "n": s[1]})
        got = aggregate_groups(df, ["g"], folds, "folds long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r["g"], r["n"]) for r in got) == [(g, 100) for g in range(200)]
    assert sum(r["folds"] for r in got) <= 200 * 4 + 20_000 // 100 + 200  # 20,000 when every batch holds every group


def test_group_aggregate_of_nan_null_and_signed_zero_keys(spark):
    keys = [0.0, -0.0, float("nan"), None, 1.5] * 40
    df = spark.createDataFrame([(k, str(i % 2), 1.0) for i, k in enumerate(keys)], "g double, h string, v double").repartition(5)
    got = {r["g"]: r["n"] for r in aggregate_groups(df, ["g"], _spread_of(df), "n long, total double, top double").collect()}
    assert got == {0.0: 80, None: 80, 1.5: 40}


def test_reservoir_is_exact_and_repeatable(spark):
    import hashlib
    rows = [(i, None if i % 5 == 0 else i % 3, i % 7 or None) for i in range(900)] + [(1000, 9, 1)] * 4
    df = spark.createDataFrame(rows, "id long, s long, x long")

    def rank(r):
        return hashlib.md5("|".join(["5", *("null" if v is None else str(v) for v in (r[0], r[2]))]).encode()).hexdigest()
    for parts in (1, 7, 40):
        got = [tuple(r) for r in reservoir_sample(df.repartition(parts), 20, ["s"], ["id", "x"], 5).collect()]
        want = [r for s in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == s), key=rank)[:20]]
        assert sorted(got, key=str) == sorted(want, key=str)
    whole = reservoir_sample(df.repartition(11), 50, None, ["id", "x"], 5)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(sorted(rows, key=rank)[:50], key=str)
    assert reservoir_sample(df, 0).count() == 0 and reservoir_sample(df.limit(0), 5).count() == 0 and reservoir_sample(df, 5000).count() == 904
    assert "WindowGroupLimit" in whole._jdf.queryExecution().executedPlan().toString()


def test_prepare_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = read_stream(spark, sf, schema, glob="events.parquet")
    p = prepare_stream(stream, ["filter: event_type == 'purchase'", "extract_month"], date_columns=["ts"])
    q = p.df.writeStream.format("memory").queryName("tw_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n, min(month) AS m FROM tw_stream_test").first()
    batch = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'")
    assert got["n"] == batch.count() and got["m"] == "2024-01"
    with pytest.raises(PrepareError):
        prepare_stream(stream, ["sort: ts"])
