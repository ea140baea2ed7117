"""Fact tables behind a written summary of a result frame.

Each function returns a small DataFrame of facts (numbers, labels and a
formatted text column) computed with aggregates over the result; a writer
turns them into prose.  Totals are scalar sub-queries and ranks are numbered
only after ``limit``, so no step gathers the whole result in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.text import format_value
from tablework.operators.aggregate import extrema, share_of_total
from tablework.operators.ordinal import with_row_index
from tablework.operators.profile import q
from tablework.session import written_once
from tablework.sources.scan import nan_to_null

# Trend wording thresholds (percent).
STABLE_CHANGE = 5
STRONG_CHANGE = 15
MINIMAL_CHANGE = 1
HIGH_CV = 30
MODERATE_CV = 15
REMARK_DECLINE = -10
REMARK_GROWTH = 15
REMARK_VOLATILE = 25
# Metric words that trigger the business remark.
REMARK_WORDS = ("revenue", "sales")
BREAKDOWN_MAX_GROUPS = 10
DEFAULT_SHOW_N = 10


def _label(keys: list[str], names: bool = False, of=q) -> Column:
    """The keys of a row as text; a null key is shown as None."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}=" if names else ""), F.coalesce(of(k).cast("string"), F.lit("None"))) for k in keys])


def scalar_fact(df: DataFrame, is_aggregate: bool = False) -> DataFrame:
    """One numeric cell: ``column, value, text``."""
    f = df.schema.fields[0]
    if len(df.schema.fields) != 1 or not isinstance(f.dataType, T.NumericType):
        raise ValueError("scalar_fact needs a frame of one numeric column")
    suffix = " (aggregated result)." if is_aggregate else "."
    v = q(f.name)
    return df.limit(1).select(
        F.lit(f.name).alias("column"), v.cast("double").alias("value"),
        F.concat(F.lit(f"{f.name} is "), format_value(v, f.name), F.lit(suffix)).alias("text"))


def group_facts(agg: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Top and bottom group of up to two metrics and the group count:
    ``metric, top_label, top_value, bottom_label, bottom_value, groups``."""
    ms = metrics[:2]
    agg = written_once(agg.select(*[q(c) for c in [*keys, *ms]]), "groups")
    ex = extrema(agg, keys, ms)
    groups = agg.agg(F.count(F.lit(1))).scalar()
    top = F.when(F.col("max_value").isNotNull(), _label(keys, True, lambda k: F.col(f"`max_{k}`")))
    bot = F.when(F.col("min_value").isNotNull(), _label(keys, True, lambda k: F.col(f"`min_{k}`")))
    return ex.select("metric", top.alias("top_label"), F.col("max_value").alias("top_value"),
                     bot.alias("bottom_label"), F.col("min_value").alias("bottom_value"),
                     groups.alias("groups"))


def trend_facts(agg: DataFrame, period: str, metric: str) -> DataFrame:
    """First, last, change %, peak, trough, peak-to-trough %, mean, CV % and
    wording, in one aggregate over the period table."""
    m, p = q(metric).cast("double"), q(period)
    one = agg.where(m.isNotNull()).agg(
        F.count(F.lit(1)).alias("periods"),
        F.min_by(m, p).alias("first_value"), F.max_by(m, p).alias("last_value"),
        F.min(F.struct((-m).alias("v"), p.alias("p"))).alias("peak"),
        F.min(F.struct(m.alias("v"), p.alias("p"))).alias("trough"),
        F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"))
    change = F.when(F.col("first_value") != 0,
                    (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100).otherwise(F.lit(0.0))
    peak_v, trough_v = -F.col("peak.v"), F.col("trough.v")
    p2t = F.when(trough_v != 0, (peak_v - trough_v) / trough_v * 100).otherwise(F.lit(0.0))
    cv = F.when(F.col("mean") != 0, F.coalesce(F.col("std"), F.lit(0.0)) / F.col("mean") * 100).otherwise(F.lit(0.0))
    base = one.select("periods", "first_value", "last_value", change.alias("change_pct"),
                      F.col("peak.p").cast("string").alias("peak_period"), peak_v.alias("peak_value"),
                      F.col("trough.p").cast("string").alias("trough_period"), trough_v.alias("trough_value"),
                      p2t.alias("peak_to_trough_pct"), "mean", cv.alias("cv_pct"))
    ch, cvc = F.col("change_pct"), F.col("cv_pct")
    direction = (F.when(F.abs(ch) < STABLE_CHANGE, "relatively stable")
                  .when(ch > 0, F.when(ch > STRONG_CHANGE, "upward trending").otherwise("moderately increasing"))
                  .otherwise(F.when(ch < -STRONG_CHANGE, "declining").otherwise("moderately decreasing")))
    volatility = (F.when(cvc > HIGH_CV, "highly volatile").when(cvc > MODERATE_CV, "moderately volatile")
                   .otherwise("stable"))
    movement = F.when(F.abs(ch) >= MINIMAL_CHANGE, F.when(ch > 0, "increased").otherwise("decreased")) \
                .otherwise("minimal change")
    if any(w in metric.lower() for w in REMARK_WORDS):
        remark = (F.when(ch < REMARK_DECLINE, "declining revenue")
                   .when(ch > REMARK_GROWTH, "strong growth")
                   .when(cvc > REMARK_VOLATILE, "high volatility"))
    else:
        remark = F.lit(None).cast("string")
    return base.select("*", direction.alias("direction"), volatility.alias("volatility"),
                       movement.alias("movement"), remark.alias("remark"))


def _ranked(sorted_df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``rank`` (1-based) over at most ``limit`` rows kept by ``orderBy().limit()``."""
    kept = sorted_df.orderBy(*order).limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def breakdown(agg: DataFrame, keys: list[str], value: str, question: str | None = None) -> DataFrame:
    """All groups by ``value`` descending (ties to the lowest keys):
    ``rank, label, value, text``.  Used with a percent column (N7) or the
    raw metric (N9)."""
    agg = nan_to_null(agg)
    order = [q(value).desc_nulls_last()] + [q(k).asc_nulls_last() for k in keys]
    r = with_row_index(agg, order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return r.select("rank", _label(keys).alias("label"), q(value).cast("double").alias("value"),
                    F.concat(_label(keys), F.lit(": "), format_value(q(value), value, question)).alias("text"))


def share_facts(agg: DataFrame, keys: list[str], value: str, question: str | None = None) -> DataFrame:
    """Value and share of the total of every group, and the total (N8):
    ``rank, label, value, share_pct, total, text``."""
    agg = written_once(agg.select(*[q(c) for c in [*keys, value]]), "groups")
    shares = share_of_total(agg, value, "__share")
    total = agg.agg(F.sum(F.when(~F.isnan(q(value).cast("double")), q(value).cast("double")))).scalar()
    order = [F.col("__share").desc_nulls_last()] + [q(k).asc_nulls_last() for k in keys]
    r = with_row_index(shares, order, "rank")
    return r.select((F.col("rank") + 1).cast("int").alias("rank"), _label(keys).alias("label"), q(value).cast("double").alias("value"),
                    F.col("__share").alias("share_pct"), total.alias("total"),
                    F.concat(_label(keys), F.lit(": "), format_value(F.col("__share"), "share_pct", question)).alias("text"))


def topn_facts(agg: DataFrame, keys: list[str], metric: str, n: int | None = None,
               smallest_first: bool = False) -> DataFrame:
    """Top-N rows with rank, value and share of the total, plus the joint
    share of the N and the count of the others (same on every row)."""
    show = n if n is not None else DEFAULT_SHOW_N
    agg = written_once(nan_to_null(agg.select(*[q(c) for c in [*keys, metric]])), "groups")
    v = q(metric)
    order = [v.asc_nulls_last() if smallest_first else v.desc_nulls_last()] + [q(k).asc_nulls_last() for k in keys]
    total = {"t": agg.agg(F.sum(v)).scalar(), "g": agg.agg(F.count(F.lit(1))).scalar()}
    r = _ranked(agg, order, show)
    share = F.try_divide(v.cast("double"), total["t"]) * 100
    top_total = F.sum(v).over(Window.partitionBy())  # at most N rows here
    return r.select(
        "rank", _label(keys).alias("label"), v.cast("double").alias("value"), share.alias("share_pct"),
        (F.try_divide(top_total.cast("double"), total["t"]) * 100).alias("top_share_pct"),
        F.greatest(total["g"] - F.lit(show), F.lit(0)).alias("others"))


def single_row_text(df: DataFrame, max_pairs: int = 6, question: str | None = None) -> DataFrame:
    """One row: up to six ``name=value`` pairs joined by `` | ``."""
    cols = df.columns[:max_pairs]
    parts = []
    for c in cols:
        dt = df.schema[c].dataType
        val = format_value(q(c), c, question) if isinstance(dt, T.NumericType) else q(c).cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(val, F.lit("None"))))
    return df.limit(1).select(F.concat_ws(" | ", *parts).alias("text"))


# Question words that select a summary case.
TREND_WORDS = ("trend", "trends", "over time", "monthly", "quarterly", "yearly", "which month", "which quarter",
               "which year", "what month", "highest month", "lowest month", "best month", "worst month")
PERIOD_KEYS = ("month", "quarter", "year")
SHARE_QUESTION_WORDS = ("percentage", "percent", "share")
TOP_QUESTION_WORDS = ("top", "best", "highest", "most", "largest", "worst", "lowest", "smallest")


def summary_facts(df: DataFrame, meta: dict | None = None, question: str | None = None) -> tuple[str, DataFrame]:
    """Pick the summary case for a result frame and return (case, facts).

    Cases: ``empty``, ``scalar``, ``groups_only``, ``trend``,
    ``breakdown_pct``, ``share_of_total``, ``breakdown``, ``top_n``,
    ``groups``, ``single_row``, ``digest``, ``shape``.  Row counts come from
    one aggregate; the facts themselves are the functions above."""
    from tablework.functions.metrics import metric_columns
    from tablework.functions.text import question_smallest_first
    from tablework.operators.profile import frame_digest, numeric_columns
    spark = df.sparkSession
    meta = meta or {}
    ql = (question or "").lower()
    n = df.agg(F.count(F.lit(1))).first()[0]
    if n == 0:
        return "empty", spark.createDataFrame([("No rows returned.",)], "text string")
    fields = df.schema.fields
    if n == 1 and len(fields) == 1 and isinstance(fields[0].dataType, T.NumericType):
        return "scalar", scalar_fact(df, bool(meta.get("is_aggregate")))
    keys = [k for k in (meta.get("group_by") or []) if k in df.columns]
    if meta.get("is_aggregate") and keys:
        metrics = metric_columns(df, keys)
        if not metrics:
            return "groups_only", spark.createDataFrame(
                [(", ".join(keys), n)], "group_by string, groups long")
        periods = [k for k in keys if k.lower() in PERIOD_KEYS]
        if periods and any(w in ql for w in TREND_WORDS):
            return "trend", trend_facts(df, periods[0], metrics[0])
        if any(w in ql for w in SHARE_QUESTION_WORDS) and n <= BREAKDOWN_MAX_GROUPS:
            pct = [c for c in df.columns if "percentage" in c.lower() or "percent" in c.lower()]
            if pct:
                return "breakdown_pct", breakdown(df, keys, pct[0], question=question)
            if "total_revenue" in df.columns:
                return "share_of_total", share_facts(df, keys, "total_revenue", question)
            return "breakdown", breakdown(df, keys, metrics[0], question=question)
        if any(w in ql for w in TOP_QUESTION_WORDS):
            from tablework.functions.text import question_top_n
            row = spark.createDataFrame([(question,)], "q string").select(
                question_top_n(F.col("q")).alias("n"), question_smallest_first(F.col("q")).alias("s")).first()
            show = row["n"] if row["n"] is not None else min(n, DEFAULT_SHOW_N)
            return "top_n", topn_facts(df, keys, metrics[0], show, bool(row["s"]))
        return "groups", group_facts(df, keys, metrics)
    if n == 1:
        return "single_row", single_row_text(df, question=question)
    if numeric_columns(df):
        return "digest", frame_digest(df, 3)
    return "shape", spark.createDataFrame([(n, len(df.columns))], "rows long, columns int")
