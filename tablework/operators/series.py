"""Chart-ready series: the data behind line, bar, box, scatter and heat-map
charts (drawing is left to the caller).

All series are aggregates or projections; the only per-table decisions
(which column is a date, which is categorical) are one small aggregate each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.dates import coerce_if_dates
from tablework.operators.aggregate import top_n_sum
from tablework.operators.ordinal import with_row_index
from tablework.session import written_once
from tablework.sources.scan import nan_to_null
from tablework.operators.profile import (clean_value, first_numeric, numeric_columns,
                                         pick_categorical, q, quartile_values)

# Chart rules.
AXIS_DATE_SHARE = 0.5
DEFAULT_TOP_N = 30
BOX_MAX_COLUMNS = 8
WHISKER_K = 1.5
HEAT_SAMPLE_ROWS = 10


def line_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x`` as a date when at least half of it parses; ``y`` summed per
    ``x`` (null ``x`` dropped); ascending by ``x``."""
    # rows are grouped by the raw text; dates are parsed for the few distinct ones
    raw = nan_to_null(df.select(q(x), q(y))).groupBy(q(x)).agg(F.sum(q(y)).alias(y), F.count(F.lit(1)).alias("__n"))
    d, _ = coerce_if_dates(written_once(raw, "line"), x, AXIS_DATE_SHARE, weight="__n")
    return (d.where(q(x).isNotNull()).groupBy(q(x)).agg(F.sum(q(y)).alias(y))
             .orderBy(q(x).asc()))


def line_index_series(df: DataFrame, order_by: list[str], y: str | None = None) -> DataFrame:
    """First numeric column (or ``y``) against its row position in
    ``order_by`` order: ``index, <y>``."""
    y = y or first_numeric(df)
    if y is None:
        raise ValueError("A line needs a numeric column")
    # row identity last: equal order keys still spread over range partitions
    base = df.select(*[q(c) for c in dict.fromkeys(order_by + [y])]).withColumn("__tie", F.monotonically_increasing_id())
    idx = with_row_index(base, [q(c).asc_nulls_last() for c in order_by] + [F.col("__tie").asc()], "index")
    return idx.select("index", q(y))


def bar_series(df: DataFrame, x: str, y: str, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    return top_n_sum(df, x, y, top_n)


def bar_auto_series(df: DataFrame, top_n: int = DEFAULT_TOP_N, approx: bool = False) -> DataFrame:
    """First categorical column by the first numeric one, summed."""
    cat, num = pick_categorical(df, approx=approx), first_numeric(df)
    if cat is None or num is None:
        raise ValueError("Bars need a categorical column and a numeric one")
    return top_n_sum(df, cat, num, top_n)


def _fence_row(df: DataFrame, cols: list[str], approx: bool) -> dict:
    qs = quartile_values(df, cols, (0.25, 0.5, 0.75), approx)
    return {c: (qs[c] if qs[c][0] is not None else None) for c in cols}


def box_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``column, q1, median, q3, lower_whisker, upper_whisker, outliers``.

    Pass 1 is one aggregate of all quartiles; pass 2 one aggregate of the
    whisker ends (last value inside 1.5·IQR) and outlier counts."""
    cols = columns if columns is not None else numeric_columns(df)[:BOX_MAX_COLUMNS]
    qs = _fence_row(df, cols, approx)
    aggs = []
    for i, c in enumerate(cols):
        v = clean_value(df, c).cast("double")
        q1, _, q3 = qs[c] if qs[c] is not None else (None, None, None)
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"lw{i}"), F.lit(None).cast("double").alias(f"uw{i}"),
                     F.lit(0).cast("long").alias(f"o{i}")]
            continue
        lo, hi = q1 - WHISKER_K * (q3 - q1), q3 + WHISKER_K * (q3 - q1)
        aggs += [F.min(F.when(v >= F.lit(lo), v)).alias(f"lw{i}"),
                 F.max(F.when(v <= F.lit(hi), v)).alias(f"uw{i}"),
                 F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}")]
    row = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        q1, med, q3 = qs[c] if qs[c] is not None else (None, None, None)
        rows.append((c, q1, med, q3, row[f"lw{i}"], row[f"uw{i}"], int(row[f"o{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, lower_whisker double, "
              "upper_whisker double, outliers long")


def box_outliers(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """The rows outside the whiskers of ``column`` (fences as constants); none
    if the column has no values."""
    fences = _fence_row(df, [column], approx)[column]
    if fences is None:
        return df.limit(0)
    q1, _, q3 = fences
    lo, hi = q1 - WHISKER_K * (q3 - q1), q3 + WHISKER_K * (q3 - q1)
    v = clean_value(df, column).cast("double")
    return df.where((v < F.lit(lo)) | (v > F.lit(hi)))


def scatter_series(df: DataFrame, x: str, y: str, fraction: float | None = None) -> DataFrame:
    """(x, y) pairs with both present; x kept as a date when it is one.
    ``fraction`` takes a repeatable sample of that share of the rows."""
    d, _ = coerce_if_dates(df.select(q(x), q(y)), x, AXIS_DATE_SHARE)
    d = d.where(q(x).isNotNull() & clean_value(d, y).isNotNull())
    return d if fraction is None else d.sample(fraction, seed=17)


def scatter_auto_series(df: DataFrame, fraction: float | None = None) -> DataFrame:
    nums = numeric_columns(df)
    if len(nums) < 2:
        raise ValueError("A scatter needs two numeric columns")
    return scatter_series(df, nums[0], nums[1], fraction)


def _pair_sums(n: int):
    """Task: for every pair of columns, over its rows with both present, the
    count, both means, both sums of squares and the sum of products about them,
    and the least and greatest value of the first.

    Sums are taken about the first mean of the task, in matrix products."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        sums, shift = np.zeros((6, n, n)), None
        low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)
            there = ~np.isnan(x)
            for j in range(n):  # of the rows where column j is there
                low[:, j] = np.minimum(low[:, j], np.where(there, x, np.inf)[there[:, j]].min(0, initial=np.inf))
                high[:, j] = np.maximum(high[:, j], np.where(there, x, -np.inf)[there[:, j]].max(0, initial=-np.inf))
            if shift is None:
                count = there.sum(0)
                shift = np.where(count > 0, np.where(there, x, 0).sum(0) / np.maximum(count, 1), 0)
            x, there = np.where(there, x - shift, 0), there.astype(float)
            sums += [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x]
        if shift is None:
            return
        k, sx, sy, sxx, syy, sxy = sums
        d = np.maximum(k, 1)
        out = [k, shift[:, None] + sx / d, shift[None, :] + sy / d, sxx - sx * sx / d, syy - sy * sy / d, sxy - sx * sy / d, low, high]
        i, j = np.nonzero(k > 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(o[i, j]) for o in out]],
                                         ["i", "j", "n", "mx", "my", "xx", "yy", "xy", "low", "high"])
    return run


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_a, col_b, corr`` for every ordered pair of numeric columns, over
    rows where both are present; null if either side is constant.

    One pass: a task folds its rows to a small matrix of centred sums, which
    are merged about the common mean of each pair."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    values = df.select(*[clean_value(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = values.mapInArrow(_pair_sums(len(cols)), "i long, j long, n double, mx double, my double, xx double, yy double, xy double, low double, high double")
    sums = written_once(sums, "pairs")  # columns squared rows a task
    mean = sums.groupBy("i", "j").agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("ax"),
                                      (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("ay"))
    dx, dy, n = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay"), F.col("n")
    whole = sums.join(mean, ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"),
        (F.min("low") < F.max("high")).alias("varies"))
    other = whole.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("varies").alias("other_varies"))
    whole = whole.join(other, ["i", "j"])  # columns squared rows
    names = F.array(*[F.lit(c) for c in cols])
    pairs = df.sparkSession.range(len(cols) ** 2).select(
        F.floor(F.col("id") / len(cols)).alias("i"), (F.col("id") % len(cols)).alias("j"))
    corr = F.when(F.col("varies") & F.col("other_varies") & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")))
    return pairs.join(whole, ["i", "j"], "left").select(
        F.get(names, F.col("i").cast("int")).alias("col_a"), F.get(names, F.col("j").cast("int")).alias("col_b"), corr.alias("corr"))


def heat_values(df: DataFrame) -> DataFrame:
    """With one numeric column or none: the first rows of the numeric
    columns (a bounded sample is the feature)."""
    return df.select(*[q(c) for c in numeric_columns(df)]).limit(HEAT_SAMPLE_ROWS)
