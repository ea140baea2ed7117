"""Data-quality checks: schema, preflight and Tukey outliers.

Preflight is a few scans, however wide the table:

* pass 1 — one ``agg``: row count, null count of every column, min/max and
  the two quartiles of every numeric column, failed date parses of every
  date-named text column;
* pass 2 — one ``agg`` of ``count_if`` outside the Tukey fences of every
  numeric column (fences from pass 1's single row).

Each result row is one finding ``check, column, severity, value, message``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.dates import is_date_name, parse_timestamp
from tablework.operators.profile import clean_value, numeric_columns, q, quartile_values

# Thresholds of the preflight checks.
MAX_MISSING_RATIO = 0.8
MIN_ROWS = 1
OUTLIER_MIN_ROWS = 10
TUKEY_K = 1.5

# Expected type words and the Spark types each one accepts.
TYPE_FAMILIES = {
    "int": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double", "decimal"),
    "object": ("string",),
    "bool": ("boolean",),
    "datetime": ("date", "timestamp", "timestamp_ntz"),
}

FINDING_SCHEMA = "check string, column string, severity string, value double, message string"


@dataclass
class ColumnStats:
    rows: int
    nulls: dict
    minmax: dict
    quartiles: dict
    bad_dates: dict


def date_risk_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and is_date_name(f.name)]


def column_stats(df: DataFrame, approx: bool = False, with_quartiles: bool | None = True) -> ColumnStats:
    """Pass 1: everything the checks need, in one aggregate (quartiles, when
    asked, come from the bounded exact-quantile passes)."""
    nums = numeric_columns(df)
    dcols = date_risk_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(clean_value(df, c).isNull()).alias(f"n{i}"))
    for i, c in enumerate(nums):
        v = clean_value(df, c).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    for i, c in enumerate(dcols):
        aggs.append(F.count_if(q(c).isNotNull() & parse_timestamp(q(c)).isNull()).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    # None: only when the table is large enough for the outlier check
    want = with_quartiles if with_quartiles is not None else row["rows"] > OUTLIER_MIN_ROWS
    qv = quartile_values(df, nums, (0.25, 0.75), approx) if want else {c: [None, None] for c in nums}
    return ColumnStats(
        rows=row["rows"],
        nulls={c: row[f"n{i}"] for i, c in enumerate(df.columns)},
        minmax={c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(nums)},
        quartiles={c: (tuple(qv[c]) if qv[c][0] is not None else None) for c in nums},
        bad_dates={c: row[f"d{i}"] for i, c in enumerate(dcols)},
    )


def fences(q1: float, q3: float, k: float = TUKEY_K) -> tuple[float, float]:
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def outlier_counts(df: DataFrame, stats: ColumnStats) -> dict:
    """Pass 2: values outside the fences, per numeric column (0 when the
    quartiles meet)."""
    aggs, names = [], []
    for c, qs in stats.quartiles.items():
        if qs is None or qs[1] - qs[0] == 0:
            continue
        lo, hi = fences(*qs)
        v = clean_value(df, c).cast("double")
        names.append(c)
        aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{len(names) - 1}"))
    out = {c: 0 for c in stats.quartiles}
    if aggs:
        row = df.agg(*aggs).first()
        out.update({c: row[f"o{i}"] for i, c in enumerate(names)})
    return out


def outlier_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, q1, q3, iqr, lower, upper, outliers`` per numeric column.
    Only tables with more than ten rows are checked (zero otherwise)."""
    stats = column_stats(df, approx)
    counts = outlier_counts(df, stats) if stats.rows > OUTLIER_MIN_ROWS else {c: 0 for c in stats.quartiles}
    rows = []
    for c, qs in stats.quartiles.items():
        if qs is None:
            rows.append((c, None, None, None, None, None, 0))
            continue
        lo, hi = fences(*qs)
        rows.append((c, qs[0], qs[1], qs[1] - qs[0], lo, hi, int(counts[c])))
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, lower double, upper double, outliers long")


def missing_table(df: DataFrame, stats: ColumnStats | None = None) -> DataFrame:
    """``column, null_count, missing_ratio, high_missing`` (ratio strictly above 0.8)."""
    stats = stats or column_stats(df, with_quartiles=False)
    rows = []
    for c in df.columns:
        ratio = stats.nulls[c] / stats.rows if stats.rows else None
        rows.append((c, int(stats.nulls[c]), ratio, ratio is not None and ratio > MAX_MISSING_RATIO))
    return df.sparkSession.createDataFrame(
        rows, "column string, null_count long, missing_ratio double, high_missing boolean")


def preflight(df: DataFrame, approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, one-row metrics).  An empty table is one error and stops."""
    spark: SparkSession = df.sparkSession
    stats = column_stats(df, approx, with_quartiles=None)
    findings = []
    nums = numeric_columns(df)
    if stats.rows == 0:
        findings.append(("empty", None, "error", 0.0, "The table has no rows"))
        metrics = spark.createDataFrame(
            [(0, len(df.columns), len(nums), 0, False)],
            "row_count long, column_count int, numeric_columns int, high_missing_columns int, valid boolean")
        return spark.createDataFrame(findings, FINDING_SCHEMA), metrics
    high = [c for c in df.columns if stats.nulls[c] / stats.rows > MAX_MISSING_RATIO]
    for c in high:
        findings.append(("high_missing", c, "warning", stats.nulls[c] / stats.rows,
                         f"{c}: over {MAX_MISSING_RATIO:.0%} of the values are missing"))
    for c, bad in stats.bad_dates.items():
        if bad:
            findings.append(("date_parse", c, "warning", float(bad),
                             f"{c}: named like a date, with text that is none"))
    for c in nums:
        lo, hi = stats.minmax[c]
        if lo == hi:
            findings.append(("constant", c, "warning", lo, f"{c}: one value in all rows"))
    if stats.rows > OUTLIER_MIN_ROWS:
        for c, n in outlier_counts(df, stats).items():
            if n > 0:
                findings.append(("outliers", c, "warning", float(n),
                                 f"{c}: {n} values beyond the quartile fences"))
    if stats.rows < MIN_ROWS:
        findings.append(("min_rows", None, "error", float(stats.rows), f"{stats.rows} rows, at least {MIN_ROWS} wanted"))
    valid = not any(f[2] == "error" for f in findings)
    metrics = spark.createDataFrame(
        [(int(stats.rows), len(df.columns), len(nums), len(high), valid)],
        "row_count long, column_count int, numeric_columns int, high_missing_columns int, valid boolean")
    return spark.createDataFrame(findings, FINDING_SCHEMA), metrics


def type_matches(expected: str, actual: str) -> bool:
    fam = TYPE_FAMILIES.get(expected.lower())
    a = actual.lower()
    if fam:
        return any(a == t or a.startswith(t + "(") for t in fam)
    return expected.lower() in a


def validate_schema(df: DataFrame, required: list[str] | None = None,
                    types: dict | None = None) -> tuple[DataFrame, bool]:
    """Missing required columns are errors; type mismatches are warnings;
    fewer than one row is an error (the row count is one aggregate)."""
    findings = []
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        findings.append(("required_columns", ",".join(missing), "error", float(len(missing)),
                         f"Columns wanted and not there: {', '.join(missing)}"))
    actual = dict(df.dtypes)
    for c, want in (types or {}).items():
        if c in actual and not type_matches(want, actual[c]):
            findings.append(("column_type", c, "warning", None,
                             f"{c}: {actual[c]} where {want} was wanted"))
    n = df.agg(F.count(F.lit(1))).first()[0]
    if n < MIN_ROWS:
        findings.append(("min_rows", None, "error", float(n),
                         f"{n} rows, at least {MIN_ROWS} wanted"))
    valid = not any(f[2] == "error" for f in findings)
    return df.sparkSession.createDataFrame(findings, FINDING_SCHEMA), valid


def date_parse_table(df: DataFrame) -> DataFrame:
    """``column, bad_values`` for every date-named text column: non-null
    values that parse as no date, counted over all rows in one aggregate."""
    cols = date_risk_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bad_values long")
    aggs = [F.count_if(q(c).isNotNull() & parse_timestamp(q(c)).isNull()).alias(f"d{i}")
            for i, c in enumerate(cols)]
    args = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {args}) AS (`column`, `bad_values`)")


def constant_table(df: DataFrame) -> DataFrame:
    """``column, min, max, is_constant`` for every numeric column (one aggregate)."""
    nums = numeric_columns(df)
    aggs = []
    for i, c in enumerate(nums):
        v = clean_value(df, c).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    args = ", ".join(f"'{c}', lo{i}, hi{i}" for i, c in enumerate(nums))
    return (df.agg(*aggs).selectExpr(f"stack({len(nums)}, {args}) AS (`column`, `min`, `max`)")
              .withColumn("is_constant", F.col("min") == F.col("max")))
