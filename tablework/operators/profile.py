"""Profiling: schema, basic statistics, missing counts, grounding values.

All statistics of a frame are gathered in **one** ``agg`` (one scan, partial
aggregation in every task), and the single wide result row is turned into a
long table with ``stack``, so no per-column job is ever run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.session import written_once

# The quartiles of the basic statistics.
QUARTILES = (0.25, 0.5, 0.75)
MAX_CATEGORIES = 50


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def first_numeric(df: DataFrame) -> str | None:
    cols = numeric_columns(df)
    return cols[0] if cols else None


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null (pandas folds the two)."""
    c = q(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def quantiles(c: Column, probs=QUARTILES, approx: bool = False) -> Column:
    """Linear-interpolated quantiles (as pandas and the SQL oracle).

    Exact ``percentile`` keeps one counter per distinct value of the group;
    ``approx=True`` switches to ``percentile_approx`` (bounded memory) for
    columns with very many distinct values."""
    arr = F.array(*[F.lit(p) for p in probs])
    if approx:
        return F.percentile_approx(c.cast("double"), arr, 10000)
    return F.percentile(c.cast("double"), arr)


def _stack(wide: DataFrame, names: list[str], fields: list[str], label: str = "column") -> DataFrame:
    """One wide row with ``<i>__<field>`` columns → one row per name."""
    args = []
    for i, n in enumerate(names):
        esc = n.replace("'", "\\'")
        args.append(f"'{esc}'")
        args.extend(f"`{i}__{f}`" for f in fields)
    expr = f"stack({len(names)}, {', '.join(args)}) AS (`{label}`, {', '.join(f'`{f}`' for f in fields)})"
    return wide.selectExpr(expr)


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def inspect_schema(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(column → type with row and column counts, 5-row sample)."""
    spark = df.sparkSession
    total = df.agg(F.count(F.lit(1))).scalar()
    out = schema_table(spark, df).select(
        "ordinal", "column_name", "data_type",
        total.alias("total_rows"), F.lit(len(df.columns)).alias("column_count"))
    return out, df.limit(5)


def quartile_values(df: DataFrame, cols: list[str], probs=QUARTILES, approx: bool = False) -> dict:
    """``{column: [value per prob]}``: exact (bounded, see ``quantiles.py``)
    or, with ``approx=True``, one ``percentile_approx`` aggregate."""
    if approx:
        row = df.agg(*[quantiles(clean_value(df, c), probs, True).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    from tablework.operators.quantiles import exact_quantiles
    return exact_quantiles(df, cols, list(probs))


def describe_numeric(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per numeric column.  The
    moments and extremes ride in the first quantile pass."""
    cols = columns if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        v = clean_value(df, c).cast("double")
        aggs += [F.count(v).alias(f"{i}__count"), F.avg(v).alias(f"{i}__mean"),
                 F.stddev_samp(v).alias(f"{i}__std"), F.min(v).alias(f"{i}__min"), F.max(v).alias(f"{i}__max")]
    from tablework.operators.quantiles import exact_quantiles
    if approx:
        qa = [quantiles(clean_value(df, c), QUARTILES, True).alias(f"{i}__q") for i, c in enumerate(cols)]
        row = df.agg(*aggs, *qa).first()
        qs = {c: (list(row[f"{i}__q"]) if row[f"{i}__q"] is not None else [None] * 3) for i, c in enumerate(cols)}
    else:
        qs, row = exact_quantiles(df, cols, list(QUARTILES), extra_aggs=aggs)
    rows = [(c, int(row[f"{i}__count"]), row[f"{i}__mean"], row[f"{i}__std"], row[f"{i}__min"],
             qs[c][0], qs[c][1], qs[c][2], row[f"{i}__max"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (NaN counts as missing)."""
    aggs = [F.count_if(clean_value(df, c).isNull()).alias(f"{i}__nulls") for i, c in enumerate(df.columns)]
    return _stack(df.agg(*aggs), df.columns, ["nulls"]).withColumnRenamed("nulls", "null_count")


def computed_values(df: DataFrame) -> DataFrame:
    """``result_count`` and ``<col>_mean/_sum/_min/_max`` of every numeric
    column, as (name, value) rows from one aggregate."""
    cols = numeric_columns(df)
    aggs = [F.count(F.lit(1)).cast("double").alias("result_count")]
    names = ["result_count"]
    for c in cols:
        v = clean_value(df, c).cast("double")
        for stat, fn in (("mean", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max)):
            names.append(f"{c}_{stat}")
            aggs.append(fn(v).alias(f"{len(names) - 1}__value"))
    aggs[0] = aggs[0].alias("0__value")
    return _stack(df.agg(*aggs), names, ["value"], label="name")


def frame_digest(df: DataFrame, n_columns: int = 3) -> DataFrame:
    """Rows, columns, and mean/min/max of the first ``n_columns`` numeric
    columns (one row per column)."""
    cols = numeric_columns(df)[:n_columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        v = clean_value(df, c).cast("double")
        aggs += [F.avg(v).alias(f"{i}__mean"), F.min(v).alias(f"{i}__min"), F.max(v).alias(f"{i}__max")]
    wide = df.agg(*aggs)
    if not cols:
        return wide.select("n_rows", F.lit(len(df.columns)).alias("n_columns"))
    args = ", ".join(f"'{c}', `{i}__mean`, `{i}__min`, `{i}__max`" for i, c in enumerate(cols))
    return wide.selectExpr("n_rows", f"{len(df.columns)} AS n_columns",
                           f"stack({len(cols)}, {args}) AS (`column`, `mean`, `min`, `max`)")


def frame_preview(df: DataFrame, rows: int = 3, columns: int = 6) -> DataFrame:
    """The first rows and columns, as shown beside the digest."""
    return df.select(*[q(c) for c in df.columns[:columns]]).limit(rows)


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> dict:
    """Distinct non-null values per column, one aggregate."""
    if not columns:
        return {}
    fn = (lambda c: F.approx_count_distinct(c, 0.02)) if approx else F.count_distinct
    row = df.agg(*[fn(q(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def _few_values(columns: int, most: int):
    """Task: up to ``most + 1`` distinct values of each column, as (ordinal, value)."""
    def run(batches):
        import pyarrow as pa
        found = [set() for _ in range(columns)]
        for b in batches:
            for i in range(columns):
                if len(found[i]) <= most:
                    found[i].update(b.column(i).drop_null().unique().to_pylist()[:most + 1])
        rows = [(i, v) for i, s in enumerate(found) for v in list(s)[:most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())],
                                         ["ordinal", "value"])
    return run


def few_values(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``ordinal, distinct_count`` of the columns: exact up to ``most``, and ``most + 1``
    for all that have more, in one pass: a task hands on at most ``most + 1`` values
    of a column.  A column of nulls has no row."""
    text = df.select(*[clean_value(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    found = text.mapInArrow(_few_values(len(columns), most), "ordinal int, value string")
    return found.distinct().groupBy("ordinal").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("distinct_count"))


def all_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``ordinal, distinct_count`` of the columns, exact: one pass hands on the distinct
    values of each task, and these are counted by (ordinal, value), never gathered.
    A column of nulls has no row."""
    text = F.array(*[clean_value(df, c).cast("string") for c in columns])
    found = df.select(F.posexplode(text).alias("ordinal", "value")).where("value IS NOT NULL")
    return found.distinct().groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))


def small_columns(df: DataFrame, columns: list[str], most: int) -> list[str]:
    """The columns with at most ``most`` distinct non-null values, exactly."""
    if not columns:
        return []
    gone = {r["ordinal"] for r in few_values(df, columns, most).where(F.col("distinct_count") > most).collect()}  # a row per column at most
    return [c for i, c in enumerate(columns) if i not in gone]


def pick_categorical(df: DataFrame, max_distinct: int = MAX_CATEGORIES, approx: bool = False) -> str | None:
    """First text column with ≤ ``max_distinct`` values; else the first text
    column; else any column with ≤ ``max_distinct`` values.  With
    ``approx=True`` the distinct counts are sketches."""
    texts = text_columns(df)
    cands = texts if texts else df.columns
    if approx:
        counts = distinct_counts(df, cands, approx=True)
        small = [c for c in cands if counts[c] <= max_distinct]
    else:
        small = small_columns(df, cands, max_distinct)
    return (small + texts[:1] + [None])[0]


def categorical_table(df: DataFrame, max_distinct: int = MAX_CATEGORIES, approx: bool = False) -> DataFrame:
    """Distinct counts of the candidate columns with the pick marked: ``column,
    ordinal, distinct_count, picked``.  Counts are exact; with ``approx`` they are
    sketches."""
    texts = text_columns(df)
    cands = texts if texts else df.columns
    names = df.sparkSession.createDataFrame(list(enumerate(cands)), "ordinal int, column string")
    if approx:
        wide = df.agg(*[F.approx_count_distinct(q(c)).alias(f"{i}__distinct_count") for i, c in enumerate(cands)])
        wide = wide.select(*[x for i in range(len(cands)) for x in (F.col(f"{i}__distinct_count"), F.lit(i).alias(f"{i}__ordinal"))])
        counts = _stack(wide, cands, ["distinct_count", "ordinal"]).select("ordinal", "distinct_count")
    else:
        counts = all_values(df, cands)
    long = written_once(names.join(counts, "ordinal", "left").select(
        "column", "ordinal", F.coalesce("distinct_count", F.lit(0).cast("long")).alias("distinct_count")), "distinct")
    # pick: first small one by ordinal; if none and there are text columns, ordinal 0
    first_small = long.where(F.col("distinct_count") <= max_distinct).agg(F.min("ordinal")).scalar()
    pick = F.coalesce(first_small, F.lit(0) if texts else F.lit(-1))
    return long.withColumn("picked", F.col("ordinal") == pick)
