"""Date parsing, date-like column detection and date parts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that make a column name look like a date, and the text
# layouts a text column is read with (shape pattern, Spark datetime pattern);
# the first shape that matches picks the layout.
DATE_NAME_WORDS = ("date", "time", "timestamp", "created", "updated")
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2}:\d{2}(\.\d{1,6})?)?$", "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{2}:\d{2})?$", "yyyy/MM/dd[ HH:mm:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}:\d{2})?$", "MM/dd/yyyy[ HH:mm:ss]"),
    (r"^\d{4}-\d{1,2}$", "yyyy-MM"),
)

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_date_name(name: str) -> bool:
    n = name.lower()
    return any(w in n for w in DATE_NAME_WORDS)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def parse_timestamp(c: Column) -> Column:
    """Text → timestamp_ntz; text that fits no layout gives null.

    The layout is chosen by a cheap shape test first, so only text that
    looks like that layout reaches the date parser (no parse attempt, and
    no parse failure, for the many values that are not dates at all)."""
    t = F.trim(c)
    out = None
    for shape, fmt in DATE_FORMATS:
        parsed = F.try_to_timestamp(t, F.lit(fmt))
        out = F.when(t.rlike(shape), parsed) if out is None else out.when(t.rlike(shape), parsed)
    return out.cast("timestamp_ntz")


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a timestamp, whatever its stored type."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    return parse_timestamp(c.cast("string"))


def date_part_columns(ts: Column, prefix: str) -> dict[str, Column]:
    """``<c>_year, _month, _day, _week (ISO), _quarter, _ym``."""
    return {
        f"{prefix}_year": F.year(ts),
        f"{prefix}_month": F.month(ts),
        f"{prefix}_day": F.dayofmonth(ts),
        f"{prefix}_week": F.weekofyear(ts),
        f"{prefix}_quarter": F.quarter(ts),
        f"{prefix}_ym": F.date_format(ts, "yyyy-MM"),
    }


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_text(ts: Column) -> Column:
    return F.year(ts).cast("string")


def quarter_text(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def candidate_date_columns(df: DataFrame) -> list[str]:
    """Columns whose name or type says date: the ones the period
    extractions look at, in table order."""
    out = []
    for f in df.schema.fields:
        if is_datetime_type(f.dataType) or (
                is_date_name(f.name) and isinstance(f.dataType, (T.StringType, *DATETIME_TYPES))):
            out.append(f.name)
    return out


def detect_date_columns(df: DataFrame, threshold: float = 0.6,
                        strict_greater: bool = True) -> list[str]:
    """Columns to treat as dates.

    A column counts when it already has a date type, when its name is
    date-like and it holds text, or when it holds text and more than
    ``threshold`` of all rows parse.  The parse ratios of all text columns
    come from **one** aggregate pass (one scan, partial aggregation per
    task); nothing else is read.
    """
    decided, probe = [], []
    for f in df.schema.fields:
        if is_datetime_type(f.dataType):
            decided.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            if is_date_name(f.name):
                decided.append(f.name)
            else:
                probe.append(f.name)
    ratios = {}
    if probe:
        row = df.agg(*[
            F.avg(F.when(parse_timestamp(F.col(f"`{c}`")).isNotNull(), 1.0).otherwise(0.0)).alias(c)
            for c in probe
        ]).first()
        ratios = row.asDict() if row is not None else {}
    chosen = set(decided)
    for c in probe:
        r = ratios.get(c)
        if r is not None and (r > threshold if strict_greater else r >= threshold):
            chosen.add(c)
    return [f.name for f in df.schema.fields if f.name in chosen]


def parse_ratio(df: DataFrame, name: str, weight: str | None = None) -> float:
    """Share of all rows of text column ``name`` that parse (one aggregate);
    ``weight`` is a column of row counts, if a row stands for several."""
    parsed = parse_timestamp(F.col(f"`{name}`"))
    w = F.col(weight) if weight else F.lit(1)
    r = df.agg(F.try_divide(F.sum(F.when(parsed.isNotNull(), w).otherwise(0)), F.sum(w))).first()[0]
    return float(r or 0.0)


def coerce_if_dates(df: DataFrame, name: str, threshold: float = 0.5, weight: str | None = None) -> tuple[DataFrame, bool]:
    """Chart axis rule: a text column becomes a timestamp when at least
    ``threshold`` of its rows parse.  The decision fixes the output type, so
    it is taken once, from one small aggregate, before the plan is built."""
    dt = df.schema[name].dataType
    if is_datetime_type(dt):
        return df.withColumn(name, as_timestamp(df, name)), True
    if not isinstance(dt, T.StringType):
        return df, False
    if parse_ratio(df, name, weight) >= threshold:
        return df.withColumn(name, parse_timestamp(F.col(f"`{name}`"))), True
    return df, False
