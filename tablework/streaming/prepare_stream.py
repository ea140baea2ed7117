"""The prepare operations on a streaming DataFrame.

Filters, renames, ratios, date parsing and period columns are per-row
expressions, so the same op list that prepares a table prepares a stream
(``readStream`` → ops → ``writeStream``).  Date detection needs an action,
so stream callers name their date columns; de-duplication needs a
watermark; sorting a stream is refused.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tablework.operators.prepare import Prepared, PrepareError, auto_dates, operation

STATELESS = ("filter", "parse_dates", "drop_na", "rename", "calculate",
             "extract_month", "extract_year", "extract_quarter")


def read_stream(spark: SparkSession, directory: str, schema, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving in ``directory`` (optionally only names matching ``glob``)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(directory)


def prepare_stream(df: DataFrame, ops: list[str], date_columns: list[str] | None = None,
                   watermark: tuple[str, str] | None = None, strict: bool = False) -> Prepared:
    if not df.isStreaming:
        raise PrepareError("prepare_stream needs a streaming DataFrame")
    warnings: list[str] = []
    found: list[str] = []
    if date_columns:
        df, found = auto_dates(df, date_columns)
    steps = []
    for op in ops:
        head = op.split(":", 1)[0].strip()
        if head.startswith("remove_duplicates"):
            if watermark is None:
                raise PrepareError("remove_duplicates on a stream needs a watermark (column, delay)")
            col, delay = watermark
            steps.append(lambda d, c=col, t=delay: d.withWatermark(c, t).dropDuplicatesWithinWatermark())
            continue
        if not any(head.startswith(s) for s in STATELESS):
            raise PrepareError(f"Operation not supported on a stream: {op}")
        steps.append(operation(op, strict, warnings))
    out = functools.reduce(lambda acc, fn: acc.transform(fn), steps, df)
    return Prepared(out, warnings, found)
