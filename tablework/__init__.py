"""Tablework: table analysis as Spark DataFrame operations.

Main entry points (all return DataFrames or small result records)::

    from tablework import get_spark, prepare_data, aggregate, aggregate_report
    from tablework import filter_condition, preflight, summary_facts, run_sql
"""

from tablework.functions.filters import apply_filter, filter_condition
from tablework.operators.aggregate import aggregate, aggregate_report, bottom_k, extrema, share_of_total, top_k
from tablework.operators.facts import summary_facts
from tablework.operators.opensql import asof_join, range_join, run_sql
from tablework.operators.prepare import prepare_data
from tablework.operators.profile import computed_values, describe_numeric, inspect_schema, null_counts
from tablework.operators.quality import outlier_table, preflight, validate_schema
from tablework.session import get_spark

__all__ = [
    "aggregate", "aggregate_report", "apply_filter", "asof_join", "bottom_k", "computed_values",
    "describe_numeric", "extrema", "filter_condition", "get_spark", "inspect_schema", "null_counts",
    "outlier_table", "preflight", "prepare_data", "range_join", "run_sql", "share_of_total",
    "summary_facts", "top_k", "validate_schema",
]
