"""Metric text → aggregate ``Column`` with a stable alias.

``sum(x)`` → ``sum_x``; ``count(*)``/``count(1)`` → ``count_all``;
``<expr> AS name`` → ``name``; any other text → ``metric_<n>``.

A metric with a ``median`` or ``percentile`` anywhere is split: every aggregate
call in it becomes a part of its own, the order statistics with their value and
share, and what is left is an expression over the parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregate function names understood by the metric parser,
# and the names that differ in Spark.
AGG_FUNCS = ("sum", "avg", "count", "min", "max", "median", "stddev", "std", "var", "variance")
SPARK_NAMES = {
    "std": "stddev_samp",
    "stddev": "stddev_samp",
    "var": "var_samp",
    "variance": "var_samp",
    "mean": "avg",
}
# Name prefixes that mark a metric column (picked first).
METRIC_PREFIXES = ("sum_", "avg_", "mean_", "count_", "min_", "max_", "median_", "std_", "var_", "metric_")

#: Order statistics that come from exact positions; a share is given beside the value, but for the median.
ORDER_STATISTICS = ("median", "percentile", "quantile", "quantile_cont", "percentile_cont")
#: Aggregate calls that may stand beside them in one metric.
BESIDE = (*AGG_FUNCS, *ORDER_STATISTICS, "mean", "any_value", "first", "last", "max_by", "min_by", "mode", "count_if", "bool_and", "bool_or",
          "every", "some", "any", "stddev_samp", "stddev_pop", "var_samp", "var_pop", "skewness", "kurtosis", "corr", "covar_samp", "covar_pop",
          "regr_slope", "regr_intercept", "regr_r2", "approx_count_distinct", "approx_percentile", "percentile_approx", "collect_list",
          "collect_set", "array_agg", "try_sum", "try_avg", "bit_and", "bit_or", "bit_xor", "product", "listagg", "string_agg")

_PIECE = re.compile(r"""'[^']*'|"[^"]*"|`[^`]*`|[()]|[^\s'"`()]+|\s+""")
_NAME = re.compile(r"[A-Za-z_]\w*")


class MetricError(ValueError):
    pass


@dataclass(frozen=True)
class Part:
    """One aggregate call of a split metric; ``share`` is set for an order
    statistic, whose value is the expression ``body``."""
    name: str
    body: str
    share: float | None = None


@dataclass
class Metric:
    text: str
    alias: str
    column: Column
    source_column: str | None
    parts: list = field(default_factory=list)


def _named(text: str) -> tuple[str, str | None]:
    """(expression, alias) at the last AS outside brackets and quotes; alias None if there is none."""
    depth, at, end, cut = 0, 0, None, None
    for piece in _PIECE.findall(text):
        depth += (piece == "(") - (piece == ")")
        if depth == 0 and piece.lower() == "as":
            cut, end = at, at + len(piece)
        at += len(piece)
    if cut is None or not text[:cut].strip() or not text[end:].strip():
        return text.strip(), None
    return text[:cut].strip(), text[end:].strip().strip('"`')


def _call(text: str) -> tuple[str, str] | None:
    """(function, argument) if the whole text is one call."""
    name, bracket, rest = text.partition("(")
    if not bracket or not _NAME.fullmatch(name.strip()) or not rest.endswith(")"):
        return None
    depth = 1
    for piece in _PIECE.findall(rest[:-1]):
        depth += (piece == "(") - (piece == ")")
        if depth == 0:  # the first bracket closes before the end
            return None
    return name.strip(), rest[:-1].strip()


def _close(pieces: list[str], at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(pieces)):
        depth += (pieces[i] == "(") - (pieces[i] == ")")
        if not depth:
            return i
    raise MetricError(f"A bracket is open in {''.join(pieces)!r}")


def _arguments(pieces: list[str]) -> list[str]:
    """Arguments of a call, cut at the commas outside brackets and quotes."""
    out, depth = [""], 0
    for piece in pieces:
        depth += (piece == "(") - (piece == ")")
        if depth or piece[0] in "'\"`":
            out[-1] += piece
        else:
            first, *more = piece.split(",")
            out[-1] += first
            out += more
    return [a.strip() for a in out]


def _order_statistic(name: str, args: list[str]) -> tuple[str, float] | None:
    """(value, share) of a call that exact positions can answer."""
    if args[0].lower().startswith(("distinct ", "all ")):
        return None
    if name == "median" and len(args) == 1:
        return args[0], 0.5
    if name != "median" and len(args) == 2 and re.fullmatch(r"\d*\.?\d+", args[1]) and float(args[1]) <= 1:
        return args[0], float(args[1])
    return None


def split_calls(text: str, prefix: str) -> tuple[str, list[Part]] | None:
    """The expression over ``<prefix>0``, ``<prefix>1``, ... and the aggregate calls
    that these stand for; None if ``text`` has no order statistic to take out."""
    pieces, out, parts, i = _PIECE.findall(text), [], [], 0
    while i < len(pieces):
        word = re.search(r"[A-Za-z_]\w*$", pieces[i]) if pieces[i][0] not in "'\"`" else None
        name = word.group().lower() if word else ""
        opens = i + 1 + (i + 1 < len(pieces) and pieces[i + 1].isspace())
        if name not in BESIDE or opens >= len(pieces) or pieces[opens] != "(":
            out.append(pieces[i])
            i += 1
            continue
        end = _close(pieces, opens)
        args = _arguments(pieces[opens + 1:end])
        after = [k for k in range(end + 1, len(pieces)) if not pieces[k].isspace()][:2]
        where = None
        if len(after) == 2 and pieces[after[0]].lower() == "filter" and pieces[after[1]] == "(":
            end = _close(pieces, after[1])
            where = re.sub(r"^\s*where\s", "", "".join(pieces[after[1] + 1:end]), flags=re.IGNORECASE)
        elif after and pieces[after[0]].lower() in ("over", "within"):
            return None
        found = _order_statistic(name, args) if name in ORDER_STATISTICS else None
        part = f"{prefix}{len(parts)}"
        if found is not None:
            value = found[0] if where is None else f"CASE WHEN {where} THEN {found[0]} END"
            parts.append(Part(part, value, found[1]))
        else:
            body = f"{SPARK_NAMES.get(name, name)}({''.join(pieces[opens + 1:end if where is None else _close(pieces, opens)])})"
            parts.append(Part(part, body if where is None else f"{body} FILTER (WHERE {where})"))
        out.append(pieces[i][:word.start()] + part)
        i = end + 1
    if all(p.share is None for p in parts):
        return None
    return "".join(out), parts


def _metric(text: str, known: list[str] | None, bare: int, number: int = 0) -> Metric:
    body, alias = _named(text)
    call = _call(body)
    split = split_calls(body, f"__m{number}_")
    if split is not None and call is None:
        alias = alias or f"metric_{bare}"
        return Metric(text, alias, F.expr(split[0]).alias(alias), None, split[1])
    if call is None:
        alias = alias or f"metric_{bare}"
        return Metric(text, alias, F.expr(body).alias(alias), None)
    func, arg = call[0].lower(), call[1]
    spark = SPARK_NAMES.get(func, func)
    if arg in ("*", "1"):
        alias = alias or f"{func}_all"
        return Metric(text, alias, F.expr(f"{spark}({arg})").alias(alias), None)
    col = arg.strip("\"'`")
    if known is not None and col not in known and _NAME.fullmatch(col) and arg[0] != "'":
        raise MetricError(f"No column {col!r} for metric {text!r}")
    if _NAME.fullmatch(col) or col in (known or []):
        alias = alias or f"{func}_{col}"
        if split is not None:  # the column's name in quotes, whatever is in it
            one = Part(split[1][0].name, f"`{col}`", split[1][0].share)
            return Metric(text, alias, F.expr(split[0]).alias(alias), col, [one])
        return Metric(text, alias, F.expr(f"{spark}(`{col}`)").alias(alias), col)
    # an expression argument: count(distinct x), sum(a * b), sum(cast(x as double))
    alias = alias or f"{func}_" + re.sub(r"\W+", "_", arg).strip("_")
    if split is not None:
        return Metric(text, alias, F.expr(split[0]).alias(alias), None, split[1])
    return Metric(text, alias, F.expr(f"{spark}({arg})").alias(alias), None)


def parse_metrics(texts: list[str], df: DataFrame | None = None) -> list[Metric]:
    """One metric per text; texts without call and alias are numbered."""
    if not texts:
        raise MetricError("An aggregate has one metric or more")
    known, bare, out = df.columns if df is not None else None, 0, []
    for number, text in enumerate(t.strip() for t in texts):
        body, alias = _named(text)
        bare += alias is None and _call(body) is None
        out.append(_metric(text, known, bare, number))
    return out


def looks_aggregate(sql: Column | str) -> Column:
    """Flag over a text column: has `` group by `` or an aggregate call."""
    c = F.lower(sql if isinstance(sql, Column) else F.col(sql))
    return c.contains(" group by ") | c.rlike(r"\b(" + "|".join(AGG_FUNCS) + r")\s*\(")


def metric_columns(df: DataFrame, group_by: list[str]) -> list[str]:
    """Numeric, not a key; names with an aggregate prefix first, order kept."""
    from pyspark.sql import types as T
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in group_by]
    return sorted(num, key=lambda c: 0 if c.lower().startswith(METRIC_PREFIXES) else 1)
