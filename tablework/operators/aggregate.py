"""Grouped and global aggregation with derived top-k, bottom-k and extrema.

Every metric is one aggregate expression in a single ``groupBy().agg()``:
Spark runs a partial (map-side) hash aggregate per task, shuffles one row
per key and task, and merges.  A key holding a third of all rows costs one
partial row per task, so skew does not reach the shuffle.

Top-k and bottom-k are rank limits: each task keeps k rows per metric before
the shuffle (no global sort).  Ties go to the lowest group keys, nulls last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.metrics import Metric, parse_metrics
from tablework.session import written_once
from tablework.sources.scan import nan_to_null


class AggregateError(ValueError):
    pass


@dataclass
class AggResult:
    df: DataFrame
    group_by: list
    metrics: list
    metadata: dict = field(default_factory=dict)


def _key(c: str) -> Column:
    return F.col(f"`{c}`")


def aggregate(df: DataFrame, group_by: list[str] | None, metrics: list[str]) -> AggResult:
    """Keys then metrics; null keys kept; ascending by the first key, nulls
    last.  NaN counts as missing.

    Medians and percentiles, alone or inside an expression, come from exact
    positions (grouped: ``ordinal.grouped_quantiles``; global:
    ``quantiles.exact_quantiles``), which cut any group across tasks; the other
    aggregates of the metrics are one partial aggregation."""
    keys = [g.strip() for g in (group_by or [])]
    for g in keys:
        if g not in df.columns:
            raise AggregateError(f"No column {g!r} to group by")
    parsed: list[Metric] = parse_metrics(metrics, df)
    df = nan_to_null(df)
    plain = [m.column for m in parsed if not m.parts]
    plain += [F.expr(p.body).alias(p.name) for m in parsed for p in m.parts if p.share is None]
    placed: dict[str, list] = {}  # order statistics by the value they are of
    for p in (p for m in parsed for p in m.parts if p.share is not None):
        placed.setdefault(p.body, []).append(p)
    if keys:
        held = {f"__k{i}": _key(k) for i, k in enumerate(keys)}
        df = df.withColumns(held)
        out = df.groupBy(*held).agg(*plain) if plain else df.select(*held).distinct()
        if placed:
            q = _order_statistics(df, list(held), placed).alias("q")
            o = out.alias("o")
            same = [F.col(f"o.{h}").eqNullSafe(F.col(f"q.{h}")) for h in held]
            out = o.join(q, on=same, how="left").select("o.*", *[F.col(f"q.{p.name}") for parts in placed.values() for p in parts])
        out = out.withColumnsRenamed(dict(zip(held, keys)))
        out = out.select(*[_key(k) for k in keys], *[m.column if m.parts else _key(m.alias) for m in parsed])
        out = out.orderBy(_key(keys[0]).asc_nulls_last())
    else:
        out = df.agg(*plain) if plain else df.sparkSession.range(1).select()
        for n, (body, parts) in enumerate(placed.items()):
            from tablework.operators.quantiles import exact_quantiles
            shares = [p.share for p in parts]
            found = exact_quantiles(df.select(F.expr(body).cast("double").alias("v")), ["v"], shares)["v"]
            out = out.withColumns({p.name: F.lit(v).cast("double") for p, v in zip(parts, found)})
        out = out.select(*[m.column if m.parts else _key(m.alias) for m in parsed])
    aliases = [m.alias for m in parsed]
    numeric = [f.name for f in out.schema.fields
               if f.name in aliases and isinstance(f.dataType, T.NumericType)]
    meta = {"is_aggregate": True, "group_by": keys, "metrics": numeric}
    return AggResult(out, keys, numeric, meta)


def _order_statistics(df: DataFrame, keys: list[str], placed: dict[str, list]) -> DataFrame:
    """``keys`` and the order statistics of all value expressions, from one sort of
    (keys, expression, value)."""
    from tablework.operators.ordinal import grouped_quantiles
    shares = sorted({p.share for parts in placed.values() for p in parts})
    values = [F.struct(F.lit(i).alias("__w"), F.expr(body).cast("double").alias("__v")) for i, body in enumerate(placed)]
    rows = df.select(*keys, F.inline(F.array(*values)))
    found = grouped_quantiles(rows, [*keys, "__w"], F.col("__v"), shares, [f"__p{j}" for j in range(len(shares))])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__w") == i, F.col(f"__p{shares.index(p.share)}"))).alias(p.name)
                                      for i, parts in enumerate(placed.values()) for p in parts])


def _tie_order(keys: list[str]) -> list[Column]:
    return [_key(k).asc_nulls_last() for k in keys]


def _number(c: str) -> Column:
    """A value as a double, NaN as null."""
    v = _key(c).cast("double")
    return F.when(~F.isnan(v), v)


def top_k(agg: DataFrame, keys: list[str], metrics: list[str], k: int = 5,
          largest: bool = True) -> DataFrame:
    """Long form ``metric, rank, <keys>, value``: the k largest (or smallest)
    result rows per metric.  Bottom-k skips null values.

    ``agg`` is read once: its rows are spread into a row per metric, and the
    rank limit keeps k rows per metric and task before the shuffle."""
    spread = agg.select(*[_key(x) for x in keys], F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), _number(m).alias("value")) for m in metrics])).alias("m"))
    spread = spread.select("m.metric", *[_key(x) for x in keys], "m.value")
    if not largest:
        spread = spread.where("value IS NOT NULL")
    value = F.col("value")
    w = Window.partitionBy("metric").orderBy(value.desc_nulls_last() if largest else value.asc(), *_tie_order(keys))
    return spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bottom_k(agg: DataFrame, keys: list[str], metrics: list[str], k: int = 5) -> DataFrame:
    return top_k(agg, keys, metrics, k, largest=False)


def _arg_struct(value: Column, keys: list[str], largest: bool) -> Column:
    """``struct(±v, key null flags, keys)``: its minimum is the row with the
    largest (smallest) value, ties to the lowest keys with nulls last."""
    parts = [(-value if largest else value).alias("v")]
    for i, k in enumerate(keys):
        parts.append(_key(k).isNull().alias(f"n{i}"))
        parts.append(_key(k).alias(f"k{i}"))
    return F.struct(*parts)


def extrema(agg: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric: ``max_value``, ``min_value`` and the keys of the
    rows holding them (``max_<key>``, ``min_<key>``).  All metrics in one
    aggregate pass (null values skipped), then one small row per metric."""
    cols = []
    for i, m in enumerate(metrics):
        v = _number(m)
        cols.append(F.min(F.when(v.isNotNull(), _arg_struct(v, keys, True))).alias(f"hi{i}"))
        cols.append(F.min(F.when(v.isNotNull(), _arg_struct(v, keys, False))).alias(f"lo{i}"))
    facts = []
    for i, m in enumerate(metrics):
        facts.append(F.struct(F.lit(m).alias("metric"), (-F.col(f"hi{i}.v")).alias("max_value"), F.col(f"lo{i}.v").alias("min_value"),
                              *[F.col(f"{side}{i}.k{j}").alias(f"{name}_{k}") for j, k in enumerate(keys)
                                for side, name in (("hi", "max"), ("lo", "min"))]))
    return agg.agg(*cols).select(F.inline(F.array(*facts)))


def share_of_total(agg: DataFrame, value: str, pct_name: str = "share_pct") -> DataFrame:
    """``value / total × 100`` per row.  The total is an uncorrelated scalar
    sub-query: computed once, then a constant in every task (no join, no
    single-partition window)."""
    agg = nan_to_null(agg)
    total = agg.agg(F.sum(F.col(f"`{value}`"))).scalar()
    return agg.withColumn(pct_name, F.try_divide(F.col(f"`{value}`"), total) * F.lit(100.0))


def top_n_sum(df: DataFrame, x: str, y: str, n: int = 30) -> DataFrame:
    """Group by ``x``, sum ``y``, largest first, at most ``n`` groups.  Null
    ``x`` is dropped (chart grouping)."""
    return (nan_to_null(df.select(_key(x), _key(y))).where(_key(x).isNotNull())
              .groupBy(_key(x)).agg(F.sum(_key(y)).alias(y))
              .orderBy(F.col(f"`{y}`").desc_nulls_last(), _key(x).asc())
              .limit(n))


def period_aggregate(df: DataFrame, period: str, metrics: list[str]) -> AggResult:
    """Month, quarter or year text of the first date column, then grouped."""
    from tablework.operators.prepare import extract_period
    return aggregate(extract_period(df, period), [period], metrics)


def aggregate_dict(df: DataFrame, group_by: list[str], spec: dict) -> DataFrame:
    """``groupby().agg({col: fn})`` form; names as Spark gives them
    (``sum(x)``), as in notebooks."""
    return df.groupBy(*group_by).agg(spec)


@dataclass
class AggReport:
    """An aggregate with the facts derived from it (all lazy DataFrames)."""
    result: AggResult
    topk: DataFrame
    bottomk: DataFrame
    extrema: DataFrame
    computed_values: DataFrame


def aggregate_report(df: DataFrame, group_by: list[str] | None, metrics: list[str], k: int = 5) -> AggReport:
    """``aggregate`` plus top-k, bottom-k, extrema of every numeric metric and
    the grounding statistics of the result.

    The aggregate is written once to the shared folder and every derived frame
    reads that table, so the input is read once."""
    from tablework.operators.profile import computed_values
    res = aggregate(df, group_by, metrics)
    written = written_once(res.df, "report")
    order = [_key(res.group_by[0]).asc_nulls_last()] if res.group_by else []
    res = AggResult(written.orderBy(*order) if order else written, res.group_by, res.metrics, res.metadata)
    if res.metrics:
        tk, bk = top_k(res.df, res.group_by, res.metrics, k), bottom_k(res.df, res.group_by, res.metrics, k)
        ex = extrema(res.df, res.group_by, res.metrics)
    else:
        empty = df.sparkSession.createDataFrame([], "metric string, value double")
        tk = bk = ex = empty
    return AggReport(res, tk, bk, ex, computed_values(res.df))
