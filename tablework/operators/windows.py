"""Window columns over keys of any size.

A Spark window gathers a whole key in one task, which is right for keys that fit
one.  Keys are counted first, and those of more than ``HOT_ROWS`` rows go another
way: their rows are range-sorted by (key, order, row identity), so a hot key is
cut across tasks, and written once.
Windows then run inside (partition, key) only, and what a key needs from other
partitions is carried:

* running state (positions, dense ranks, running aggregates): every partition
  offers the state of its last key and asks for that of its first; a scan over
  one row per partition answers;
* ranks: rows that tie across a border take the position of the first of them;
* neighbours (lag, lead, frames of rows): a halo of the few rows before and after
  a partition is copied into it, and Spark's own window runs over both;
* group sizes (ntile, percent rank): the sizes of a key's pieces, summed to both
  sides of a partition.

Tables that are joined to the rows have a row or a few per partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.session import written_once

#: Rows of a key that one task may hold.
HOT_ROWS = 200_000
_START, _HERE = Window.unboundedPreceding, Window.currentRow


@dataclass(frozen=True)
class Over:
    """One window column: what it is, of which column, over which rows."""
    kind: str
    col: Column | None = None
    agg: Callable | None = None
    before: int = 0
    after: int = 0
    n: int = 0


def row_number() -> Over:
    return Over("row_number")


def rank() -> Over:
    return Over("rank")


def dense_rank() -> Over:
    return Over("dense_rank")


def percent_rank() -> Over:
    """(rank - 1) / (rows of the key - 1); 0 for a single row."""
    return Over("percent_rank")


def ntile(n: int) -> Over:
    return Over("ntile", n=n)


def group_rows() -> Over:
    """Rows of the key."""
    return Over("group_rows")


def first_value(col: Column) -> Over:
    return Over("first", col)


def running(agg: str, col: Column) -> Over:
    """``sum``, ``count``, ``min`` or ``max`` of the key's rows up to this one."""
    if agg not in _MERGE:
        raise ValueError(f"No running {agg}")
    return Over("running", col, _MERGE[agg][0], n=list(_MERGE).index(agg))


def rows_between(agg: Callable, col: Column, before: int, after: int = 0) -> Over:
    """An aggregate over ``before`` rows before to ``after`` rows after this one."""
    return Over("frame", col, agg, before, after)


def lag(col: Column, n: int = 1) -> Over:
    return Over("lag", col, before=n, n=n)


def lead(col: Column, n: int = 1) -> Over:
    return Over("lead", col, after=n, n=n)


#: running aggregate: (of rows, of the states of earlier partitions, of carried state and own)
_MERGE = {
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")])


def _sorted(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], parts: int | None) -> DataFrame:
    """Rows tagged with ``__k`` (key), ``__o`` (order values), ``__id`` (rising in sort order) and ``__part``."""
    tagged = df.withColumns({"__k": _key(keys), "__o": F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, (c, _) in enumerate(order)]),
                             "__tie": F.monotonically_increasing_id()})
    by = [F.col("__k"), *_by(order), F.col("__tie")]
    out = tagged.orderBy(*by) if parts is None else tagged.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return out.drop("__tie").withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))


def _by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"__o.o{i}").asc_nulls_first() if up else F.col(f"__o.o{i}").desc_nulls_last() for i, (_, up) in enumerate(order)]


def _spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Whole partitions of the sort dealt evenly, each to one task, for windows inside them."""
    return df.repartitionByRange("__part") if parts is None else df.repartitionByRange(parts, "__part")


def _carry(ends: DataFrame, runs: dict[str, str]) -> DataFrame:
    """What enters each partition (one row each): for its first key the rows
    before, dense ranks before, rank of a tie that goes on, first values and
    running states; for its last key the rows after."""
    line = Window.orderBy("__part")  # one row per partition
    ends = ends.withColumn("on", (F.lag("tail.o").over(line).eqNullSafe(F.col("head.o"))
                                  & F.lag("tail.k").over(line).eqNullSafe(F.col("head.k")) & (F.lag("__part").over(line).isNotNull())).cast("int"))
    one_key = F.col("head.k").eqNullSafe(F.col("tail.k"))
    asks = ends.select("__part", F.col("head.k").alias("k"), F.lit(0).alias("offer"))
    offers = ends.select("__part", F.col("tail.k").alias("k"), F.lit(1).alias("offer"), F.col("tail.n").alias("n"),
                         (F.col("tail.d") - F.when(one_key, F.col("on")).otherwise(0)).alias("d"),
                         *[F.col(f"tail.{r}").alias(r) for r in runs])
    before = Window.partitionBy("k").orderBy("__part", "offer").rowsBetween(_START, -1)
    told = asks.unionByName(offers, allowMissingColumns=True)
    how = {name: F.first(name, ignorenulls=True) if agg == "first" else _MERGE[agg][1](name) for name, agg in runs.items()}
    told = told.select("__part", "offer", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_in") for c in ("n", "d")],
                       *[c.over(before).alias(f"{name}_in") for name, c in how.items()])
    enters = told.where("offer = 0").drop("offer")

    asks = ends.select("__part", F.col("tail.k").alias("k"), F.lit(0).alias("offer"))
    offers = ends.select("__part", F.col("head.k").alias("k"), F.lit(1).alias("offer"), F.col("head.c").alias("c"))
    later = Window.partitionBy("k").orderBy(F.desc("__part"), "offer").rowsBetween(_START, -1)
    follows = asks.unionByName(offers, allowMissingColumns=True).select(
        "__part", "offer", F.coalesce(F.sum("c").over(later), F.lit(0)).alias("c_after")).where("offer = 0").drop("offer")

    out = ends.join(enters, "__part").join(follows, "__part")
    # a run of ties has the position of its first row, wherever that lies
    heads = out.select(F.col("head.k").alias("k"), F.col("head.o").alias("o"), (F.col("n_in") + 1).alias("at"))
    tails = out.select(F.col("tail.k").alias("k"), F.col("tail.o").alias("o"),
                       (F.col("tail.r") + F.when(one_key, F.col("n_in")).otherwise(0)).alias("at"))
    ties = heads.union(tails).groupBy("k", "o").agg(F.min("at").alias("rank_in"))
    h, t = out.alias("h"), ties.alias("t")
    same = F.col("h.head.k").eqNullSafe(F.col("t.k")) & F.col("h.head.o").eqNullSafe(F.col("t.o"))
    return h.join(t, same).select("h.*", "t.rank_in")


def _plain(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], columns: dict[str, Over]) -> DataFrame:
    """Window columns by Spark's own windows: a key in one task."""
    by = [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in order]
    group = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    w = group.orderBy(*by)
    step = w.rowsBetween(_START, _HERE)
    make = {"row_number": lambda o: F.row_number().over(w), "rank": lambda o: F.rank().over(w), "dense_rank": lambda o: F.dense_rank().over(w),
            "percent_rank": lambda o: F.percent_rank().over(w), "ntile": lambda o: F.ntile(o.n).over(w),
            "group_rows": lambda o: F.count(F.lit(1)).over(group), "first": lambda o: F.first(o.col).over(step),
            "running": lambda o: o.agg(o.col).over(step), "frame": lambda o: o.agg(o.col).over(w.rowsBetween(-o.before, o.after)),
            "lag": lambda o: F.lag(o.col, o.n).over(w), "lead": lambda o: F.lead(o.col, o.n).over(w)}
    made = [make[o.kind](o).alias(n) for n, o in columns.items()]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *made)


def window_columns(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], columns: dict[str, Over],
                   parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with window columns over ``keys`` in ``order`` ((column, ascending),
    nulls as in Spark: first when ascending, last when descending).

    Rows that tie in ``order`` come in one fixed but arbitrary order.  Without
    keys the whole table is one group.  Null keys are a group.  Keys of more than
    ``hot_rows`` rows are cut across tasks; ``parts`` is the number of their sorted
    partitions (default: the session's)."""
    if not keys or hot_rows <= 0:
        return _carried(df, keys, order, columns, parts)
    named = [F.col(f"`{k}`") for k in keys]
    hot = df.groupBy(*named).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    hot = written_once(hot.select(*[k.alias(f"h{i}") for i, k in enumerate(named)]), "hot")  # no more than the table's rows / hot_rows
    if hot.isEmpty():
        return _plain(df, keys, order, columns)
    same = F.lit(True)
    for i, k in enumerate(named):
        same &= k.eqNullSafe(hot[f"h{i}"])
    cool = _plain(df.join(hot, same, "left_anti"), keys, order, columns)
    return cool.union(_carried(df.join(hot, same, "left_semi"), keys, order, columns, parts))


def _carried(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], columns: dict[str, Over], parts: int | None) -> DataFrame:
    """Window columns from sorted partitions and what is carried between them."""
    rows = df.columns
    put = {f"__v{i}": o.col for i, o in enumerate(columns.values()) if o.col is not None}
    place = {name: i for i, name in enumerate(columns)}
    base = _sorted(df.withColumns(put) if put else df, keys, order, parts)
    inside = Window.partitionBy("__part", "__k")
    step = inside.orderBy("__id").rowsBetween(_START, _HERE)
    peers = inside.orderBy(*_by(order))
    local = {"__n": F.row_number().over(inside.orderBy("__id")), "__r": F.rank().over(peers), "__d": F.dense_rank().over(peers),
             "__c": F.count(F.lit(1)).over(inside)}
    runs: dict[str, str] = {}
    for name, o in columns.items():
        i = place[name]
        if o.kind == "running":
            local[f"__s{i}"] = o.agg(f"__v{i}").over(step)
            runs[f"__s{i}"] = list(_MERGE)[o.n]
        elif o.kind == "first":  # boxed, so that a first value that is null is told from none
            local[f"__s{i}"] = F.struct(F.first(f"__v{i}").over(step).alias("v"))
            runs[f"__s{i}"] = "first"
    u = written_once(_spread(base, parts).withColumns(local), "sorted")

    def end(*extra):
        return F.struct(F.col("__k").alias("k"), F.col("__o").alias("o"), F.col("__n").alias("n"), F.col("__d").alias("d"), F.col("__r").alias("r"),
                        F.col("__c").alias("c"), *extra)
    ends = written_once(u.groupBy("__part").agg(F.min_by(end(), "__id").alias("head"), F.max_by(end(*runs), "__id").alias("tail")), "ends")
    carried = written_once(_carry(ends, runs), "carry")
    c = carried.select("__part", F.col("head.k").alias("__hk"), F.col("head.o").alias("__ho"), F.col("tail.k").alias("__tk"), F.col("tail.n").alias("__tn"),
                       F.col("n_in").alias("__n_in"), F.col("d_in").alias("__d_in"), F.col("on").alias("__on"), F.col("rank_in").alias("__rank_in"),
                       F.col("c_after").alias("__after"), *[F.col(f"{r}_in").alias(f"{r}_in") for r in runs])
    u = u.join(F.broadcast(c), "__part")  # a row per partition
    head, tail = F.col("__k").eqNullSafe(F.col("__hk")), F.col("__k").eqNullSafe(F.col("__tk"))
    at = F.col("__n") + F.when(head, F.col("__n_in")).otherwise(0)
    ranked = F.when(head & F.col("__o").eqNullSafe(F.col("__ho")), F.col("__rank_in")).otherwise(
        F.col("__r") + F.when(head, F.col("__n_in")).otherwise(0))
    size = F.col("__c") + F.when(head, F.col("__n_in")).otherwise(0) + F.when(tail, F.col("__after")).otherwise(0)
    u = u.withColumns({"__at": at, "__rank": ranked, "__size": size, "__head": head, "__tail": tail})

    made: dict[str, Column] = {}
    for name, o in columns.items():
        state = f"__s{place[name]}"
        if o.kind == "row_number":
            made[name] = F.col("__at").cast("int")
        elif o.kind == "rank":
            made[name] = F.col("__rank").cast("int")
        elif o.kind == "dense_rank":
            made[name] = (F.col("__d") + F.when(F.col("__head"), F.col("__d_in") - F.col("__on")).otherwise(0)).cast("int")
        elif o.kind == "percent_rank":
            made[name] = F.when(F.col("__size") > 1, (F.col("__rank") - 1) / (F.col("__size") - 1).cast("double")).otherwise(F.lit(0.0))
        elif o.kind == "group_rows":
            made[name] = F.col("__size")
        elif o.kind == "ntile":
            least, more = F.floor(F.col("__size") / o.n), F.col("__size") % o.n
            wide = more * (least + 1)  # rows in the larger tiles, which come first
            made[name] = F.when(F.col("__at") <= wide, F.ceil(F.col("__at") / (least + 1))).otherwise(
                more + F.ceil(F.try_divide(F.col("__at") - wide, least))).cast("int")
        elif o.kind == "first":
            made[name] = F.when(F.col("__head"), F.coalesce(F.col(f"{state}_in"), F.col(state))).otherwise(F.col(state))["v"]
        elif o.kind == "running":
            merge = list(_MERGE.values())[o.n][2]
            made[name] = F.when(F.col("__head"), merge(F.col(f"{state}_in"), F.col(state))).otherwise(F.col(state))
    back = max([o.before for o in columns.values()], default=0)
    ahead = max([o.after for o in columns.values()], default=0)
    if back or ahead:
        u = u.withColumns(made)
        near = _halo(u, list(put), carried, back, ahead)
        inner = Window.partitionBy("__part", "__k").orderBy("__at")
        frames = {}
        for name, o in columns.items():
            v = F.col(f"__v{place[name]}")
            if o.kind == "lag":
                frames[name] = F.lag(v, o.n).over(inner)
            elif o.kind == "lead":
                frames[name] = F.lead(v, o.n).over(inner)
            elif o.kind == "frame":
                frames[name] = o.agg(v).over(inner.rowsBetween(-o.before, o.after))
        u = u.withColumn("__copy", F.lit(False)).unionByName(near, allowMissingColumns=True)
        u, made = _spread(u, parts).withColumns(frames).where(~F.col("__copy")), {}
    u = u.withColumns(made) if made else u
    return u.select(*[F.col(f"`{r}`") for r in rows if r not in columns], *[F.col(f"`{n}`") for n in columns])


def _halo(u: DataFrame, values: list[str], carried: DataFrame, back: int, ahead: int) -> DataFrame:
    """Copies of the ``back`` rows before and the ``ahead`` rows after each
    partition, of its first and last key, marked with that partition."""
    edge = (F.col("__tail") & (F.col("__n") > F.col("__tn") - back)) | (F.col("__head") & (F.col("__n") <= ahead))
    rim = u.where(edge).select("__k", "__at", *values)
    same = F.col("head.k").eqNullSafe(F.col("tail.k"))
    last = F.col("tail.n") + F.when(same, F.col("n_in")).otherwise(0)
    asks = carried.select(F.col("__part"), F.inline(F.array(
        F.struct(F.col("head.k").alias("ask"), (F.col("n_in") - back + 1).alias("low"), F.col("n_in").alias("high")),
        F.struct(F.col("tail.k").alias("ask"), (last + 1).alias("low"), (last + ahead).alias("high")))))
    near = rim.join(F.broadcast(asks), F.col("__k").eqNullSafe(F.col("ask")) & F.col("__at").between(F.col("low"), F.col("high")))
    return near.drop("ask", "low", "high").withColumn("__copy", F.lit(True))


def within_range(df: DataFrame, keys: list[str], value: str, low: Column, columns: dict[str, Column | None],
                 parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For every row the rows of its key whose ``value`` lies between ``low`` (of
    this row) and its own: a count per name (column None) or a sum of a column.

    A RANGE frame that grows with the key becomes two running sums: each row
    asks, in the same sort, for the sum before ``low`` and up to its value.  A row
    with a null ``value`` or key part counts only those with the same nulls."""
    spark_rows = written_once(df.withColumn("__row", F.monotonically_increasing_id()), "ranged")
    v = F.col(f"`{value}`")
    held = [*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]]
    nothing = [F.lit(None).cast("double").alias(f"x{i}") for i in range(len(columns))]
    own = [(F.lit(1.0) if c is None else c.cast("double")).alias(f"x{i}") for i, c in enumerate(columns.values())]
    real = spark_rows.select(*held, v.alias("v"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("row"), *own)
    ask = [spark_rows.select(*held, at.alias("v"), F.lit(side).alias("side"), F.col("__row").alias("row"), *nothing)
           for at, side in ((F.when(v.isNotNull(), low), 0), (v, 2))]
    names = [f"k{i}" for i in range(len(keys))]
    sums = {f"s{i}": running("sum", F.col(f"x{i}")) for i in range(len(columns))}
    told = window_columns(real.union(ask[0]).union(ask[1]), names, [("v", True), ("side", True)], sums, parts, hot_rows).where("side <> 1")
    signed = [F.sum(F.when(F.col("side") == 2, F.coalesce(f"s{i}", F.lit(0.0))).otherwise(-F.coalesce(f"s{i}", F.lit(0.0)))) for i in range(len(columns))]
    told = told.groupBy(F.col("row").alias("__row")).agg(*[(s.cast("long") if c is None else s).alias(n)
                                                          for s, (n, c) in zip(signed, columns.items())])
    return spark_rows.join(told, "__row").drop("__row")
