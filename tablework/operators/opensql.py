"""Open SQL over registered tables, plus the two join shapes Spark SQL has
no syntax for (as-of join, range join).

``run_sql`` registers each source as a temp view and hands the text to
``spark.sql``: Catalyst parses, optimizes (pushdown, pruning, join
reordering, sub-query decorrelation) and AQE picks join strategies at run
time.  Nothing here re-implements a planner.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.session import ensure_shared_dir, written_once
from tablework.sources.scan import register_sources


@dataclass
class SqlResult:
    df: DataFrame
    query: str
    is_aggregate: bool
    sources: dict = field(default_factory=dict)

    def computed_values(self) -> DataFrame:
        """Row count and mean/sum/min/max of every numeric result column."""
        from tablework.operators.profile import computed_values
        return computed_values(self.df)

    def preview(self, n: int = 5) -> DataFrame:
        return self.df.limit(n)


def _aggregates(plan) -> bool:
    """Does an analysed plan group rows (in its text, not in the views it reads)?"""
    if plan.nodeName() in ("Aggregate", "View"):
        return plan.nodeName() == "Aggregate"
    below = plan.children()
    return any(_aggregates(below.apply(i)) for i in range(below.size()))


def run_sql(spark: SparkSession, query: str, sources: dict | None = None) -> SqlResult:
    views = register_sources(spark, sources or {})
    df = spark.sql(query)
    return SqlResult(df, query, _aggregates(df._jdf.queryExecution().analyzed()), views)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str,
              right_cols: list[str], prefix: str = "asof_") -> DataFrame:
    """For every left row, the right row of the same ``by`` key with the
    greatest ``on`` ≤ the left row's ``on`` (left rows without one keep
    nulls); of right rows at one instant the greatest ``right_cols``.  Right
    columns come back as ``<prefix><col>`` plus ``<prefix><on>``.  A null key
    or time matches nothing.

    Both sides are range-sorted together by (key, time, side, identity), so a
    hot key, or a burst at one instant, is cut by rank across partitions.  A
    window carries the latest right row inside a partition; what enters from
    earlier partitions comes from one row per partition.
    """
    rstruct = F.struct(_q(on).alias("t"), *[_q(c).alias(f"c{i}") for i, c in enumerate(right_cols)])
    keys = [_q(k) for k in by]
    known = _q(on).isNotNull()
    for k in keys:
        known &= k.isNotNull()
    kind = right.select(rstruct.alias("s")).schema["s"].dataType
    L = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(kind))
    R = right.where(known).select(*keys, _q(on), F.lit(0).alias("__side"), rstruct.alias("__r"))
    # right rows sort before left rows at the same instant, so "≤" holds
    both = L.where(known).unionByName(R, allowMissingColumns=True).withColumn("__tie", F.monotonically_increasing_id())
    ensure_shared_dir(left.sparkSession)
    u = both.orderBy(*keys, _q(on), "__side", "__r", "__tie").drop("__tie").withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    u = u.withColumn("__part", F.shiftright("__id", 33)).withColumn("__key", F.struct(*keys))
    inside = Window.partitionBy("__part", "__key").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("__in", F.last("__r", ignorenulls=True).over(inside))
    # one row per partition: its first key asks for, and its last key offers, the latest right row
    ends = u.groupBy("__part").agg(F.min_by("__key", "__id").alias("ask"), F.max_by(F.struct("__key", "__in"), "__id").alias("last"))
    offers = ends.select("__part", F.col("last.__key").alias("__key"), F.col("last.__in").alias("tail"), F.lit(1).alias("offer"))
    asks = ends.select("__part", F.col("ask").alias("__key"), F.lit(None).cast(kind).alias("tail"), F.lit(0).alias("offer"))
    before = Window.partitionBy("__key").orderBy("__part", "offer").rowsBetween(Window.unboundedPreceding, -1)
    enters = offers.unionByName(asks).withColumn("__prev", F.last("tail", ignorenulls=True).over(before))
    enters = enters.where("offer = 0").select("__part", "__key", "__prev")
    u = u.where("__side = 1").join(F.broadcast(enters), ["__part", "__key"], "left")  # a row per partition
    u = u.withColumn("__hit", F.coalesce("__in", "__prev"))
    lost = L.where(~F.coalesce(known, F.lit(False))).withColumn("__hit", F.col("__r"))
    extra = [F.col("__hit.t").alias(f"{prefix}{on}")] + [F.col(f"__hit.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(right_cols)]
    cols = [*[_q(c) for c in left.columns], *extra]
    return u.select(*cols).unionByName(lost.select(*cols))


#: Points of the largest blocks of the range join; those of a level are so many times larger than those of the next.
BLOCK, STEP = 1024, 8


def _levels() -> list[int]:
    """Sizes of blocks, from the largest down to less than ``STEP`` points."""
    sizes = [BLOCK]
    while sizes[-1] >= STEP:
        sizes.append(sizes[-1] // STEP)
    return sizes


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str,
               how: str = "inner", parts: int | None = None) -> DataFrame:
    """Rows of ``points`` joined to every range with ``lo <= point <= hi``;
    ``how`` is inner, left, right or full.  Any type that has an order (the three
    columns are brought to one type as a union does it); a null end or point meets
    nothing; NaN is the largest number, as in Spark.

    A sweep instead of a nested loop: ends of ranges and points are sorted
    together by range over all tasks, and the numbers of points passed and of
    ranges open are carried across the borders of tasks.  So each range learns
    the first and the last place of its points, and each point whether a range is
    open.  A range is then listed once per block of places that it reaches into and
    meets the points of these blocks.  Its blocks are of the largest size (``BLOCK``,
    then a ``STEP``-th at a time) that is no larger than its number of points, so it
    is listed in at most ``STEP + 1`` blocks, or two more than its points fill at the
    largest size, and tries at most three times its points: what is listed and tried
    grows with the result.  Points are dealt to a block of every size.
    Ranges without points are not listed at all."""
    from tablework.operators.windows import running, window_columns
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"Not a way to join: {how}")
    p = written_once(points.withColumn("__p", F.monotonically_increasing_id()), "points")
    r = written_once(ranges.withColumn("__g", F.monotonically_increasing_id()), "ranges")
    none = F.lit(None).cast("long")
    some = r.where(_q(lo) <= _q(hi))
    # kinds at one value: ranges open (0), points pass (1), ranges close (2)
    events = (p.where(_q(point).isNotNull()).select(_q(point).alias("v"), F.lit(1).alias("kind"), F.col("__p"), none.alias("__g"))
              .union(some.select(_q(lo), F.lit(0), none, F.col("__g"))).union(some.select(_q(hi), F.lit(2), none, F.col("__g"))))
    events = events.withColumns({"one": (F.col("kind") == 1).cast("int"), "step": 1 - F.col("kind")})
    swept = written_once(window_columns(events, [], [("v", True), ("kind", True)],
                                        {"passed": running("sum", F.col("one")), "open": running("sum", F.col("step"))}, parts), "swept")
    place = swept.where("kind = 1").select("__p", (F.col("passed") - 1).alias("__at"), (F.col("open") > 0).alias("__met"))
    spans = swept.where("kind <> 1").groupBy("__g").agg(F.min("passed").alias("__first"), (F.max("passed") - 1).alias("__last"))
    spans = spans.where("__first <= __last")
    sizes = _levels()
    inside = F.col("__last") - F.col("__first") + 1
    size = F.lit(sizes[-1])
    for n in reversed(sizes[:-1]):
        size = F.when(inside >= n, F.lit(n)).otherwise(size)
    listed = r.join(spans, "__g").withColumn("__size", size.cast("long"))
    listed = listed.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__first") / F.col("__size")), F.floor(F.col("__last") / F.col("__size")))))
    known = written_once(p.join(place, "__p", "left"), "places")
    dealt = known.where("__met").withColumn("__size", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])))
    dealt = dealt.withColumn("__block", F.floor(F.col("__at") / F.col("__size")))
    same = (F.col("__x.__size") == F.col("__y.__size")) & (F.col("__x.__block") == F.col("__y.__block"))
    met = dealt.alias("__x").join(listed.alias("__y"), same & F.col("__at").between(F.col("__first"), F.col("__last")))
    out = met.select(*[F.col(f"__x.`{c}`") for c in points.columns], *[F.col(f"__y.`{c}`") for c in ranges.columns])
    if how in ("left", "full"):
        alone = known.where(~F.coalesce(F.col("__met"), F.lit(False)))
        out = out.union(alone.select(*[_q(c) for c in points.columns], *[F.lit(None).cast(f.dataType) for f in ranges.schema.fields]))
    if how in ("right", "full"):
        alone = r.join(spans, "__g", "left_anti")
        out = out.union(alone.select(*[F.lit(None).cast(f.dataType) for f in points.schema.fields], *[_q(c) for c in ranges.columns]))
    return out


def range_totals(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str,
                 totals: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Rows of ``points`` with the sums of ``totals`` (integer or decimal columns of
    ``ranges``) over every range with ``lo <= point <= hi``; 0 where there is none.
    What ``range_join`` and a sum per point give, for the same types and nulls, but
    no pair is made.

    The same sweep: a range adds its values where it opens and takes them away
    after it closes, so a point's sum is what is open when it passes.  Ends at one
    value are added up first, and at most three rows per value are sorted."""
    from tablework.operators.windows import running, window_columns
    names = [f"t{i}" for i in range(len(totals))]
    value = [F.coalesce(c, F.lit(0)) for c in totals.values()]
    some = ranges.where(_q(lo) <= _q(hi))
    opens = some.select(_q(lo).alias("v"), F.lit(0).alias("kind"), *[c.alias(n) for c, n in zip(value, names)])
    closes = some.select(_q(hi), F.lit(2), *[-c for c in value])
    passes = points.where(_q(point).isNotNull()).select(_q(point), F.lit(1), *[F.lit(0) for _ in names])
    events = opens.union(passes).union(closes).groupBy("v", "kind").agg(*[F.sum(n).alias(n) for n in names])
    swept = window_columns(events, [], [("v", True), ("kind", True)], {f"sum_{n}": running("sum", F.col(n)) for n in names}, parts)
    told = swept.where("kind = 1").select(F.col("v").alias("__v"), *[F.col(f"sum_{n}").alias(f"__{n}") for n in names])
    out = points.join(told, _q(point) == F.col("__v"), "left")
    return out.select(*[_q(c) for c in points.columns], *[F.coalesce(F.col(f"__{n}"), F.lit(0)).alias(name) for n, name in zip(names, totals)])
