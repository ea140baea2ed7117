"""User functions on the current tables.

The caller passes Python functions, not code text.  Batches travel to
Python as Arrow record batches (``mapInPandas``), never row by row.

Two per-group forms survive hot keys.  ``map_with_group_stats``: the group
statistics a function needs are built-in aggregates (partial per task), joined
back to the rows, and the function then sees bounded batches of rows with their
group's statistics.  ``aggregate_groups``: a user aggregate folds batches of a
group into a state in up to ``FAN`` workers, whose states are merged, so a group
is never whole in one worker.  ``apply_in_pandas`` runs such an aggregate, or hands a whole
group to one Python worker if it is given a plain function; use that only when
groups are known to be small.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.profile import clean_value
from tablework.session import join_small

#: Finished groups, and bytes of their states, that a task holds before it hands them on.
HELD_GROUPS = 50_000
HELD_BYTES = 1 << 24
#: A group is cut over at most so many workers, whose states then meet in one.
FAN = 32


@dataclass(frozen=True)
class GroupAggregate:
    """A user aggregate.

    ``init()`` gives an empty state, ``fold(state, rows)`` takes in a pandas frame
    of rows of one group, ``merge(a, b)`` joins two states and ``finish(state)``
    gives the output columns as a dict.  Rows and states come in any order, so
    ``fold`` and ``merge`` must not depend on it.  States are pickled."""
    init: Callable[[], Any]
    fold: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict]


def _run_starts(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Where a new key begins in a batch."""
    new = np.zeros(rows, bool)
    new[0] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _fold_task(agg: GroupAggregate, keys: int):
    """Batches (k0.., rows' columns) in order of the keys to (k0.., state) rows, one per
    group of the task.  ``fold`` sees the rows of a group that follow each other in a
    batch together, so it runs once per batch and once per group, in any mix of groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done, size, schema = None, None, [], 0, None

        def out():
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*[k for k, _ in done]), schema)]
            arrays.append(pa.array([s for _, s in done], pa.binary()))
            batch = pa.RecordBatch.from_arrays(arrays, [f"k{i}" for i in range(keys)] + ["state"])
            done.clear()
            return batch
        for b in batches:
            if not b.num_rows:
                continue
            schema = list(b.schema)[:keys]
            rows = pa.Table.from_batches([b.select(range(keys, b.num_columns))]).to_pandas()
            start = _run_starts(b.columns[:keys], b.num_rows)
            at = pa.array(start)
            own = list(zip(*(c.take(at).to_pylist() for c in b.columns[:keys]))) if keys else [()]
            for k, i, j in zip(own, start.tolist(), [*start[1:].tolist(), b.num_rows]):
                k = tuple(None if x != x else x for x in k)
                if state is None or k != last:
                    if state is not None:
                        done.append((last, pickle.dumps(state[0])))
                        size += len(done[-1][1])
                    last, state = k, (agg.init(),)
                    if len(done) >= HELD_GROUPS or size >= HELD_BYTES:
                        yield out()
                        size = 0
                state = (agg.fold(state[0], rows.iloc[i:j].reset_index(drop=True)),)
        if state is not None:
            done.append((last, pickle.dumps(state[0])))
        if done:
            yield out()
    return run


def _merge_task(agg: GroupAggregate, keys: int, names: list[str] | None, types: list | None):
    """Streams (k0.., state) in order of the keys: one merged state, or finished row, per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, rows, schema = None, None, [], None

        def out():
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*[k for k, _ in rows]), schema)] if keys else []
            if names is None:
                arrays.append(pa.array([pickle.dumps(s) for _, s in rows], pa.binary()))
            else:
                done = [agg.finish(s) for _, s in rows]
                arrays += [pa.array([d[n] for d in done], t) for n, t in zip(names, types)]
            batch = pa.RecordBatch.from_arrays(arrays, [f"k{i}" for i in range(keys)] + (names or ["state"]))
            rows.clear()
            return batch
        for b in batches:
            schema = list(b.schema)[:keys]
            own = list(zip(*(c.to_pylist() for c in b.columns[:keys]))) if keys else [()] * b.num_rows
            for k, packed in zip(own, b.column(b.num_columns - 1).to_pylist()):
                s = pickle.loads(packed)
                if state is not None and k == last[0]:
                    state = (agg.merge(state[0], s),)
                    continue
                if state is not None:
                    rows.append((last[0], state[0]))
                last, state = (k,), (s,)
                if len(rows) >= 1000:
                    yield out()
        if state is not None:
            rows.append((last[0], state[0]))
        if rows:
            yield out()
    return run


def aggregate_groups(df: DataFrame, keys: list[str], agg: GroupAggregate, schema: str) -> DataFrame:
    """``keys`` and the columns of ``schema`` that ``agg.finish`` gives, one row per group.

    Rows are dealt by key and by one of ``FAN`` ways and sorted by key, so a task has a
    group's rows of its way in a row and folds them batch by batch into one state:
    folds grow with the batches and the groups, not with groups times batches.  The
    states of a group then meet in one task, as a stream of which two are held at a
    time.  Null keys are a group, NaN keys count as null; without keys the table is one
    group and its rows stay where they are; an empty table gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_type
    made = T.StructType.fromDDL(schema)
    rest = [c for c in df.columns if c not in keys]
    held = df.select(*[clean_value(df, k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in rest])
    own = held.schema.fields[:len(keys)]
    names = [f.name for f in own]
    state = T.StructType([*own, T.StructField("state", T.BinaryType())])
    if keys:
        way = F.pmod(F.spark_partition_id(), F.lit(FAN))
        held = held.withColumn("__way", way).repartition(*names, "__way").drop("__way").sortWithinPartitions(*names)
    states = held.mapInArrow(_fold_task(agg, len(keys)), state)
    if keys:
        met = states.repartition(*names).sortWithinPartitions(*names)
    else:
        few = states.repartition(FAN).mapInArrow(_merge_task(agg, 0, None, None), state)
        met = few.coalesce(1)
    done = met.mapInArrow(_merge_task(agg, len(keys), [f.name for f in made], [to_arrow_type(f.dataType) for f in made]),
                          T.StructType([*own, *made.fields]))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[F.col(f"`{f.name}`") for f in made])


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(pandas.DataFrame) -> pandas.DataFrame`` over Arrow batches."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def map_with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column],
                         fn: Callable, schema: str) -> DataFrame:
    """Rows plus ``stats`` of their group (named aggregates), then ``fn`` on
    Arrow batches.  No group is ever gathered in one task."""
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return map_batches(join_small(df, g, keys, "left"), fn, schema)


def apply_in_pandas(df: DataFrame, keys: list[str], fn: Callable | GroupAggregate, schema: str) -> DataFrame:
    """A user function per group: a ``GroupAggregate`` at any size (``schema`` then
    has its output columns), or a whole-group pandas function for bounded groups."""
    if isinstance(fn, GroupAggregate):
        return aggregate_groups(df, keys, fn, schema)
    return df.groupBy(*keys).applyInPandas(fn, schema)


# Custom steps: name → function(DataFrame, **params) → DataFrame.
STEPS: dict[str, Callable] = {}


def register_step(name: str):
    def deco(fn):
        STEPS[name] = fn
        return fn
    return deco


def run_step(name: str, df: DataFrame, **params) -> DataFrame:
    if name not in STEPS:
        raise KeyError(f"Unknown step: {name}")
    return STEPS[name](df, **params)
