"""Repair of damaged conversations by weighted interval parsing.

The roles of a sound conversation spell ``(s?(ua)+)?``: an optional system row,
then user and assistant in turns.  A conversation is repaired by edits, each a
letter of the audit: Keep a row (0), Rerole it to user or assistant (2), Delete
it (3), Insert an empty row (2); a truncated row that is not deleted adds 1.
Wanted is the cheapest repair, of equals the one whose audit is least in ASCII.

The repair grammar is in Chomsky normal form.  Its nonterminals are pairs of
states [p>q] (nothing yet, after system, after user, after assistant): [p>q] on a
span says how the rows of the span, edited, lead from p to q.

    [p>q] -> [p>r] [r>q]                    for every state r between
    [p>q] -> a kept, reroled or deleted row
    [p>q] -> an inserted row, on the empty span

A cell of the chart holds for each nonterminal the least (cost, audit).  Cells
of single rows are closed under insertion on both sides; cells of longer spans
come from two shorter ones, bottom-up by span length, and are closed by that.
Two audits of one span and one cost never are the beginning of one another (the
letters tell the cost), so the least of joint spans is joined from the least of
each.  A path has some state at every border inside a span, so all splits of a
span give the same cell: spans of length 1, 2, 4, ... are enough, and a parse
takes n - 1 joins of cells instead of the cube of n (tests hold it against the
chart of all spans and splits).

Conversations are dealt by their id and streamed in order of turn; a task holds
one conversation.  Those of more than ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes
(a key may hold a third of all rows) are cut instead: equal rows are counted,
the first of equal texts found by an aggregate, rows sorted by range over all
tasks, the cells of each task's stretch joined per conversation, and only
the digest, a chain over the rows, is taken in one stream per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.llm import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LONG_ROWS, LONG_BYTES = 10_000, 32 << 20
_BLANKS = " \t\n\v\f\r"
_SOUND = frozenset(("su", "ua", "au"))
_STATES = range(4)  # nothing yet, after system, after user, after assistant
_USER, _ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
_MOVES = {"s": ((0, 1),), "u": _USER, "a": _ASSISTANT}
_MADE = _USER + _ASSISTANT  # moves of inserted and reroled rows

# ---------------------------------------------------------------- cells
# A cell is a list by 4 * p + q of (cost, audit), None where p does not lead to q.


def _rules() -> list[tuple[int, int, int]]:
    leads = {(p, p) for p in _STATES} | {m for moves in _MOVES.values() for m in moves}
    while more := {(p, q) for p, r in leads for s, q in leads if r == s} - leads:
        leads |= more
    return [(4 * p + q, 4 * p + r, 4 * r + q) for p, q in sorted(leads) for r in _STATES if (p, r) in leads and (r, q) in leads]


RULES = _rules()


def join(left: list, right: list) -> list:
    """The cell of a span whose two parts have these cells."""
    out: list = [None] * 16
    for to, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        cost, old = x[0] + y[0], out[to]
        if old is None or cost < old[0]:
            out[to] = (cost, x[1] + y[1])
        elif cost == old[0]:
            audit = x[1] + y[1]
            if audit < old[1]:
                out[to] = (cost, audit)
    return out


def _gap() -> list:
    """Cell of the empty span: insertions, closed."""
    cell: list = [None] * 16
    for p in _STATES:
        cell[5 * p] = (0, "")
    for p, q in _MADE:
        cell[4 * p + q] = (INSERT, "I")
    while (more := join(cell, cell)) != cell:
        cell = more
    return cell


GAP = _gap()


def leaf(initial: str, gone: bool, truncated: bool) -> list:
    """Cell of one row, closed under insertion; ``gone``: it has to be deleted."""
    cell: list = [None] * 16
    for p in _STATES:
        cell[5 * p] = (DELETE, "D")
    if not gone:
        for p, q in _MADE:
            cell[4 * p + q] = (REROLE + TRUNCATED * truncated, "R")
        for p, q in _MOVES.get(initial, ()):
            cell[4 * p + q] = (KEEP + TRUNCATED * truncated, "K")
    return join(join(GAP, cell), GAP)


LEAVES = {(i, gone, cut): leaf(i, gone, cut) for i in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)}


def parse(cells: list[list]) -> list:
    """The cell of the span over all of ``cells``, bottom-up by span length."""
    if not cells:
        return GAP
    while len(cells) > 1:
        odd = [cells[-1]] * (len(cells) % 2)
        cells = [join(a, b) for a, b in zip(cells[::2], cells[1::2])] + odd
    return cells[0]


def best(cell: list) -> tuple[int, str]:
    """(cost, audit) of the cheapest sound conversation."""
    return min(x for x in (cell[0], cell[3]) if x is not None)


# ---------------------------------------------------------------- rows


def initial(role: str) -> str:
    return role[:1] or " "


class Tally:
    """Faults and cell of consecutive rows of one conversation."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.first = self.last = ""  # initials
        self.low = self.high = None  # turns
        self.cells: list[list] = []

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        body = text.rstrip(_BLANKS)
        blank, cut = not body, body[-1:] not in (".", "!", "?")
        twice = seen and not blank
        cut = cut and not blank and not twice
        self.blank += blank
        self.duplicate += twice
        self.truncated += cut
        at = initial(role)
        self.illegal += bool(self.rows) and self.last + at not in _SOUND
        self.first, self.last = self.first or at, at
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.rows += 1
        self.cells.append(LEAVES[at if at in _MOVES else "", blank or twice, cut])
        if len(self.cells) >= 512:
            self.cells = [parse(self.cells)]

    def join(self, after: "Tally") -> None:
        """Take in the rows that come next."""
        if not after.rows:
            return
        self.illegal += after.illegal + (bool(self.rows) and self.last + after.first not in _SOUND)
        self.turns += after.turns - (after.low is not None and after.low == self.high)
        self.low = after.low if self.low is None else self.low
        self.high = self.high if after.high is None else after.high
        self.first, self.last = self.first or after.first, after.last
        for k in ("blank", "duplicate", "truncated", "rows"):
            setattr(self, k, getattr(self, k) + getattr(after, k))
        self.cells += after.cells

    def report(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit"""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *best(parse(self.cells))


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows, deleted ones left out."""
    rows, state = iter(rows), 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[initial(role)]
        yield edit, role, text


def digest(repaired: Iterator[tuple[str, str, str]]) -> str:
    """SHA-256 of the newline-joined ``role:text``, taken row by row."""
    h, glue = hashlib.sha256(), ""
    for _, role, text in repaired:
        h.update(f"{glue}{role}:{text}".encode())
        glue = "\n"
    return h.hexdigest()


# ---------------------------------------------------------------- tasks

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "place long, edit string, role string, text string"
_NAMES = {s: [x.split()[0] for x in s.split(", ")] for s in (_REPORT, _ROW)}


def _out(schema: str, conv_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(schema).fields])


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, str)) + 64
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _types(schema: str) -> list[pa.DataType]:
    return [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]


def _results(conv, report: tuple, rows: Callable[[], Iterator[tuple[str, str]]], whole: bool) -> Iterator[tuple]:
    """The report of a conversation, or its repaired rows."""
    audit = report[-1]
    if whole:
        yield from ((conv, n, *r) for n, r in enumerate(replay(audit, rows())))
    else:
        yield (conv, *report, digest(replay(audit, rows())))


def _task(whole: bool):
    """Streams (conv, turn, role, text, copies) in order, one conversation held at a time."""
    schema = _ROW if whole else _REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def typed():
            for b in batches:
                kind[:] = [b.column(0).type]
                yield b

        def results():
            for conv, group in groupby(_rows_of(typed()), key=lambda r: r[0]):
                tally, seen, rows = Tally(), set(), []
                for _, turn, role, text, copies in group:
                    for _ in range(copies):
                        tally.add(turn, role, text, (role, text) in seen)
                        seen.add((role, text))
                        rows.append((role, text))
                yield from _results(conv, tally.report(), lambda: iter(rows), whole)

        found = results()
        first = next(found, None)
        if first is not None:
            yield from _batched(chain([first], found), ["conv_id", *_NAMES[schema]], [kind[0], *_types(schema)])
    return run


_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
_SEGMENT = f"part long, {_COUNTS}, first string, last string, cell array<struct<place:int,cost:long,audit:string>>"


def _segment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (conv, turn, role, text, copies, fresh) in order of a range sort:
    a row with the tally of each conversation that lies in this partition."""
    part, kind = TaskContext.get().partitionId(), []

    def typed():
        for b in batches:
            kind[:] = [b.column(0).type]
            yield b

    names = ["conv_id", *(x.split(" ")[0] for x in _SEGMENT.split(", "))]
    cell = pa.list_(pa.struct([("place", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for conv, group in groupby(_rows_of(typed()), key=lambda r: r[0]):
        t = Tally()
        for _, turn, role, text, copies, fresh in group:
            for k in range(copies):
                t.add(turn, role, text, bool(k) or not fresh)
        whole = [{"place": i, "cost": x[0], "audit": x[1]} for i, x in enumerate(parse(t.cells)) if x is not None]
        counts = [part, t.rows, t.blank, t.duplicate, t.truncated, t.illegal, t.turns, t.low, t.high]
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind[0]), *(pa.array([c], pa.int64()) for c in counts),
                                          pa.array([t.first]), pa.array([t.last]), pa.array([whole], cell)], names)


def _join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the tallies of _segment_task in order of (conv, part): a report without digest each."""
    kind = []

    def typed():
        for b in batches:
            kind[:] = [b.column(0).type]
            yield b

    def results():
        for conv, group in groupby(_rows_of(typed()), key=lambda r: r[0]):
            whole = Tally()
            for _, _, rows, blank, twice, cut, illegal, turns, low, high, first, last, cell in group:
                t = Tally()
                t.rows, t.blank, t.duplicate, t.truncated, t.illegal = rows, blank, twice, cut, illegal
                t.turns, t.low, t.high, t.first, t.last = turns, low, high, first, last
                cells: list = [None] * 16
                for x in cell:
                    cells[x["place"]] = (x["cost"], x["audit"])
                t.cells = [cells]
                whole.join(t)
            yield (conv, *whole.report())

    names, types = ["conv_id", *_NAMES[_REPORT][:-1]], _types(_REPORT)[:-1]
    for row in results():
        yield from _batched(iter([row]), names, [kind[0], *types])


def _replay_task(whole: bool):
    """Streams (conv, turn, role, text, copies, report): the report of a conversation, then its rows in order."""
    schema = _ROW if whole else _REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def typed():
            for b in batches:
                kind[:] = [b.column(0).type]
                yield b

        def results():
            for conv, group in groupby(_rows_of(typed()), key=lambda r: r[0]):
                report = next(group)[5]
                rows = ((role, text) for _, _, role, text, copies, _ in group for _ in range(copies))
                yield from _results(conv, tuple(report[k] for k in _NAMES[_REPORT][:-1]), lambda: rows, whole)

        found = results()
        first = next(found, None)
        if first is not None:
            yield from _batched(chain([first], found), ["conv_id", *_NAMES[schema]], [kind[0], *_types(schema)])
    return run


# ---------------------------------------------------------------- Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows with the damage that the check sum
    of ``conv_id:turn`` modulo 20 deals them; 0 drops a row (0 copies, which keeps its
    conversation known), 1 empties the text, 2 removes its ``.!?``, 3 doubles the
    row, 4 makes the role user.  Nulls count as one space, null turns stay null."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    dealt = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    text = F.when(dealt < 2, "").when(dealt == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(dealt == 0, "").when(dealt == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).cast("long").alias("copies"))


ORDER = ("conv", "turn", "role", "text")


def repair(conversations: DataFrame, whole: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256; with ``whole`` the repaired rows instead, as
    (conv_id, place, edit, role, text).

    Rows are taken by turn, null turns first, ties by role, then text (in the order
    of their bytes).  A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated (last character other than a blank is none of ``.!?``).
    ``illegal`` counts neighbours whose role initials are none of su, ua, au; an
    empty role has a blank as its initial.  A null conv_id is a conversation of its
    own.  A conversation without rows after the damage has zeros, an empty audit and
    the digest of the empty string.  Repeated rows are duplicates; other columns
    play no part; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    C.bounded_batches(spark)
    kind = conversations.schema["conv_id"].dataType
    rows = damaged(conversations)
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    long = C.staged(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv"), "long")
    schema = _out(_ROW if whole else _REPORT, kind)
    if long.isEmpty():
        return rows.repartition("conv").sortWithinPartitions(*ORDER).mapInArrow(_task(whole), schema)
    which = rows["conv"].eqNullSafe(long["conv"])
    held = rows.join(long, which, "left_anti").repartition("conv").sortWithinPartitions(*ORDER)
    return held.mapInArrow(_task(whole), schema).union(_long(rows.join(long, which, "left_semi"), whole, schema))


def _long(rows: DataFrame, whole: bool, schema: T.StructType) -> DataFrame:
    """``repair`` for conversations that are too long for a task."""
    kind = rows.schema["conv"].dataType
    rows = C.staged(rows.groupBy(*ORDER).agg(F.sum("copies").alias("copies")), "counted")
    turn = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("turn"))
    first = rows.where("copies > 0").groupBy("conv", "role", "text").agg(F.min(turn).alias("first"))
    r, f = rows.alias("r"), first.alias("f")
    same = F.col("r.conv").eqNullSafe(F.col("f.conv")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.text") == F.col("f.text"))
    marked = r.join(f, same, "left").select(*[F.col(f"r.{c}") for c in (*ORDER, "copies")],
                                            F.col("r.turn").eqNullSafe(F.col("f.first.turn")).alias("fresh"))
    spread = marked.repartitionByRange(C.shuffle_parts(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    segments = C.staged(spread.mapInArrow(_segment_task, _out(_SEGMENT, kind)), "segments")
    reports = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _join_task, T.StructType(_out(_REPORT, kind).fields[:-1]))
    told = reports.select(F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.struct(*_NAMES[_REPORT][:-1]).alias("report"))
    stream = told.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text").drop("kind")
    return stream.select("conv", "turn", "role", "text", "copies", "report").mapInArrow(_replay_task(whole), schema)
