"""Fuzzy line deduplication.

Lines are normalised: A-Z lower-cased, digits made equal, words are runs of
letters and digits.  Lines with the same words are one class.  Each class has
a 64-bit SimHash of its words.  Candidates share a pigeonhole block: the 64
bits are cut into ``BLOCKS`` blocks, of which two fingerprints within
``RADIUS`` bits differ in at most ``RADIUS``, so they agree in some choice of
``BLOCKS - RADIUS`` blocks; every class is listed under each choice.  Candidates
within the radius whose normalised lines have an edit similarity of at least
``SIMILARITY`` (1 - distance / longer length) are linked.  Of each connected
group one occurrence stays in the corpus, the first by doc_id and line.

A class crosses the shuffle as fingerprint, class and length, so candidates of
a key are told by radius and length where they meet, each pair under its first
common choice only.  They are compared in two rounds:

1. Every class with the first candidate before it in each of its keys (in keys
   of more than ``HOT`` classes: with the key's first class), which connects
   nearly all that is alike.
2. Candidates that are still in different components, pair by pair.

Every candidate is compared or already connected, so components are those of
all links.  Texts of lines are fetched once, for the classes that have
candidates, and travel once to each group of cells in which pairs are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm.rows import located

RADIUS, BLOCKS = 3, 5
SIMILARITY = 0.8
#: Lines with fewer words are structure (brackets, headings) and always stay.
LEAST_WORDS = 4
#: Classes of a key of which the first round compares more than the first.
HOT = 512
#: Pairs that are compared at a time at least, and the largest distance for which they are.
LANES, WIDE = 128, 400
#: Pairs that are gathered to be compared.
PAIRS = 8192
#: Rows of (choice, class) that a task gathers before it hands them on; bytes that meet in a group.
FLUSH, GROUP_BYTES = 1 << 19, 16 << 20

_FOLD = C._LOWER.copy()
_FOLD[48:58] = 48
for _i in range(128):
    if not chr(_i).isalnum():
        _FOLD[_i] = 32
_FOLD_BYTES = _FOLD.tobytes()
_CHOICES = list(itertools.combinations(range(BLOCKS), BLOCKS - RADIUS))


def _mask(bits: range) -> np.uint64:
    return np.uint64(sum(1 << i for i in bits))


_BLOCK = [_mask(range(i * 64 // BLOCKS, (i + 1) * 64 // BLOCKS)) for i in range(BLOCKS)]
_MASK = [np.bitwise_or.reduce([_BLOCK[b] for b in choice]) for choice in _CHOICES]
#: Four cuts of the bits outside a choice: of ``RADIUS`` differing bits none lies in one of them.
_CUTS = [[_mask(x) for x in np.array_split([i for i in range(64) if not int(m) >> i & 1], RADIUS + 1)] for m in _MASK]
_ITEM = np.dtype([("fp", "<u8"), ("cls", "<i8"), ("size", "<u4")])
#: UTF-8 beginnings of spaces that are not ASCII, which normalising makes one space.
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, end, row and number in its row of every line (split at line feeds)."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((off[:-1], feeds + 1)), kind="stable")
    end = np.sort(np.concatenate((off[1:], feeds)), kind="stable")
    rows = np.searchsorted(feeds, off[1:], "left") - np.searchsorted(feeds, off[:-1], "left") + 1
    row = np.repeat(np.arange(len(off) - 1), rows)
    return start, end, row, np.arange(len(row)) - np.repeat(np.cumsum(rows) - rows, rows)


def _bit_counts(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the runs of ``n`` hashes from ``first``: eight counters to a word, 255 hashes at a time."""
    cuts = -(-n // 255)
    run = np.cumsum(cuts) - cuts
    start = np.repeat(first, cuts) + 255 * (np.arange(int(cuts.sum())) - np.repeat(run, cuts))
    out = np.empty((len(start), 64), np.int32)
    for i in range(8):
        out[:, i::8] = np.add.reduceat(h >> np.uint64(i) & np.uint64(0x0101010101010101), start).view(np.uint8).reshape(-1, 8)
    return out if len(start) == len(first) else np.add.reduceat(out, run, axis=0)


def line_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, class, SimHash, normalised length in characters) of each line."""
    off = np.concatenate((start, end[-1:])) if len(start) else np.zeros(1, np.int64)
    folded = _FOLD[data]
    h, line, a, b = C.word_hashes(folded, off)
    n = np.bincount(line, minlength=len(start))
    cls = C.mix(n.astype(np.uint64))
    simhash = np.zeros(len(start), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        first = (np.cumsum(n) - n)[has]
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        cls[has] = C.mix(np.add.reduceat(h * C.powers(int(n.max()))[0][place], first) + cls[has])
        votes = 2 * _bit_counts(h, first, n[has]) > n[has, None]
        simhash[has] = np.packbits(votes, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    size = np.bincount(line, b - a, len(start)).astype(np.int64) + np.maximum(n - 1, 0)
    high = np.flatnonzero(data >= 0x80)
    if len(high):  # bytes that go on with a character are within words
        at, byte = np.searchsorted(start, high, "right") - 1, data[high]
        size -= np.bincount(at[byte < 0xC0], minlength=len(start))
        for i in np.unique(at[_WIDE[byte]]) if _valid(data) else range(len(start)):
            size[i] = len(_normal(data[start[i]:end[i]].tobytes()))
    return n, cls.view(np.int64), simhash, size


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def _normal(line: bytes) -> str:
    return " ".join(line.translate(_FOLD_BYTES).decode("utf-8", "replace").split())


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, one bit per character of ``a`` (Myers); of more than
    ``most``, any number above it."""
    k, least = 0, min(len(a), len(b))
    while k < least and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[:len(a) - k], b[:len(b) - k]
    i = 0
    while i < least - k and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    step = max(32, len(b) // 8)
    for done, c in enumerate(b, 1):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(xh | up) & full) << 1 | 1, (up & xh) << 1
        up, down = (minus | ~(xv | plus)) & full, plus & xv & full
        if most is not None and done % step == 0 and done > most and _least_left(up, down, len(a), done, len(b) - done) > most:
            return most + 1
    return len(b) + up.bit_count() - down.bit_count()


def _least_left(up: int, down: int, rows: int, done: int, left: int) -> int:
    """What the distance is at least, from a column's steps up and down and the columns left."""
    steps = [np.unpackbits(np.frombuffer(x.to_bytes(rows // 8 + 1, "little"), np.uint8), bitorder="little")[:rows].astype(np.int64) for x in (up, down)]
    column = np.concatenate(([done], done + np.cumsum(steps[0] - steps[1])))
    return int((column + np.abs(np.arange(rows, -1, -1) - left)).min())


def _most(longest):
    """The largest distance of similar lines."""
    return longest * (1 - SIMILARITY + 1e-9) + 1e-9


def _by_anchors(a: str, b: str, most: int) -> bool:
    """Whether pieces of ``a`` that are found in ``b``, in order, show a distance of at most ``most``."""
    i = j = total = 0
    for p in range(0, len(a) - 7, 8):
        q = b.find(a[p:p + 8], j, j + p - i + most - total + 8)
        if q >= 0:
            if p > i or q > j:
                total += edit_distance(a[i:p], b[j:q])
                if total > most:
                    return False
            i, j = p + 8, q + 8
        elif p - i > 2 * most:
            return False
    return total + edit_distance(a[i:], b[j:], most) <= most


def similar(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > longest * (1 - SIMILARITY) + 1e-9:
        return False
    most = int(_most(longest))
    return _by_anchors(a, b, most) or 1 - edit_distance(a, b, most) / max(1, longest) >= SIMILARITY - 1e-9


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points modulo 64, first place of each text, its length)."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32) & 63
    return flat.astype(np.int64), np.cumsum(size) - size, size


def told_apart(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs are surely not similar, all pairs at a time.

    A distance is the sum over pieces of 64 characters of ``a`` of their
    distances from where they lie in ``b``, at most the whole distance away from
    their own place.  The least distance of each piece from any part of that
    window (Myers, a word per pair) bounds it from below.  Pairs whose pieces
    are found are left to ``similar``.
    """
    (x, at_x, n_x), (y, at_y, n_y) = _codes(a), _codes(b)
    most = np.floor(_most(np.maximum(n_x, n_y))).astype(np.int64)
    apart, least, k = np.zeros(len(a), bool), np.zeros(len(a), np.int64), 0
    while True:
        lanes = np.flatnonzero(~apart & (n_x > 64 * k) & (most <= WIDE) & (4 * least >= 64 * k))
        if len(lanes) < LANES:
            return apart
        rows = np.minimum(n_x[lanes] - 64 * k, 64)
        start = np.minimum(np.maximum(64 * k - most[lanes], 0), n_y[lanes])
        width = np.minimum(64 * k + rows + most[lanes], n_y[lanes]) - start
        order = np.argsort(-width, kind="stable")
        lanes, rows, start, width = lanes[order], rows[order], start[order], width[order]
        eq = np.zeros(len(lanes) * 64, np.uint64)
        table = np.arange(len(lanes)) * 64
        for i in range(64):
            on = np.flatnonzero(rows > i)
            eq[table[on] + x[at_x[lanes[on]] + 64 * k + i]] |= np.uint64(1 << i)
        top = (rows - 1).astype(np.uint64)
        up, down = np.full(len(lanes), ~np.uint64(0)), np.zeros(len(lanes), np.uint64)
        score, best = rows.copy(), rows.copy()
        text, one = at_y[lanes] + start, np.uint64(1)
        live = np.searchsorted(-width, -np.arange(int(width[0])), "left")  # lanes with a column t
        for t, n in enumerate(live.tolist()):
            u, d = up[:n], down[:n]
            e = eq[table[:n] + y[text[:n] + t]]
            xh = (((e & u) + u) ^ u) | e
            xv = e | d
            plus, minus = d | ~(xh | u), u & xh
            score[:n] += (plus >> top[:n] & one).astype(np.int64) - (minus >> top[:n] & one).astype(np.int64)
            np.minimum(best[:n], score[:n], out=best[:n])
            plus <<= one
            up[:n], down[:n] = minus << one | ~(xv | plus), plus & xv
        least[lanes] += best
        apart |= least > most
        k += 1


def _lines(col: pa.Array):
    for i, j, data, off in C.blocks(col):
        start, end, row, number = line_spans(data, off)
        yield i, j, data, start, end, row, number, *line_prints(data, start, end)


def _occurrences_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, _, _, _, row, number, n, cls, simhash, size in _lines(b.column(2)):
            use = n >= LEAST_WORDS
            at = pa.array(row[use] + i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(number[use].astype(np.int64)), pa.array(cls[use]),
                 pa.array(simhash[use].view(np.int64)), pa.array(size[use])], ["rid", "doc_id", "line", "cls", "fp", "size"])


def _keys_task(parts: int):
    """Items by (choice, key): rows (part, items), ``parts`` parts to a choice."""
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        items, part, packed = np.concatenate(held), [], []
        for c, mask in enumerate(_MASK):
            to = ((C.mix(items["fp"] & mask) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(to.astype(np.uint16) if parts < 1 << 16 else to, kind="stable")
            cuts = np.concatenate(([0], np.cumsum(np.bincount(to.astype(np.int64), minlength=parts))))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                part.append(c * parts + p)
                packed.append(items[order[cuts[p]:cuts[p + 1]]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["part", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            items = np.empty(b.num_rows, _ITEM)
            items["cls"], items["fp"], items["size"] = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            held.append(items)
            size += len(items) * len(_CHOICES)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
    return run


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of the run of equal keys that each place is in."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    n = np.diff(at)
    return np.repeat(at[:-1], n), np.repeat(at[1:], n)


def _meet(fp: np.ndarray, size: np.ndarray, choice: int, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (i, j), j from at[i] up to end[i], whose first common choice this is; a j at most once in a step."""
    i, step = np.flatnonzero(at < end), 0
    while len(i):
        j = at[i] + step
        near = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS)
        if len(near):
            x, y = i[near], j[near]
            longer = np.maximum(size[x], size[y])
            ok = longer - np.minimum(size[x], size[y]) <= longer * (1 - SIMILARITY) + 1e-9
            for mask in _MASK[:choice]:
                ok &= (fp[x] ^ fp[y]) & mask != 0
            if ok.any():
                yield x[ok], y[ok]
        step += 1
        i = i[at[i] + step < end[i]]


def _first_task(parts: int):
    """Group function: (class, first candidate before it) and, without one, the
    classes of keys that have more candidates than these, for the second round."""
    def run(group: pa.Table) -> pa.Table:
        choice = group.column("part")[0].as_py() // parts
        items = np.frombuffer(b"".join(group.column("items").to_pylist()), _ITEM)
        slot = (C.mix(items["fp"] & _MASK[choice]) >> np.uint64(43)).astype(np.int64)
        items = items[(np.bincount(slot, minlength=1 << 21) > 1)[slot]]  # most keys have one class
        items = items[np.argsort(items["fp"] & _MASK[choice], kind="stable")]
        a, b = _runs(items["fp"] & _MASK[choice])
        items = items[b - a > 1]
        items = items[np.lexsort((items["cls"], items["fp"] & _MASK[choice]))]
        fp, size, cls = items["fp"].copy(), items["size"].astype(np.int64), items["cls"].copy()
        key = fp & _MASK[choice]
        first, end = _runs(key)
        place, hot = np.arange(len(cls)), end - first > HOT
        before, more = np.full(len(cls), -1), np.zeros(len(cls) + 1, np.int64)
        used = hot.copy()
        until = np.where(hot & (place > first), place, end)  # of a hot key only the first row meets the others
        for i, j in _meet(fp, size, choice, place + 1, until):
            more += np.bincount(first[i], minlength=len(more))
            before[j] = i  # steps grow, so the last is the first before
            used[i] = used[j] = True
        has = before >= 0
        more -= np.bincount(first[has], minlength=len(more))
        again = used & (hot | (more[first] > 0))
        none = np.zeros(int(has.sum()), np.int64)
        return pa.table({"part": pa.array(np.full(len(none) + int(again.sum()), group.column("part")[0].as_py(), np.int32)),
                         "a": np.concatenate((cls[has], cls[again])),
                         "b": pa.array(np.concatenate((cls[before[has]], cls[again])), mask=np.concatenate((none > 0, np.ones(int(again.sum()), bool)))),
                         "fp": np.concatenate((none, fp[again].view(np.int64))), "size": np.concatenate((none, size[again]))})
    return run


def _rest_task(parts: int):
    """Group function: candidates (a, b) in different components, their components
    and a cell of up to ``HOT`` classes in which they meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        choice = group.column("part")[0].as_py() // parts
        cls, label, size = (group.column(c).to_numpy() for c in ("cls", "label", "size"))
        fp = group.column("fp").to_numpy().view(np.uint64)

        def ordered(rows: np.ndarray, mask: np.uint64):
            """(rows by key and, those of large components first, component; first of the next component; end of the key)"""
            rows = rows[np.lexsort((label[rows], fp[rows] & mask))]
            a, b = _runs(fp[rows] & mask, label[rows])
            rows = rows[np.lexsort((label[rows], a - b, fp[rows] & mask))]
            key = fp[rows] & mask
            return rows, _runs(key, label[rows])[1], _runs(key)[1]

        def found():
            rows, at, end = ordered(np.arange(len(cls)), _MASK[choice])
            first, _ = _runs(fp[rows] & _MASK[choice])
            hot = end - first > HOT
            for i, j in _meet(fp[rows], size[rows], choice, np.where(hot, end, at), end):
                yield rows[i], rows[j], C.mix(fp[rows[i]] & _MASK[choice])
            for k, cut in enumerate(_CUTS[choice] if hot.any() else ()):  # large keys by one more part of the bits
                large, at, end = ordered(rows[hot], _MASK[choice] | cut)
                tile = (np.arange(len(large)) // (HOT // 2)).astype(np.uint64)
                for i, j in _meet(fp[large], size[large], choice, at, end):
                    cell = C.mix(C.mix(tile[i]) + tile[j]) + np.uint64(k)
                    i, j = large[i], large[j]
                    new = np.ones(len(i), bool)
                    for earlier in _CUTS[choice][:k]:
                        new &= (fp[i] ^ fp[j]) & earlier != 0
                    yield i[new], j[new], cell[new]

        def batch(held):
            i, j, cell = (np.concatenate(x) for x in zip(*held))
            i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
            cell = C.mix(cell + np.uint64(group.column("part")[0].as_py())).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[i], cls[j], label[i], label[j], cell)], ["a", "b", "la", "lb", "cell"])
        held, n = [], 0
        for found_now in found():
            held.append(found_now)
            n += len(found_now[0])
            if n >= FLUSH:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)
    return run


def _texts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, normalised line) of the lines that are wanted of a row's text."""
    for b in batches:
        cls, held = [], []
        for text, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            lines = text.split(b"\n")
            for w in wanted:
                cls.append(w["cls"])
                held.append(_normal(lines[w["line"]]))
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(held, pa.string())], ["cls", "held"])


def _verify_cells(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Links (a, b) of components whose pair of lines is similar; what these cells have connected is not compared."""
    held = dict(zip(texts.column("cls").to_pylist(), texts.column("held").to_pylist()))
    top: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x
    for b in pairs.select(["a", "b", "la", "lb"]).to_batches(PAIRS):
        rows = [r for r in zip(*(c.to_pylist() for c in b.columns)) if find(r[2]) != find(r[3])]
        apart = told_apart([held[r[0]] for r in rows], [held[r[1]] for r in rows])
        for x, y, la, lb in (r for r, known in zip(rows, apart) if not known):
            p, q = find(la), find(lb)
            if p != q and similar(held[x], held[y]):
                top[max(p, q)] = min(p, q)
                out.append((la, lb))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what is left).

    Lines of fewer than ``LEAST_WORDS`` words stay.  Null and empty texts have
    one empty line and stay as they are.  First means smallest doc_id, rows
    without an id last, then place in the files, then line.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    docs = located(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    docs = docs.select(F.xxhash64("__at.file", "__at.row").alias("rid"), "doc_id", "text")
    seen = C.staged(docs.select("rid", "doc_id", "text").mapInArrow(
        _occurrences_task, "rid long, doc_id long, line long, cls long, fp long, size long"), "lines")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line")).alias("first")
    classes = C.staged(seen.groupBy("cls").agg(first, F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size")), "classes")
    parts = -(-C.parts_for(classes.count() * len(_CHOICES) * _ITEM.itemsize, C.shuffle_parts(spark), GROUP_BYTES) // len(_CHOICES))
    keyed = classes.select("cls", "fp", "size").mapInArrow(_keys_task(parts), "part int, items binary")
    met = C.staged(keyed.groupBy("part").applyInArrow(_first_task(parts), "part int, a long, b long, fp long, size long"), "met")
    firsts = met.where("b IS NOT NULL").select("a", "b")

    # lines of the classes that have candidates, read again from their first occurrence
    wanted = met.select(F.col("a").alias("cls")).union(met.where("b IS NOT NULL").select("b")).distinct().join(classes, "cls")
    wanted = wanted.groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "cls")).alias("wanted"))
    wanted = C.small_side(C.staged(wanted, "wanted"), 64)
    held = C.staged(docs.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(_texts_task, "cls long, held string"), "held")

    text_bytes = held.agg(F.avg(F.octet_length("held"))).first()[0] or 0

    def linked(pairs: DataFrame) -> DataFrame:
        """Links of pairs (a, b, la, lb, cell): a text travels once to the cells of a group."""
        groups = C.parts_for(pairs.count() * 2 * (text_bytes + 300), C.shuffle_parts(spark))
        pairs = pairs.withColumn("cell", F.pmod("cell", F.lit(groups)))
        ends = pairs.select(F.col("cell").alias("to"), F.col("a").alias("cls")).union(pairs.select("cell", "b")).distinct()
        texts = ends.join(held, "cls").select("to", "cls", "held")
        met = pairs.groupBy("cell").cogroup(texts.groupBy("to")).applyInArrow(_verify_cells, "a long, b long")
        return C.staged(met, "links")

    near = C.components(linked(firsts.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"), F.xxhash64("b").alias("cell"))))
    near = near.toDF("cls", "label")
    rest = met.where("b IS NULL").select("part", F.col("a").alias("cls"), "fp", "size").join(near, "cls", "left")
    rest = rest.withColumn("label", F.coalesce("label", "cls")).select("part", "cls", "fp", "size", "label")
    rest = rest.groupBy("part").applyInArrow(_rest_task(parts), "a long, b long, la long, lb long, cell long")
    rest = C.staged(rest.join(firsts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    far = C.components(linked(rest)).toDF("label", "component")
    group = near.join(far, "label", "full").select(F.coalesce("cls", "label").alias("cls"), F.coalesce("component", "label").alias("component"))
    group = C.staged(group, "groups")
    named = classes.select("cls", "first", "n").join(group, "cls", "left").where("n > 1 OR component IS NOT NULL")
    named = C.staged(named.withColumn("component", F.coalesce("component", "cls")), "named")
    kept = named.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where("all > 1")
    several = C.staged(named.join(kept, "component").select("cls", F.col("kept.rid").alias("kept_rid"), F.col("kept.line").alias("kept_line")), "several")
    gone = seen.join(several, "cls").where("rid != kept_rid OR line != kept_line")
    gone = C.staged(gone.groupBy("rid").agg(F.collect_set(F.col("line").cast("int")).alias("gone")), "gone")
    gone = C.small_side(gone, gone.agg(F.avg(F.size("gone") * 4 + 48)).first()[0] or 0)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = docs.join(gone, "rid", "left").withColumn("lines", lines)
    rest = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    return left.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
