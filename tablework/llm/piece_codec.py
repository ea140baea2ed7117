"""SentencePiece encoding (merge type) by backtracking, and decoding.

A merge-type model joins the adjacent pair whose joint piece has the highest
score, leftmost first, until none is left.  The result is the only sequence of
pieces in which every adjacent pair, its text merged again on its own, comes
out as the same two pieces.  So the encoder walks the text from the left:

* an Aho-Corasick automaton over all pieces gives the pieces that start at a
  position, the longest is tried first;
* a piece is taken if it fits the piece before it (re-merging of the two,
  remembered per pair);
* a position from which nothing fits is marked in a bitfield and never tried
  again, and the piece before it gives way to its next shorter one.

Positions fail once at most, so the walk is linear in the text.  Text is cut
first where no piece can lie: before a run of spaces (pieces hold spaces only
at their start) and around characters without a piece, which are written as
byte pieces.  Units between the cuts that were met before come from a cache.

Decoding is the library's own ``decode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.llm import common as C

SPACE = "▁"
#: Units of at most this many characters are remembered, at most so many of them in a worker.
CACHED_CHARS, CACHED_UNITS = 48, 300_000
#: Pair checks remembered in a worker.
CACHED_PAIRS = 1_000_000
#: Characters whose matches are held at once.
STRETCH = 4096
_NEVER = float("inf")
_PROBE = "  a \té é ﬁ\n　x" + SPACE + " "


class Failed:
    """Bitfield of the positions from which the rest can't be encoded."""

    def __init__(self, n: int):
        self.bits = bytearray((n >> 3) + 1)

    def add(self, i: int) -> None:
        self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)


class Units(dict):
    """Unit of text to its ids (bytes), made when first asked for.  When full, the
    units become the old ones; an old one that is asked for again is taken back,
    the others go when the cache is full the next time."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = np.array(self.make(unit), "<u4").tobytes()
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Codec:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size())
                 if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = {i: m.id_to_piece(i) for i in plain}
        self.cost = {self.text[i]: -m.get_score(i) for i in plain}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        letters = set("".join(self.cost))
        if not letters <= set(self.cost) or any(SPACE in p.lstrip(SPACE) for p in self.cost):
            raise ValueError("Every character of a piece has to be a piece, and pieces hold spaces at their start only")
        if any(m.is_unknown(b) for b in self.byte):
            raise ValueError("The model has no byte pieces")
        if m.normalize(_PROBE) != self.normal(_PROBE) or m.normalize(""):
            raise ValueError("The model's normalisation is more than a leading space and escaped spaces")
        self.found = ahocorasick.Automaton()
        for i, p in self.text.items():
            self.found.add_word(p, (len(p), i))
        self.found.make_automaton()
        self.longest = max(map(len, self.cost))
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (m.bos_id(), m.eos_id()))
        cuts = "".join(c for c in "\n\r\t" if c not in letters)
        self.unit = self._unit_pattern(cuts)
        self.units = Units(self._unit)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[int, list | None] = {}

    def _unit_pattern(self, cuts: str) -> re.Pattern:
        """Units of text that no piece reaches across: spaces with what follows
        them, up to the next space; if no piece has letters beside other
        characters (spaces apart), up to the next change between them."""
        last = f"|[{cuts}]" if cuts else ""
        odd = re.escape("".join(sorted(c for c in self.cost if len(c) == 1 and re.match(r"[^\W\d_]", c) and not c.isalpha())))
        letter, other = rf"[^\W\d_{odd}]+", rf"(?:[^{SPACE}{cuts}\w]|[\d_{odd}])+"
        if all(re.fullmatch(f"{letter}|{other}|", p.lstrip(SPACE)) for p in self.cost):
            return re.compile(f"{SPACE}*{letter}|{SPACE}*{other}|{SPACE}+{last}")
        return re.compile(f"{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+{last}")

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """A short text merged by the model's own rule (best score first, leftmost
        of equals): its pieces, and for each step (cost, first part, last part)."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                cost = self.cost.get(parts[k] + parts[k + 1], _NEVER)
                if cost < best:
                    best, at = cost, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _steps(self, i: int) -> list | None:
        """Merging steps of a piece; None if its text does not merge into it."""
        if i not in self.steps:
            parts, steps = self.merges(self.text[i])
            self.steps[i] = steps if len(parts) == 1 else None
        return self.steps[i]

    def fits(self, a: int, b: int) -> bool:
        """Do the texts of pieces ``a`` (-1: none) and ``b``, set side by side and
        merged again, come out as just these two?

        The steps inside either piece run as they do alone, always the cheapest
        of both next, until the parts on both sides of the border merge before
        them (leftmost of equals: a step of ``a`` goes first, one of ``b`` last).
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge_again(a, b)
        return known

    def _merge_again(self, a: int, b: int) -> bool:
        right = self._steps(b)
        if a < 0 or right is None:
            return right is not None
        left = self._steps(a)
        last, first = self.text[a][-1], self.text[b][0]
        i = j = 0
        while True:
            across = self.cost.get(last + first, _NEVER)
            x = left[i][0] if i < len(left) else _NEVER
            y = right[j][0] if j < len(right) else _NEVER
            if across < x and across <= y:
                return False
            if x == y == _NEVER:
                return True
            if x <= y:
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1

    def _matches(self, text: str, at: int) -> list[list[tuple[int, int]]]:
        """Pieces (length, id) that start at each of ``STRETCH`` positions from ``at``, shortest first."""
        n = min(STRETCH, len(text) - at)
        out: list[list] = [[] for _ in range(n)]
        for end, hit in self.found.iter(text, at, min(len(text), at + n + self.longest)):
            k = end + 1 - hit[0] - at
            if 0 <= k < n:
                out[k].append(hit)
        return out

    def _walk(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        failed, ids, picks = Failed(len(text)), [], []
        base, hits = 0, self._matches(text, 0)
        pos, k = 0, None  # k: the next match to try at pos; None is the longest
        while pos < len(text):
            if not base <= pos < base + len(hits):
                base = max(0, pos - self.longest) if pos < base else pos
                hits = self._matches(text, base)
            here = hits[pos - base]
            k = len(here) - 1 if k is None else k
            before = ids[-1] if ids else -1
            while k >= 0 and (pos + here[k][0] in failed or not self.fits(before, here[k][1])):
                k -= 1
            if k >= 0:
                ids.append(here[k][1])
                picks.append(k)
                pos, k = pos + here[k][0], None
            else:  # nothing fits here: the piece before gives way to its next shorter one
                failed.add(pos)
                pos -= len(self.text[ids.pop()])
                k = picks.pop() - 1
        return ids

    def _unit(self, unit: str) -> list[int]:
        out, run = [], []
        for c in unit:
            if c in self.cost:
                run.append(c)
                continue
            if run:
                out += self._walk("".join(run))
                run = []
            out += [self.byte[b] for b in c.encode("utf-8")]
        return out + self._walk("".join(run)) if run else out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        body = map(self.units.__getitem__, self.unit.findall(self.normal(text)))
        return b"".join((self.begin, *body, self.end))

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file, loaded once in a worker."""
    return Codec(path)


def model_path() -> str:
    import public_tokenizers as P
    return P.path("piece_bpe_32k.model")


def _encode_task(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = [*b.schema.names[:-1], "n_tokens", "ids"]
            if decoded:
                cols.append(pa.array(map(c.decode, ids), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           decoded: bool = False, path: str | None = None) -> DataFrame:
    """The ``keep`` columns (not named as a new one), ``n_tokens`` long, ``ids`` binary (little-endian unsigned
    32-bit, with begin and end) and, if asked for, ``decoded``, the text that the
    ids give back.

    One row per row of ``docs``, repeated rows too; other columns play no part.
    Null text counts as empty, which has the begin and end ids alone.  Texts are
    taken whole; memory follows the longest one (about 24 bytes a character where
    it has no space).  An empty table gives no rows.
    """
    C.bounded_batches(docs.sparkSession)
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text_col}`").alias("__text"))
    out = [*frame.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    out += [T.StructField("decoded", T.StringType())] * decoded
    return frame.mapInArrow(_encode_task(path or model_path(), decoded), T.StructType(out))


def _decode_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            text = [None if x is None else c.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], [*b.schema.names[:-1], "decoded"])
    return run


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``decoded``, the text of the ids of a row as ``encode`` writes them (null stays null)."""
    C.bounded_batches(rows.sparkSession)
    frame = rows.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{ids_col}`").alias("__ids"))
    out = [*frame.schema.fields[:-1], T.StructField("decoded", T.StringType())]
    return frame.mapInArrow(_decode_task(path or model_path()), T.StructType(out))
