import random

import numpy as np
import pytest

import brute
from tablework.llm import conversation_repair as R
from tablework.llm import hard_negatives as H
from tablework.llm import piece_codec as P

# ------------------------------------------------------------ conversations

ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]
TEXTS = ["", "a.", "b", "c!", "d?", " e. ", "f \t", "日本。", None, "g" * 3000 + "."]
TALK = "conv_id long, turn long, role string, text string, kind string, conv long, copies string, audit int, fresh int"


def talk(seed, convs, most):
    r = random.Random(seed)
    rows = [(c, r.choice([None, 0, 1, 2, 3, 4, 7, 9]), r.choice(ROLES), r.choice(TEXTS))
            for c in [None, *range(convs)] for _ in range(r.randint(1, most))]
    return rows + [(500, t, "user" if t % 2 == 0 else "assistant", f"line {t % 11}.") for t in range(120)]


def as_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", None, 3) for r in rows], TALK).repartition(5)


@pytest.mark.parametrize("long_rows", [R.LONG_ROWS, 4, 0])
def test_repair_against_brute_force(spark, long_rows):
    rows = talk(1, 60, 9)
    got = {r[0]: tuple(r)[1:] for r in R.repair(as_table(spark, rows), long_rows=long_rows).collect()}
    assert got == {c: brute.repaired(rs) for c, rs in brute.damage(rows).items()}


@pytest.mark.parametrize("long_rows", [R.LONG_ROWS, 4])
def test_repaired_rows_are_sound(spark, long_rows):
    rows = talk(2, 25, 9)
    kept = R.repair(as_table(spark, rows), whole=True, long_rows=long_rows).orderBy("conv_id", "place").collect()
    told = {r["conv_id"]: r for r in R.repair(as_table(spark, rows)).collect()}
    for conv, report in told.items():
        mine = [r for r in kept if r["conv_id"] == conv]
        import hashlib
        import re
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))
        assert [r["edit"] for r in mine] == [e for e in report["audit"] if e != "D"]
        body = "\n".join(f"{r['role']}:{r['text']}" for r in mine)
        assert hashlib.sha256(body.encode()).hexdigest() == report["repaired_sha256"]


def test_repair_of_nothing(spark):
    assert R.repair(as_table(spark, [(1, 1, "user", "a.")]).limit(0)).collect() == []
    gone = next(t for t in range(1000) if brute.damage([(1, t, "user", "a.")]) == {1: []})
    row = tuple(R.repair(as_table(spark, [(1, gone, "user", "a.")])).first())
    assert row == (1, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def whole_chart(cells):
    """Every span from every split."""
    n = len(cells)
    chart = {(i, i + 1): c for i, c in enumerate(cells)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            best = [None] * 16
            for k in range(i + 1, i + size):
                for at, x in enumerate(R.join(chart[i, k], chart[k, i + size])):
                    if x is not None and (best[at] is None or x < best[at]):
                        best[at] = x
            chart[i, i + size] = best
    return chart[0, n]


def test_one_split_of_a_span_is_enough():
    r = random.Random(5)
    for _ in range(60):
        cells = [R.LEAVES[r.choice("sua") if r.random() < 0.8 else "", r.random() < 0.2, r.random() < 0.3] for _ in range(r.randint(1, 12))]
        assert R.parse(cells) == whole_chart(cells)


# ------------------------------------------------------------ pieces


@pytest.fixture(scope="module")
def codec():
    return P.codec(P.model_path())


def odd_texts(codec, n):
    r, pieces = random.Random(7), list(codec.cost)
    for _ in range(n):
        k = r.randrange(5)
        if k == 0:
            yield "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        elif k == 1:
            yield "".join(r.choice("ab  \n\t▁é日e\u0000𝕏²._09") for _ in range(r.randint(0, 40)))
        elif k == 2:
            yield "".join(r.choice(["the", "in", "ing", "er", "an", "  ", "\n", "s", "t", "h", "e"]) for _ in range(r.randint(0, 40)))
        elif k == 3:
            yield " " * r.randint(0, 70) + "a" * r.randint(0, 60)
        else:
            yield "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0xD7FF), r.randint(0x10000, 0x10FFFF)])) for _ in range(r.randint(0, 30)))


def test_ids_are_those_of_the_library(codec):
    texts = ["", " ", "▁", "<s>", "<0x41>", "</s> ", "a\r\nb", "é", "e\u0301", "x" * 9000 + "the" * 9000, *odd_texts(codec, 4000)]
    want = codec.model.encode(texts, add_bos=True, add_eos=True)
    for t, ids in zip(texts, want):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids, repr(t)


def test_a_piece_gives_way(codec):
    """Some text makes the longest piece at a position the wrong one, so that the walk goes back."""
    back = 0
    for p in list(codec.cost)[:4000]:
        for q in ("ing", "er", "s", "the"):
            ids = codec._walk(p + q)
            longest = max(size for size, _ in codec._matches(p + q, 0)[0])
            back += len(codec.text[ids[0]]) < longest
    assert back > 10


def test_small_caches_change_nothing(codec, monkeypatch):
    texts = list(odd_texts(codec, 300))
    want = [codec.encode(t) for t in texts]
    for name in ("CACHED_UNITS", "CACHED_PAIRS", "CACHED_CHARS"):
        monkeypatch.setattr(P, name, 3)
    monkeypatch.setattr(P, "STRETCH", 20)
    fresh = P.Codec(P.model_path())
    assert [fresh.encode(t) for t in texts] == want


def test_encode_and_decode_tables(messy, nothing, codec):
    rows = P.encode(messy, keep=("doc_id", "kept"), decoded=True)
    assert rows.columns == ["doc_id", "kept", "n_tokens", "ids", "decoded"]
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows.collect()), key=str)
    want = []
    for r in messy.collect():
        ids = codec.model.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), codec.model.decode(ids)))
    assert got == sorted(want, key=str)
    back = P.decode(rows.drop("decoded"))
    assert sorted(map(str, back.select("decoded").collect())) == sorted(map(str, rows.select("decoded").collect()))
    assert P.encode(nothing).collect() == []


# ------------------------------------------------------------ negatives

VECTORS = "vec_id long, embedding array<float>, label int, rid long, block int, kind string, wanted string, place int, vector string"


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.2, (10, dim))
    rows = []
    for i in range(n):
        lab = int(r.integers(10))
        v = (centres[lab] * r.uniform(0, 1.5) + centres[int(r.integers(10))] * 0.5 + r.normal(0, 0.1, dim)).astype(np.float32)
        rows.append((i, [float(x) for x in v], lab))
    for i in range(0, n, 9):  # one vector many times: ties
        rows[i] = (i, rows[1][1], rows[i][2])
    rows += [rows[100], rows[100], rows[3], (None, [0.1] * dim, 1), (n, None, 1), (n + 1, [0.1] * dim, None), (n + 2, [0.1, None], 1),
             (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [], 2), (n + 6, rows[100][1][:20], 2), (100 * n, [], 3)]
    return rows


@pytest.mark.parametrize("dim, block_rows", [(64, 4096), (64, 50), (100, 130)])
def test_negatives_against_brute_force(spark, dim, block_rows):
    rows = vectors(420, dim, dim)
    df = spark.createDataFrame([(*r, 0, 1, "a", "b", 2, "c") for r in rows], VECTORS).repartition(3)
    assert sorted(map(tuple, H.mine(df, block_rows).collect())) == brute.hard_negatives(rows)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5], 1, 0, 1, "a", "b", 2, "c")], VECTORS)
    assert H.mine(df).collect() == [] and H.mine(df.limit(0)).collect() == []


def test_intervals_hold_every_score():
    r = np.random.default_rng(2)
    for scale in (1, 30, 3000):
        x = np.rint(r.normal(0, scale, (500, 128))).astype(np.int64)
        x[0] = 0
        q = np.concatenate([x[:20], np.rint(r.normal(0, scale, (20, 128))).astype(np.int64)])
        low, high = H.Codes(x).intervals(q)
        exact = q @ x.T
        assert (low <= exact).all() and (exact <= high).all()
    # four codes leave out little: most rows fall to the interval alone
    width = (high - low)[1:, 1:] / (np.linalg.norm(q[1:], axis=1)[:, None] * np.linalg.norm(x[1:], axis=1))
    assert np.median(width) < 0.5
