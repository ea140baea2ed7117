"""Exact, line and shingle deduplication, and decontamination, against brute force."""
import collections
import hashlib
import re
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm import fuzzy_lines, grouping, parity_join, simhash_leaks, stream_dedup


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_groups(rows):
    """{(doc_id, text): (keep_id, size)} of (doc_id, text) rows."""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[squeezed(t)].append((-len(t or ""), d is None, d or 0, d))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_stream_dedup_matches_brute_force(messy):
    want = exact_groups([(r.doc_id, r.text) for r in messy.collect()])
    got = stream_dedup.duplicates(messy).collect()
    shas = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == messy.count()
    assert all((r.keep_id, r.group_size) == shas[r.text_sha256] for r in got)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {k: 1 for k in shas}  # one row stays, repeated rows or not


def test_stream_dedup_tells_colliding_digests_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = exact_groups([(r.doc_id, r.text) for r in docs.collect()])
    weak = stream_dedup.duplicates(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all((r.keep_id, r.group_size) == want[squeezed(text[r.doc_id])] and r.kept == (r.doc_id == r.keep_id) for r in weak)


@pytest.mark.parametrize("weak", [False, True])
def test_stream_dedup_goes_on_from_its_state(spark, weak):
    """Runs over more and more tables, one of them twice, count every row once, with a digest of few values too."""
    from tablework.llm import common as C
    from tablework.session import shared_path
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else stream_dedup.sha256
    state, tables, seen = shared_path(spark, "state"), [], []
    for k in range(3):
        rows = [(k * 100 + i, f"text {(k * 7 + i) % 23}" + " " * ((i * k) % 4)) for i in range(30)]
        tables.append((rows, C.staged(spark.createDataFrame(rows, "doc_id long, text string"), "docs")))
    for rows, table in (tables[0], tables[1], tables[1], tables[2], tables[0]):
        seen += [r for r in rows if r not in seen]
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in stream_dedup.duplicates(table, digest=digest, state_dir=state).collect()}
        want = {}
        for d, t in rows:
            group = [x for x in seen if squeezed(x[1]) == squeezed(t)]
            keep = min(group, key=lambda x: (-len(x[1]), x[0]))[0]
            want[d] = (keep, len(group), keep == d)
        assert got == want


@pytest.mark.parametrize("names", [("_metadata", "__at"), ("c0", "__id"), ("at", "digest")])
def test_clashing_column_names(spark, names):
    from tablework.llm import bloom_lm, fuzzy_lines, simhash_leaks
    rows = [(1, "one two three four five six", 3, 4), (2, "one two three  four five six", 5, 6), (2, "something else entirely is here now", 7, 8)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{names[0]}` int, `{names[1]}` int")
    left = stream_dedup.dedup(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [rows[1], rows[2]]
    items = spark.createDataFrame([(1, "something else entirely is here now")], "item_id long, text string")
    assert sorted(map(tuple, simhash_leaks.clean(docs, items).collect())) == rows[:2]
    assert fuzzy_lines.dedup_lines(docs).count() == 3 and bloom_lm.score(docs, F.lit(True)).count() == 3


def test_dedup_keeps_columns_and_empty_tables(messy, nothing):
    left = stream_dedup.dedup(messy)
    assert left.columns == messy.columns and left.count() == len({squeezed(r.text) for r in messy.collect()})
    assert stream_dedup.duplicates(nothing).count() == 0 and stream_dedup.dedup(nothing).columns == nothing.columns


def test_parity_join_on_messy_rows(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = parity_join.near_components(messy).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got if r.doc_id is not None}
    ids = {d: t for d, t in rows if d is not None}
    want = brute.components(ids)
    assert all(by[d, n] == c for d, (c, n) in want.items())
    assert {r.component_id for r in got if r.doc_id is None} == {1, None}


@pytest.mark.parametrize("few,cell", [(8, 512), (2, 6)])
def test_parity_join_matches_brute_force(spark, sf, monkeypatch, few, cell):
    monkeypatch.setattr(grouping, "FEW", few)
    monkeypatch.setattr(grouping, "CELL", cell)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = np.random.default_rng(5)
    for i in range(120):  # copies of two texts, more and less alike
        words = docs[sorted(docs)[i % 2 + 3]].split()[:150]
        share = (i // 2 % 6) / 100
        docs[10_000 + i] = " ".join(w + "x" if rng.random() < share else w for w in words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in parity_join.near_components(frame).collect()}
    assert got == brute.components(docs)


def test_staged_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffled()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    assert len(C.staged(df, "counts").collect()) == 7
    until = time.time() + 20
    while (left := {n for n in shuffled() - before if n.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_pairs_of_a_key_are_compared_once(spark):
    members = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 4), (3, 5), (4, 4), (4, 5), (5, 2), (5, 4), (5, 5)]
    members = C.staged(spark.createDataFrame(members, "key long, cls long"), "members")
    sketches = C.staged(spark.createDataFrame([(i, 0, 9, b"12345678") for i in range(1, 6)], "cls long, band int, n long, held binary"), "sketches")
    asked = []

    def close(pairs):
        asked.append(sorted(map(tuple, pairs.collect())))
        return pairs

    grouping.connect(members, close, lambda pairs: pairs.where("a < 0"), sketches, None, lambda wanted: sketches.select("cls", "held"), None)
    assert asked == [[(1, 2), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)], []]


def test_cells_compare_short_sketches():
    rng = np.random.default_rng(7)
    core = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((core[:n], rng.integers(0, 1 << 63, m, dtype=np.uint64)))) for n, m in rng.integers(20, 400, (40, 2)) // (1, 12)]
    n, held, label = np.array([len(x) for x in sets]), [parity_join.sketch(x) for x in sets], np.arange(40) // 2
    assert all(8 * len(h) < 4 * len(x) or len(h) == 8 for x, h in zip(sets, held))
    near = parity_join.near_of(80)

    def want(pairs):
        return sorted((i, j) for i, j in pairs if label[i] != label[j] and max(n[i], n[j]) * 80 <= min(n[i], n[j]) * 100
                      and parity_join.hamming(held[i], held[j]) <= (n[i] + n[j]) * 20 // 180)

    everyone, x, y = np.arange(40), np.arange(15), np.arange(15, 40)
    alone = want((i, j) for i in range(40) for j in range(i + 1, 40))
    assert alone and sorted(zip(*(p.tolist() for p in near(n, held, label, everyone, everyone)))) == alone
    assert sorted(zip(*(p.tolist() for p in near(n, held, label, x, y)))) == want((i, j) for i in x.tolist() for j in y.tolist())


def test_a_crowded_cell_gives_its_items():
    def cell(label):
        size = len(label)
        whole = {c: np.zeros(size, np.int64) for c in ("k", "l", "i", "j", "band", "at")}
        held = pa.array([parity_join.sketch(np.arange(50, dtype=np.uint64))] * size, pa.binary())
        group = pa.table(whole | {"cell": np.full(size, 77), "cls": np.arange(size), "n": np.full(size, 50), "held": held, "label": np.array(label)})
        return sorted(zip(*grouping._near_task(parity_join.near_of(80))(group).to_pydict().values()))

    assert cell([1, 1, 3]) == [(None, 0, 2), (None, 1, 2)]
    assert cell([1, 2, 3, 4, 5]) == [(77, i, None) for i in range(5)]
    assert cell([1, 1]) == []


def test_parity_join_of_an_empty_table(nothing):
    assert parity_join.near_components(nothing).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = rng.integers(1, 400, 2)
        both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        x, y = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n, dtype=np.uint64)))), np.unique(np.concatenate((both[:200], rng.integers(0, 1 << 63, m, dtype=np.uint64))))
        assert parity_join.hamming(parity_join.sketch(x), parity_join.sketch(y)) <= len(np.setxor1d(x, y))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(40)] + [(200, 200)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(41)}}


def test_edit_distance():
    rng = np.random.default_rng(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]
    for _ in range(1000):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in "ab")
        assert fuzzy_lines.edit_distance(a, b) == plain(a, b)


def brute_lines(rows):
    """Texts left of (doc_id, text) rows, by comparing all pairs of distinct lines within the radius."""
    fold = lambda s: " ".join("".join(c if ord(c) > 127 else c.lower() if c.isalpha() else "0" if c.isdigit() else " " for c in s).split())
    seen = collections.defaultdict(list)
    for d, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            if len(fold(line).split()) >= fuzzy_lines.LEAST_WORDS:
                seen[fold(line)].append((d, i))
    lines = list(seen)
    data = "".join(lines).encode()
    ends = np.cumsum([len(x.encode()) for x in lines])
    prints = fuzzy_lines.line_prints(np.frombuffer(data, np.uint8), np.concatenate(([0], ends[:-1])), ends)[2]
    top = {x: x for x in range(len(lines))}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(lines)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= fuzzy_lines.RADIUS) + i + 1:
            if fuzzy_lines.similar(lines[i], lines[j]):
                a, b = find(i), find(int(j))
                top[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, x in enumerate(lines):
        groups[find(i)] += seen[x]
    gone = {o for g in groups.values() for o in g if o != min(g)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_fuzzy_lines_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    line = "Call number 12345 for your free copy of this very long and quite unusual announcement about our garden fair today"
    rows += [(9000 + i, f"{line.replace('12345', str(777 + i))}\nunique {i} words here only {i * i}\n{line.replace('garden', 'gardens')}") for i in range(30)]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert sum(r.n_dropped for r in got) >= 58


def test_fuzzy_lines_on_messy_rows(messy, nothing):
    got = fuzzy_lines.dedup_lines(messy).collect()
    assert len(got) == messy.count() and fuzzy_lines.dedup_lines(nothing).count() == 0
    left = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 11}
    assert left[1].n_dropped == 0 and left[2].text == "" and left[4].text is None and left[5].text == "" and left[6].text == " \t\n"
    assert all(r.text == "" for r in got if r.doc_id == 11)


def test_similar_by_its_definition():
    """The bounds that end a comparison early never turn a similar pair away."""
    rng = np.random.default_rng(11)
    pairs = []
    for k in range(400):
        a = list(rng.choice(list("abcd eé日0"), rng.integers(1, 500)))
        b = list(a)
        for _ in range(int(len(a) * rng.uniform(0, 0.35))):
            i = int(rng.integers(0, len(b) + 1))
            b[i:i + int(rng.integers(0, 2))] = list(rng.choice(list("abcd"), rng.integers(0, 3)))
        if k % 5 == 0:  # all edits at one place
            b = list(rng.choice(list("xyz"), len(a) // 5)) + a
        pairs.append(("".join(a), "".join(b)))
    pairs += [(x, pairs[i - 1][1]) for i, (x, _) in enumerate(pairs)]
    pairs += [("", ""), ("", "abc"), ("abc", "")]
    want = [1 - fuzzy_lines.edit_distance(x, y) / max(1, len(x), len(y)) >= fuzzy_lines.SIMILARITY - 1e-9 for x, y in pairs]
    assert [fuzzy_lines.similar(x, y) for x, y in pairs] == want and 100 < sum(want) < 400
    apart = fuzzy_lines.told_apart([x for x, _ in pairs], [y for _, y in pairs])
    assert not (apart & np.array(want)).any() and apart.sum() > 200


@pytest.mark.parametrize("hot", [512, 4])
def test_fuzzy_lines_of_large_keys(spark, monkeypatch, hot):
    """Lines with one fingerprint, near copies and quite different ones, and lines with spaces and characters of several bytes."""
    monkeypatch.setattr(fuzzy_lines, "HOT", hot)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("bcdfgklmnprst"), n))
    few = [" ".join(word(9) for _ in range(5)) for _ in range(40)]
    rows = [(i, "the " * 14 + (few[i % 40] if i % 3 else few[i % 40][:-1] + "x")) for i in range(300)]
    rows += [(1000 + i, f"schöne große Häuser stehen　 {'weit ' * (i % 3)}hinter den grünen Hügeln 日本{i % 7}") for i in range(20)]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)


def test_leaks_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    first = words(items[sorted(items)[0]])
    docs[9001] = "before it " + " ".join(first).upper() + "; and after."
    docs[9002] = " ".join(first[:-1]) + " but then another end"
    docs[9003] = " ".join(w for i, w in enumerate(first) if i % 4)
    items[9000], items[9005], items[9006] = "two words", None, ""
    docs[9004], docs[9006] = "Two, words!", "there are two words in here"

    def bag(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    bags = {i: bag(words(t)) for i, t in items.items()}
    held = collections.Counter(s for b in bags.values() for s in b)
    want = {}
    for d, t in docs.items():
        w = words(t)
        for i, b in bags.items():
            n = len(words(items[i]))
            if not n or n < 5 and len(w) != n:  # a short item is only found whole
                continue
            best = 0
            for at in range(max(1, len(w) - n + 1)):
                v = bag(w[at:at + n])
                if v.keys() & b.keys():
                    weight = lambda s: 1 / held[s] if s in held else 1.0
                    best = max(best, sum(weight(s) * min(v[s], b[s]) for s in v) / sum(weight(s) * max(v[s], b[s]) for s in v | b))
            if best >= 0.8 - 1e-9:
                want[d, i] = round(best, 9)
    got = simhash_leaks.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                              spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert (9001, sorted(items)[0]) in want and (9004, 9000) in want and not any(d in (9003, 9006) for d, _ in want)


def test_leaks_on_messy_rows(spark, messy, nothing):
    items = spark.createDataFrame([(5, " ".join(f"w{i}x0" for i in range(100, 130)), "c", 1), (None, None, "d", 2)], "item_id long, text string, doc_id string, fp int")
    assert sorted(r.doc_id for r in simhash_leaks.leaks(messy, items).collect()) == [7, 8]
    left = simhash_leaks.clean(messy, items)
    assert left.columns == messy.columns and left.count() == messy.count() - 2
    assert simhash_leaks.leaks(nothing, items).count() == 0
    assert simhash_leaks.clean(messy, items.limit(0)).count() == messy.count()


def test_blocks_hold_all_values_within_the_radius():
    near = [m for m in range(1 << simhash_leaks.BITS) if bin(m).count("1") <= simhash_leaks.NEAR]
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, simhash_leaks.RADIUS, replace=False):
            y ^= 1 << int(b)
        assert any(((x >> 8 * b) ^ (y >> 8 * b)) & 255 in near for b in range(simhash_leaks.BLOCKS))
