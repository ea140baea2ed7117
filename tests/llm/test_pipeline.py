"""Registered queries of the package, and the pipeline against a stage-by-stage brute force."""
import hashlib
import re

import brute
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tablework.llm import common as C
from tablework.llm import grouping


def test_every_operator_is_registered():
    names = E.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))


@pytest.mark.parametrize("name", ["op3_stream_dedup", "op5_warc_index", "op7_parity_join", "op11_conversation_repair", "op13_hard_negatives"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = E.queries()[name](spark, sf).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda f: sorted(tuple("None" if pd.isna(x) else str(int(x) if isinstance(x, float) else x) for x in r)
                            for r in f.astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_matches_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t)}
    top = {}
    for d, t in sorted(docs.items(), key=lambda x: (-len(x[1]), x[0])):
        top.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), d)
    docs = {d: docs[d] for d in top.values()}
    docs = {d: docs[d] for d, (c, _) in brute.components(docs).items() if c == d}
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    docs = {d for d, t in docs.items() if not any(flat(i) in flat(t) for i in items)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == docs
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_stages_keep_the_columns(spark, messy, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, messy, sf).columns == messy.columns, name
    empty = messy.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_language_stage_drops_what_no_language_codes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, "1234 !!!", None, None, None), (90002, "日本語の文章がここにあります。", None, None, None), (90003, None, None, None, None)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(odd), sf).collect()}
    assert left == {r.doc_id for r in docs.collect()}


def test_near_stage_goes_by_rows(spark, messy, sf):
    text = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew some very strange potion near an old stone bridge"
    rows = [(5, text), (1, text + " x"), (1, "another text of the same doc_id that is like none of the others here"), (None, text), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(tuple, corpus_pipeline.near(spark, docs, sf).collect()), key=str)
    assert left == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_near_stage_fetches_sets_of_close_pairs_only(spark, monkeypatch):
    """Seven documents each of shared passages meet in cells; short sketches tell them apart, only copies need whole sets."""
    monkeypatch.setattr(grouping, "FEW", 2)
    monkeypatch.setattr(grouping, "CELL", 6)
    word = lambda *x: "w" + hashlib.md5(str(x).encode()).hexdigest()[:8]
    texts = [" ".join([word("passage", g, i) for i in range(40)] + [word("own", g, d, i) for i in range(60)]) for g in range(12) for d in range(7)]
    copies = [f"{texts[0]} tonight", f"{texts[8]} tonight"]
    rows, staged = {}, C.staged

    def counted(df, name):
        out = staged(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(C, "staged", counted)
    frame = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    kept = corpus_pipeline.near(spark, frame, None).collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(texts)))
    assert rows["clusters"][0] >= 7  # else nothing met in a cell
    assert sum(rows["wanted"][1:]) == 4  # all but the documents that sketches are made of
