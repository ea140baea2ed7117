"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework.llm import common as C

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


DEDUP_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


@query("op3_stream_dedup", DEDUP_SQL)
def stream_dedup(spark, sf_dir):
    from tablework.llm.stream_dedup import duplicates
    return duplicates(C.table(spark, sf_dir, "documents")).drop("at")


@query("op4_level_packing")
def level_packing(spark, sf_dir):
    from tablework.llm.level_packing import pack
    return pack(C.table(spark, sf_dir, "documents"))


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_distinct([list_aggregate(ws[i:i + 4], 'string_agg', ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n FROM n),
s AS (SELECT DISTINCT doc_id, unnest(sh) AS t FROM n),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 80 * (ca.n + cb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT c.doc_id, c.n AS n_shingles, min(r.seen) AS component_id FROM c JOIN r ON r.id = c.doc_id GROUP BY 1, 2
"""


@query("op7_parity_join", JACCARD_SQL)
def parity_join(spark, sf_dir):
    from tablework.llm.parity_join import near_components
    return near_components(C.table(spark, sf_dir, "documents"))


@query("op9_ppm_language")
def ppm_language(spark, sf_dir):
    from tablework.llm import ppm_language as L
    docs = C.table(spark, sf_dir, "documents")
    model = L.train(docs.where(~L.held_out(F.col("doc_id"))))
    told = L.predict(docs, model, keep=["doc_id"])
    return told.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                       F.col("lang_score").alias("score"), F.round("lang_bits", 4).alias("bits_per_byte"))


@query("op10_simhash_leaks")
def simhash_leaks(spark, sf_dir):
    from tablework.llm.simhash_leaks import leaks
    found = leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.drop("at")


@query("op1_secret_grammar")
def secret_grammar(spark, sf_dir):
    from tablework.llm import secret_grammar as S
    docs = C.table(spark, sf_dir, "documents")
    return S.scan(docs, S.learn(docs))


@query("op2_fuzzy_lines")
def fuzzy_lines(spark, sf_dir):
    from tablework.llm.fuzzy_lines import dedup_lines
    return dedup_lines(C.table(spark, sf_dir, "documents"))


_DIGITS = ", ".join(f"('0x' || substr(x, {5 * g + 1}, 5))::INT" for g in range(8))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS k FROM p),
e AS (SELECT *, [{_DIGITS}] AS v FROM d)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31) + 1, 1)
                  FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN k = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k <> page_id THEN k END AS refers_to FROM e
"""


@query("op5_warc_index", WARC_SQL)
def warc_index(spark, sf_dir):
    from tablework.llm.warc_index import round_trip
    return round_trip(spark, C.table(spark, sf_dir, "pages")).drop("url")


@query("op6_bloom_lm")
def bloom_lm(spark, sf_dir):
    from tablework.llm import bloom_lm as B
    docs = C.table(spark, sf_dir, "documents")
    scored = B.score(docs, ~B.held_out(F.col("doc_id")))
    return scored.select("doc_id", B.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_bigru_toxicity")
def bigru_toxicity(spark, sf_dir):
    from tablework.llm import bigru_toxicity as T
    docs = C.table(spark, sf_dir, "documents")
    known = C.table(spark, sf_dir, "labels").where(~T.held_out(F.col("doc_id")))
    scored = T.score(docs, T.train(docs, known))
    return scored.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= T.THRESHOLD).cast("int").alias("predicted"))


def _moved(state, cost, letter, when="TRUE"):
    return f"CASE WHEN {when} THEN lpad((substr({state}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{letter}' END"


def _repair_sql() -> str:
    """The repair by a step per row over the four states, each with its least cost (8 digits) and audit."""
    cut = "cut::INT"
    drop = [_moved(f"s{p}", 3, "D") for p in range(4)]
    keep = {i: lambda p, i=i: _moved(f"s{p}", cut, "K", f"NOT gone AND x = '{i}'") for i in "sua"}
    made = lambda p: _moved(f"s{p}", f"2 + {cut}", "R", "NOT gone")
    t = [drop[0], f"least({drop[1]}, {keep['s'](0)})",
         f"least({drop[2]}, " + ", ".join(f"{keep['u'](p)}, {made(p)}" for p in (0, 1, 3)) + ")",
         f"least({drop[3]}, {keep['a'](2)}, {made(2)})"]
    put = lambda c: _moved(c, 2, "I")
    closed2 = f"least(t2, {put('t0')}, {put('t1')}, {put('t3')})"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS x, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS opened FROM o),
r AS (SELECT *, blank OR seen AS gone, opened AND NOT blank AND NOT seen AS cut,
  lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
  count_if(seen AND NOT blank) AS duplicate, count_if(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY 1),
a AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, '00000002I' AS s2, '00000004II' AS s3 FROM a
  UNION ALL
  SELECT conv_id, i, t0, t1, {closed2}, least(t3, {put(closed2)}) FROM (
    SELECT r.conv_id, r.i, {t[0]} AS t0, {t[1]} AS t1, {t[2]} AS t2, {t[3]} AS t3
    FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
e AS (SELECT p.conv_id, least(s0, s3) AS best FROM p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n.rows, 0)),
g AS (SELECT conv_id, substr(best, 9) AS audit, unnest(range(1, length(best) - 7)) AS pos FROM e),
l AS (SELECT conv_id, pos, substr(audit, pos, 1) AS edit, pos - length(replace(substr(audit, 1, pos), 'I', '')) AS made,
  length(replace(substr(audit, 1, pos), 'D', '')) AS place FROM g),
m AS (SELECT l.conv_id, pos, edit, place, r.role, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text,
  coalesce(first_value(CASE WHEN edit = 'K' THEN r.x END) OVER (PARTITION BY l.conv_id ORDER BY pos) = 's', FALSE) AS led
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = pos - made WHERE edit <> 'D'),
q AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
  chr(10) ORDER BY pos) AS body FROM m GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, substr(best, 1, 8)::BIGINT AS cost,
  substr(best, 9) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op11_conversation_repair", _repair_sql())
def conversation_repair(spark, sf_dir):
    from tablework.llm.conversation_repair import repair
    return repair(C.table(spark, sf_dir, "conversations"))


@query("op12_piece_codec")
def piece_codec(spark, sf_dir):
    from tablework.llm.piece_codec import encode
    done = encode(C.table(spark, sf_dir, "documents"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
        list_sum([a.v[i] * o.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
      FROM r a JOIN r o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark, sf_dir):
    from tablework.llm.hard_negatives import mine
    return mine(C.table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
