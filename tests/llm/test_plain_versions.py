"""Toxicity scores and base spans of credentials against plain versions that share no code with them."""
import math
import re

import numpy as np
import pyarrow as pa

from tablework.llm import bigru_toxicity as T
from tablework.llm import common as C
from tablework.llm import secret_grammar as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_word(net, word):
    """Input vector of a word: its own embedding beside the mean of those of its byte trigrams."""
    raw = bytes([0]) + word + bytes([0])
    h = int(C.word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])
    row = h % T.WORD_ROWS
    own = net.p["word"][row] if net.known[row] else np.zeros(T.EMBED)
    grams = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
    rows = [int(C.mix(np.array([g], np.int64))[0]) % T.CHAR_ROWS for g in grams]
    return np.concatenate((own, sum(net.p["char"][r].astype(float) for r in rows) / len(rows)))


def plain_gru(net, d, xs):
    """States of one direction, word by word: reset and update gate, then the new state."""
    h, u, out = np.zeros(T.HIDDEN), net.p["u" + d].astype(float), []
    sig = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    for x in xs if d == "f" else xs[::-1]:
        gate, rec = x @ net.p["w" + d] + net.p["c" + d], h @ u
        new = []
        for k in range(T.HIDDEN):
            r, z = sig(gate[k] + rec[k]), sig(gate[T.HIDDEN + k] + rec[T.HIDDEN + k])
            n = math.tanh(gate[2 * T.HIDDEN + k] + r * rec[2 * T.HIDDEN + k])
            new.append((1 - z) * n + z * h[k])
        h = np.array(new)
        out.append(h)
    return out if d == "f" else out[::-1]


def plain_score(net, text):
    words = [plain_word(net, w.lower()) for w in WORD.findall(text.encode())]
    if not words:
        return net.prior
    best, at = -math.inf, 0
    while True:
        xs = words[at:at + T.WINDOW]
        states = [np.concatenate(p) for p in zip(plain_gru(net, "f", xs), plain_gru(net, "b", xs))]
        marks = [float(np.tanh(s @ net.p["at"] + net.p["ab"]) @ net.p["av"]) for s in states]
        weights = [math.exp(m - max(marks)) for m in marks]
        pooled = sum(w * s for w, s in zip(weights, states)) / sum(weights)
        best = max(best, float(pooled @ net.p["o"] + net.p["b"][0]))
        if at + T.WINDOW >= len(words):
            return 1 / (1 + math.exp(-best))
        at += T.STRIDE


def test_network_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = T.Network(3)
    net.prior, net.known = 0.25, rng.random(T.WORD_ROWS) < 0.5
    for k, v in net.p.items():
        net.p[k] = (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32)
    bag = ["you", "are", "a", "Fool", "ÉTÉ", "日本語", "x", "12", "don't!", " nbsp"]
    texts = ["", " \t\n", *(" ".join(rng.choice(bag, n)) for n in (1, 2, 15, 31, 32, 33, 48, 49, 64, 130))]
    data, off = C.buffers(pa.array(texts, pa.large_string()))
    assert np.allclose(net.score(data, off), [plain_score(net, t) for t in texts], atol=2e-4)


KINDS = (re.compile("(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
         re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
LEAST = (12, 18, 16)


def plain_spans(text):
    found = []
    for kind, (form, least) in enumerate(zip(KINDS, LEAST)):
        for m in form.finditer(text):
            if len(m.group(1) if kind == 0 else m.group()) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_plain_patterns(spark, sf):
    rng = np.random.default_rng(9)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "apıkey", "K", "\"", "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef",
            "x", "é", "\n", "+/_.=-", "tokentoken", "ſecret"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(20_000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for t in texts:
        assert [x[:3] for x in S.base_spans(t)] == plain_spans(t), repr(t)
