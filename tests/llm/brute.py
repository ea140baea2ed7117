"""Plain reference versions that the operators are held against on small data."""
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def words(s):
    return WORD.findall(lower(s or ""))


def shingles(s, k=5):
    w = words(s)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, percent=80):
    """{doc_id: component} of {doc_id: text} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(docs, key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        if not sets[a]:
            continue
        for b in ids[i + 1:]:
            if len(sets[b]) * percent > len(sets[a]) * 100:
                break
            meet = len(sets[a] & sets[b])
            if 100 * meet >= percent * (len(sets[a]) + len(sets[b]) - meet):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (find(d), len(sets[d])) for d in docs}


# ------------------------------------------------------------ repair of conversations


def damage(rows):
    """{conv_id: [(turn, role, text)]} of (conv_id, turn, role, text) rows after their damage."""
    out = {}
    for conv, turn, role, text in rows:
        said = [" " if v is None else v for v in (conv, turn, role, text)]
        dealt = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        kept = out.setdefault(conv, [])
        if dealt == 1:
            text = ""
        elif dealt == 2:
            text = re.sub("[.!?]", "", text)
        elif dealt == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(dealt, 1)
    return out


def _next(state, ch):
    """State after a role initial; None if the conversation is no longer sound."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, ch))


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by trying every edit at every row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        chars = re.findall("[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not chars else "twice" if (role, text) in seen else "ok" if chars[-1] in ".!?" else "cut")
        seen.add((role, text))
    first = [(role + " ")[0] for _, role, _ in rows]
    best = {}

    def rest(i, state, made):
        if (i, state, made) not in best:
            ways = [(0, "")] if i == len(rows) and state in ("", "a") else []

            def way(cost, edit, then):
                if then:
                    ways.append((cost + then[0], edit + then[1]))
            for ch in "ua":
                if made < 3 and _next(state, ch):
                    way(2, "I", rest(i, _next(state, ch), made + 1))
            if i < len(rows):
                way(3, "D", rest(i + 1, state, 0))
                if kinds[i] in ("ok", "cut"):
                    more = int(kinds[i] == "cut")
                    if _next(state, first[i]):
                        way(more, "K", rest(i + 1, _next(state, first[i]), 0))
                    for ch in "ua":
                        if _next(state, ch):
                            way(2 + more, "R", rest(i + 1, _next(state, ch), 0))
            best[i, state, made] = min(ways, default=None)
        return best[i, state, made]

    cost, audit = rest(0, "", 0)
    lines, state, k = [], "", 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[k][1:]
        ch = first[k] if edit == "K" else "a" if state == "u" else "u"
        k += edit != "I"
        if edit != "D":
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[ch]) + ":" + text)
            state = ch
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, kinds.count("blank"), kinds.count("twice"), kinds.count("cut"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


# ------------------------------------------------------------ hard negatives


def hard_negatives(rows):
    """Rows (vec_id, vector, label) scored pair by pair."""
    fine = [(i, [math.floor(256 * float(x)) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows
            if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(fine):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == lab) for b, (j, w, other) in enumerate(fine) if b != a)
        for score, j, _ in [s for s in scored if s[2]][:5]:
            ok = [s for s in scored if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(i, j, n, k, -score, -low) for n, (low, k, _) in enumerate(ok[:10], 1)]
    return sorted(out)
