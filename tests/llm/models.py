"""Brute-force models of the training-data operators, and rows that try their corners."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("sid", T.IntegerType()), T.StructField("n_words", T.StringType()), T.StructField("w", T.StringType())])
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "r", 1, "n", "w") for i, t in rows], SCHEMA).repartition(parts)


def corner_rows(seed=1, n=60):
    """Nulls, blanks, very long texts, exact and near copies, repeated rows."""
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "é", "naïve", "zu", "10", "of", "the"] + [f"w{i}" for i in range(200)]
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one two three"), (5, " lead and trail \n")]
    base = [say(rnd.randrange(40, 120)) for _ in range(6)]
    for i in range(10, 10 + n):
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 8])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t) if rnd.random() < 0.8 else say(rnd.randrange(1, 60))))
    rows += [(900, base[0]), (900, base[0]), (901, base[0]), (902, say(6000)), (903, "x" * 50_000), (904, "a\n" * 300)]
    return rows


def near_classes(rows, width=5, num=8, den=10):
    """{doc_id: (class_id, n_links, n_copies)} by comparing every pair of different sets."""
    owners = collections.defaultdict(list)
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        owners[s].append(i)
    sets = [s for s in owners if s]
    links = collections.Counter()
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[sets[a]] += 1
                links[sets[b]] += 1
                root[find(sets[a])] = find(sets[b])
    members = collections.defaultdict(list)
    for s in sets:
        members[find(s)] += owners[s]
    out = {i: (i, 0, 0) for i in owners[frozenset()]}
    for s in sets:
        for i in owners[s]:
            out[i] = (min(members[find(s)]), links[s], len(owners[s]) - 1)
    return out


def repeats(rows, width=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept) of every row."""
    first: dict[bytes, tuple] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for k in range(len(t) - width + 1):
            s = t[k : k + width]
            if s not in first or (i, k) < first[s]:
                first[s] = (i, k)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < (i, k):
                gone[k : k + width] = b"\1" * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def quality(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = SPACED.findall(t or "")
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(t):
    """Base spans (kind, start, end)."""
    out = []
    for kind, rx in (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in rx.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card":
                total = sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d)))
                if not 13 <= len(d) <= 19 or total % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


def _luhn(d):
    return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0


def _judged(kind, m, before, after, base, pii):
    """The three labelers' votes on one candidate."""
    d = re.sub("[^0-9]", "", m)
    before, after = before[-40:], after[:40]
    if re.search(pii.OTHERS[kind], before):
        near = 0
    elif re.search(pii.CUES[kind], before) or re.search(pii.CUES[kind], after):
        near = 1
    else:
        near = int(not (re.search("[A-Za-z0-9_=/#&?-]$", before) or re.match("[A-Za-z0-9_=/#&-]", after)))
    if kind == "email":
        tail = re.split("[^A-Za-z0-9-]", m)[-1].lower()
        return int(base or (tail.isalpha() and 2 <= len(tail) <= 10)), int(tail in pii.TLDS), near
    if kind == "ip":
        x = [int(v) for v in re.findall("[0-9]+", m)]
        return int(max(x) <= 255), -1 if x[0] == 127 else int(1 <= x[0] <= 223), near
    if kind == "card":
        return int(13 <= len(d) <= 19 and _luhn(d)), int(bool(re.match(pii.IIN, d))), near
    local = not base and re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", m)
    area = re.sub("^(00)?1?", "", d)
    return int(9 <= len(d) <= 15 and (not local or (d[0] in "23456789" and d[3] in "23456789"))), int(area[:1] in tuple("23456789")), near


def personal_spans(rows, pii):
    """{doc_id: all spans}: candidates, votes, EM over single candidates, naive Bayes, each written plainly."""
    found = []
    for i, t in rows:
        t = t or ""
        base = set(personal(t))
        for kind, rx, strict in [(k, r, True) for k, r in (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE))] + [(k, re.compile(r), False) for k, r in pii.LOOSE.items()]:
            ms = list(rx.finditer(t))
            for k, m in enumerate(ms):
                a, b = m.span()
                before, after = t[ms[k - 1].end() if k else 0 : a], t[b : ms[k + 1].start() if k + 1 < len(ms) else len(t)]
                true = strict and (kind, a, b) in base
                n = len(re.sub("[^0-9]", "", m[0]))
                if strict and not true and not (kind == "card" and 13 <= n <= 19 and not re.search("[A-Za-z0-9]$", before) and not re.match("[A-Za-z0-9]", after)):
                    continue
                if not true and any(kind == x and c < b and a < d for x, c, d in base):
                    continue
                found.append((i, kind, a, b, true, *_judged(kind, m[0], before, after, strict, pii), min(n // 4, 5)))
    out = {i: set() for i, _ in rows}
    for kind in pii.KINDS:
        mine = [x for x in found if x[1] == kind]
        loose = [x for x in mine if not x[4]]
        right, share = {5: 0.95, 6: 0.75, 7: 0.65}, pii.SHARE[kind]
        start, pull = dict(right), len(loose) / 4 + 4
        post = {}
        for _ in range(50):
            for x in mine:
                yes, no = share, 1 - share
                for c, r in right.items():
                    if x[c] >= 0:
                        yes, no = yes * (r if x[c] else 1 - r), no * (1 - r if x[c] else r)
                post[x] = 1.0 if x[4] else yes / (yes + no)
            share = min(0.99, max(0.01, (sum(post[x] for x in loose) + pii.SHARE[kind] * pull) / (len(loose) + pull)))
            for c in right:
                voted = [x for x in mine if x[c] >= 0]
                agree = sum(post[x] if x[c] else 1 - post[x] for x in voted)
                right[c] = min(0.99, max(0.51, (agree + start[c] * (len(voted) / 4 + 4)) / (1.25 * len(voted) + 4)))
        yes, no = sum(post[x] for x in mine), sum(1 - post[x] for x in mine)
        for x in mine:
            odds = math.log(sum(post[y] for y in loose) + 1) - math.log(no + 1)
            for c in (5, 6, 7, 8):
                values = len({y[c] for y in mine})
                odds += math.log((sum(post[y] for y in mine if y[c] == x[c]) + 1) / (yes + values)) - math.log((sum(1 - post[y] for y in mine if y[c] == x[c]) + 1) / (no + values))
            if x[4] or odds > 0:
                out[x[0]].add((kind, x[2], x[3]))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items, window=13):
    """{doc_id: (n_words, n_hit, item ids as strings)}."""
    strings = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(UP))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            strings[tuple(w[k : k + m])].add(i)
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(UP))
        hit, found = set(), set()
        for m in {len(s) for s in strings}:
            for k in range(len(w) - m + 1):
                if (s := tuple(w[k : k + m])) in strings:
                    hit |= set(range(k, k + m))
                    found |= strings[s]
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def mixture_weights(tokens, rounds=100):
    """Weights (uniform, unigram, bigram) per bucket by EM, token after token; ``tokens``: (bucket, p0, p1, p2)."""

    def em(rows, start):
        w = list(start)
        for _ in range(rounds if rows else 0):
            got = list(start)
            for p in rows:
                total = sum(a * b for a, b in zip(w, p, strict=True))
                for i in range(3):
                    got[i] += w[i] * p[i] / total
            w = [g / sum(got) for g in got]
        return w

    seen = em([t[1:] for t in tokens if t[0]], [1 / 3] * 3)
    out = collections.defaultdict(lambda: seen)
    for k in {t[0] for t in tokens} | {0}:
        out[k] = em([t[1:] for t in tokens if t[0] == k], seen if k else [seen[0] / (seen[0] + seen[1]), seen[1] / (seen[0] + seen[1]), 0.0])
    return out


def language_model(rows, buckets=48):
    """{doc_id: (held out, n_tokens, n_known, N, base, score)}."""
    toks = {i: SPACED.findall((t or "").translate(UP)) + [None] for i, t in rows}
    crc = {i: zlib.crc32(str(i).encode()) for i in toks}
    train = [i for i in toks if crc[i] % 7 != 2]
    fold = [i for i in train if crc[i] // 7 % 16 == 0]
    pairs = lambda i: list(zip([None, *toks[i][:-1]], toks[i], strict=True))
    uni, bi = collections.Counter(w for i in train for w in toks[i]), collections.Counter(p for i in train for p in pairs(i))
    less_uni = uni - collections.Counter(w for i in fold for w in toks[i])
    less_bi = bi - collections.Counter(p for i in fold for p in pairs(i))

    def parts(p, u, b):
        n, v, c = sum(u.values()), len(u), u[p[0]]
        return min(int(math.log2(c + 1)), buckets - 1), 1 / (v + 1), u[p[1]] / max(n, 1), b[p] / c if c else 0.0

    cells = [parts(p, less_uni, less_bi) for i in fold for p in pairs(i)]
    weights = mixture_weights(cells)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in toks.items():
        score = 0.0
        for p in pairs(i):
            k, p0, p1, p2 = parts(p, uni, bi)
            score += math.log10(weights[k][0] * p0 + weights[k][1] * p1 + weights[k][2] * p2)
        out[i] = (crc[i] % 7 == 2, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score)
    return out
