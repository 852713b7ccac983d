"""Plain restatements of what the operators promise, for small tables."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, percent=80):
    """Of (key, text) rows: [(key, size, smallest key reachable)]."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(sets[i]), low.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def strike(rows, window=35):
    """Of (key, text) rows: [(key, words, removed, kept)]."""
    seen = {}
    lists = [words(t, lower=False) for _, t in rows]
    for w in lists:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for (k, _), w in zip(rows, lists, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contained(docs, items, size=5, threshold=0.8):
    """{(key, item)} with at least the threshold of the item's shingles in the document."""
    found = set()
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(size, len(w))
        own = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)}
        for k, text in docs:
            d = words(text)
            there = {tuple(d[j:j + n]) for j in range(len(d) - n + 1)}
            if len(own & there) >= threshold * len(own):
                found.add((k, i))
    return found


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def counts(text, least_words=20, most_repeated=30):
    """(words, their code points, symbols, repeated lines, words in repeated 8-word windows, fails the counts)."""
    w = words(text, lower=False)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
            len(w) < least_words or 100 * len(again) > most_repeated * len(w))


def _classes(text):
    out = [0] * 8
    for c in text:
        kind = unicodedata.category(c)
        out[4 if c in " \t\n\x0b\x0c\r" else 5 if c in "#*$%&|<>" else {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2}.get(kind, {"M": 2, "N": 3, "P": 6}.get(kind[0], 7))] += 1
    return out


def _apart(p, q):
    half = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q, strict=True) if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q, strict=True) if b)
    return math.sqrt(max(0, half / 2))


def quality(rows, class_limit=0.28, word_limit=0.46, common=50):
    """Of (key, text, lang) rows: [(key, counts..., kept)]."""
    base = [counts(t) for _, t, _ in rows]
    sums = defaultdict(lambda: ([0] * 8, Counter(), [0]))
    for (_, t, lang), c in zip(rows, base, strict=True):
        if lang is not None and not c[5]:
            classes, found, n = sums[lang]
            n[0] += 1
            for i, x in enumerate(_classes(t)):
                classes[i] += 1_000_000 * x // len(t)
            for x, k in Counter(words(t)).items():
                found[x] += 1_000_000 * k // c[0]
    refs = []
    for classes, found, n in sums.values():
        top = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:common]
        refs.append(([x / sum(classes) for x in classes], {x: k / (1_000_000 * n[0]) for x, k in top}))
    out = []
    for (k, t, _), c in zip(rows, base, strict=True):
        own, all_ = Counter(words(t)), max(1, len(t or ""))
        good = not refs
        for classes, top in refs:
            p = [own[x] / max(1, c[0]) for x in top]
            far = _apart([*p, max(0, 1 - sum(p))], [*top.values(), max(0, 1 - sum(top.values()))])
            good |= (_apart([x / all_ for x in _classes(t or "")], classes) <= class_limit or c[1] < 250) and (far <= word_limit or c[0] < 60)
        out.append((k, *c, good and not c[5]))
    return out


def alignment(rows, a, b, a_bytes, b_bytes):
    """Of (key, text) rows under tokenizers ``a`` and ``b`` (text to ids): the rows of the alignment."""
    total, parts = Counter(), []
    for k, t in rows:
        x, y = (a(" " + t), b(t)) if t else ([], [])
        if t and {b"".join(map(a_bytes, x)), b"".join(map(b_bytes, y))} != {(" " + t).encode()}:
            x = y = []
        spans = []
        for ids, size in ((x, a_bytes), (y, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size(i)), i))
                at += len(size(i))
            spans.append(own)
        links, j = [], 0
        for begin, end, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= begin:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][0] < end:
                links.append((i, spans[1][m][2]))
                m += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([], []) for _ in ends]
        for side in (0, 1):
            for _, e, i in spans[side]:
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        total.update(links)
        parts.append((k, len(x), len(y), groups, links))
    top = Counter()
    for (_, i), n in total.items():
        top[i] = max(top[i], n)
    text = [";".join(",".join(p) + "|" + ",".join(q) for p, q in g) for _, _, _, g, _ in parts]
    return [(k, n, m, len(g), len(li), sum(total[x] == top[x[1]] for x in li), sum(total[x] for x in li), hashlib.sha256(t.encode()).hexdigest() if t else "")
            for (k, n, m, g, li), t in zip(parts, text, strict=True)]


def trie(rows, group=20, most=4):
    """Of (conversation, turn, role, text) rows: the nodes of the prefix trie, by name."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    members, ends, children, leaves, saved = defaultdict(set), defaultdict(list), defaultdict(list), {}, {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % most
        full = tuple(conv.get(c - int(math.fmod(c, group)), [])[:h] + own[h:])
        for d in range(len(full) + 1):
            members[full[:d]].add(c)
        ends[full].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) + sum(saved[k] for k in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())
