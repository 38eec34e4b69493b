"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def read(sf_dir, table):
    return pd.read_parquet(f"{sf_dir}/{table}.parquet")


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def components(ids, edges):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(texts: dict, size=4):
    """id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    by, edges = {}, set()
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    tried = {(a, b) for x in by.values() for a in x for b in x if a < b}
    for a, b in tried:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            edges.add((a, b))
    comp = components(list(texts), edges)
    return {i: (len(sets[i]), comp[i]) for i in texts}


def repeat_words(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    return len(hit)


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    rep = repeat_words(t)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep,
            len(w) < 50 or 100 * rep > 50 * len(w))


def mix_taken(rows, weights=(3, 1, 2), seed="mix"):
    """(doc_id, source, size) rows to (source_size, target, taken) rows, resharing step by step."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(2 * sizes[s]) if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    out, at = {}, Counter()
    key = lambda k: (hashlib.md5(f"{seed}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:16], rows[k][2])
    for k in sorted(range(len(rows)), key=key):
        _, s, n = rows[k]
        goal = int(target[s])
        taken = sum(max(0, min(n, goal - p * sizes[s] - at[s])) for p in (0, 1))
        out[k] = (sizes[s], float(target[s]), taken)
        at[s] += n
    return [out[k] for k in range(len(rows))]


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
        if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
