"""Brute-force versions of the contracts, in plain Python."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, window=35):
    """rows: list of texts; per row (n_words, n_removed, kept text)."""
    words = [WORD.findall(t or "") for t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)))
    return out


def quality(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def leaks(texts, items, window=10):
    patterns = collections.defaultdict(set)
    for key, text in items:
        w = BENCH.findall(lower(text))
        for k in range(max(len(w) - window + 1, min(len(w), 1))):
            patterns[tuple(w[k : k + window])].add(key)
    sizes = {len(p) for p in patterns}
    out = []
    for text in texts:
        w, hit, found = BENCH.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[p]
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out
