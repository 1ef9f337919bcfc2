"""Plain versions of the operators, row by row."""

import collections
import hashlib
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def substrings(rows, width=35):
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[k:k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        drop = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k:k + width])] > 1:
                drop[k:k + width] = [True] * width
        out.append((i, len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)))
    return out


def jaccard(rows, n=5, percent=80):
    """(row's id, set size, component) of rows with different ids, copies aside."""
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(rows, bench, width=13):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        if 0 < len(w) < width:
            windows[tuple(w)].add(str(i))
        for k in range(len(w) - width + 1):
            windows[tuple(w[k:k + width])].add(str(i))
    out = []
    for i, t in rows:
        w, items = words(t), set()
        hit = [False] * len(w)
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k:k + size]))
                if found:
                    items |= found
                    hit[k:k + size] = [True] * size
        out.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def key(row):
    return tuple((x is not None, str(x)) for x in row)
