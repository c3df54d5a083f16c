"""Plain single-machine versions that the operators are compared with."""

from __future__ import annotations

import hashlib
from collections import Counter


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def components(rows, num, den, n):
    """id -> (shingles, smallest id reachable); rows of (id, text) with distinct ids."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in where[g] if j < i).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def repeats(rows, width=50):
    """id -> (words, removed, digest of what is kept)."""
    first: dict = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def repeated_words(w, width=3):
    count = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return len({i + k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(width)})
