"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def remove_repeats(rows, size=20):
    """rows: (doc_id, text), ids distinct -> {doc_id: (n_words, n_removed, sha256)}"""
    seen, gone = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone[i] = [False] * len(w)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            if key in seen:
                gone[i][j : j + size] = [True] * size
            seen.add(key)
    out = {}
    for i, text in rows:
        w = words(text)
        left = [x for x, g in zip(w, gone[i], strict=True) if not g]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def shingle_set(text, k=5):
    w = words((text or "").translate(FOLD))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}


def components(rows, num, den, k=5):
    """{doc_id: (n_shingles, smallest linked doc_id)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
