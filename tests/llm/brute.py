"""Plain definitions of the results, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(rows, percent=75, length=5):
    """{id: (shingles, component)}"""
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + length]) for j in range(len(w) - length + 1)} if len(w) >= length else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    shared = Counter((a, b) for m in held.values() for k, b in enumerate(m) for a in m[:k])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def passages(rows, window):
    """[(id, words, removed, digest)]"""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[j : j + window]) for _, w in texts for j in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        covered = {x for j in range(len(w) - window + 1) if count[tuple(w[j : j + window])] > 1 for x in range(j, j + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in covered)
        out.append((i, len(w), len(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)
