"""Plain versions of operators, shared by tests."""

import re

WORD = "[^\x20\x09-\x0d]+"


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows, percent=80):
    """doc_id, set size, component of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def repeats(rows, window=13):
    """doc_id, words, removed words, kept text of each row."""
    cut = [re.findall(WORD, t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, cut, strict=True):
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, cut, strict=True):
        gone = {j for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)
