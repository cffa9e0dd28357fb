"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring_dedup(rows, k=13):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256)."""
    first = {}
    for d, t in rows:
        if d is None:
            continue
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, k=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(ids, links):
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {d: root(d) for d in ids}


def jaccard_classes(rows, percent=75):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id); doc_ids are distinct."""
    sets = {d: shingles(t) for d, t in rows}
    has = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            has[x].add(d)
    links = []
    for d, s in sets.items():
        near = defaultdict(int)
        for x in s:
            for e in has[x]:
                if e > d:
                    near[e] += 1
        links += [(d, e) for e, n in near.items() if 100 * n >= percent * (len(s) + len(sets[e]) - n)]
    found = components(sets, links)
    return sorted((d, len(s), found[d]) for d, s in sets.items())
