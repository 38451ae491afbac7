"""Brute force that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def documents(spark, texts, **extra):
    """texts: (doc_id, text) or (doc_id, text, lang, source)."""
    rows = [(t[0], t[1], t[2] if len(t) > 2 else "en", t[3] if len(t) > 3 else "s", len(t[1] or "")) for t in texts]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text, n=5):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(texts, least=75):
    """doc_id -> (set size, smallest doc_id reachable), over (doc_id, text)."""
    sets = {i: shingle_set(t) for i, t in texts}
    found = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            found[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        counts = defaultdict(int)
        for x in s:
            for j in found[x]:
                counts[j] += 1
        for j, both in counts.items():
            if 100 * both >= least * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def prose(rng, n, vocabulary=4000):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = ["e%d" % rng.randrange(10**6)] * rng.randrange(1, 3)
    return " ".join(w)
