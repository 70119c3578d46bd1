"""Brute-force versions of the operators, in plain Python on small inputs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall(text or "")


def cut(rows, window):
    """(id, words, removed, kept words) of each row."""
    lists = [tokens(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, lists, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def shingles(text, k=5):
    w = tokens((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, linked):
    """Smallest id of each row's component; linked(i, j) on row numbers."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= percent * len(sets[i] | sets[j])

    found = components([d for d, _ in rows], linked)
    return sorted((d, len(s), c, c == d) for (d, _), s, c in zip(rows, sets, found, strict=True))


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def passages(seed=1, documents=50):
    """Documents made of slices of one text and of fresh words, in all kinds of white space."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [draw.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(documents):
        w = []
        for _ in range(draw.randint(0, 4)):
            if draw.random() < 0.6:
                a = draw.randint(0, 250)
                w += base[a : a + draw.randint(20, 70)]
            else:
                w += [draw.choice(vocabulary) for _ in range(draw.randint(1, 60))]
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(w)))
    return rows


def copies(seed=3, groups=10):
    """Groups of near copies, by replaced words; ids in random order."""
    draw = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(2000)]
    texts = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, 160))]
        for _ in range(draw.choice([1, 3, 25])):
            w = list(base)
            for _ in range(draw.randint(0, 5)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            texts.append(" ".join(w))
    draw.shuffle(texts)
    return list(enumerate(texts))


def thue_morse(letters=2048, a="a", b="b"):
    """A word and its complement that a polynomial hash modulo a power of two can't tell apart, whatever its base."""
    word = "".join((a, b)[bin(i).count("1") % 2] for i in range(letters))
    return word, word.translate(str.maketrans(a + b, b + a))
