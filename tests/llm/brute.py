"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import math
import re

import numpy as np


class Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)

    def least(self, ids: list[int]) -> list[int]:
        low: dict[int, int] = {}
        for k, i in enumerate(ids):
            low[self.find(k)] = min(low.get(self.find(k), i), i)
        return [low[self.find(k)] for k in range(len(ids))]


def shingles(text: str | None, width: int) -> set[tuple]:
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(rows: list[tuple[int, str | None]], width: int, threshold: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component)."""
    sets = [shingles(t, width) for _, t in rows]
    groups, lists = Sets(len(rows)), collections.defaultdict(list)
    for k, s in enumerate(sets):
        both = collections.Counter(j for g in s for j in lists[g])
        for j, n in both.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                groups.join(k, j)
        for g in s:
            lists[g].append(k)
    low = groups.least([i for i, _ in rows])
    return {i: (len(sets[k]), low[k]) for k, (i, _) in enumerate(rows)}


def near_vectors(ids: list[int], vectors: list, least: float) -> dict[int, tuple[int, int]]:
    """vec_id to (links, component)."""
    def fine(v) -> bool:
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    groups, links = Sets(len(ids)), [0] * len(ids)
    for a in range(len(ids)):
        for b in range(a):
            if fine(vectors[a]) and fine(vectors[b]) and len(vectors[a]) == len(vectors[b]):
                u, v = (np.array(vectors[k], float) for k in (a, b))
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                    groups.join(a, b)
                    links[a] += 1
                    links[b] += 1
    low = groups.least(ids)
    return {i: (links[k], low[k]) for k, i in enumerate(ids)}


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def backoff_scores(train: list[list], texts: list[list], least: int = 2, discount: float = 0.75) -> list[float]:
    """log10 probability of each text (words, then None for its end) by absolute discounting over whole words."""
    n = [collections.Counter() for _ in range(4)]
    histories = [collections.Counter() for _ in range(3)]
    for ws in train:
        padded = ["<s>", "<s>", *ws]
        for i in range(2, len(padded)):
            for order in (1, 2, 3):
                n[order][tuple(padded[i - order + 1 : i + 1])] += 1
                histories[order - 1][tuple(padded[i - order + 1 : i])] += 1
    kept = [collections.defaultdict(float) for _ in range(3)]
    for order in (2, 3):
        for gram, count in n[order].items():
            if count >= least:
                kept[order - 1][gram[:-1]] += count - discount
    total, distinct = sum(n[1].values()), len(n[1])

    def p(gram: tuple) -> float:
        if len(gram) == 1:
            return (n[1][gram] + 1) / (total + distinct + 1)
        history = gram[:-1]
        lower = p(gram[1:])
        if not kept[len(history)][history]:
            return lower
        times = histories[len(history)][history]
        own = (n[len(gram)][gram] - discount) / times if n[len(gram)][gram] >= least else 0.0
        return own + (1 - kept[len(history)][history] / times) * lower

    out = []
    for ws in texts:
        padded = ["<s>", "<s>", *ws]
        out.append(sum(math.log10(p(tuple(padded[i - 2 : i + 1]))) for i in range(2, len(padded))))
    return out
