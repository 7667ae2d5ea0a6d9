"""Plain Python versions of the corpus operators' rules, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w.translate(_LOWER) for w in WORD.findall(text or "")]


def shingles(text: str | None, k: int) -> list[tuple]:
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def components(texts: dict[int, str | None], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: set(shingles(t, k)) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, shared in Counter(j for x in s for j in holders[x] if j > i).items():
            if shared * den >= num * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def targets(sizes: dict, most: int, weights=(5, 2, 1)) -> dict:
    """Clamp what is above its cap and share the excess by weight until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, held = total - sum(fixed.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / held for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}
