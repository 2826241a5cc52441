"""Exact medians and deviations of what lies within a time of each of many questions.

Points are kept in the order of time as a wavelet tree: for each bit of a value's rank, how many of the points up to a place have it
unset. The k-th smallest of any run of points takes a look-up a bit, for all questions at once, and points to be left out are counted
in a tree of their own. So the work grows with points and questions times the bits, not with their pairs.
"""

from __future__ import annotations

import numpy as np


class Ordered:
    """Points in the order of time."""

    def __init__(self, at: np.ndarray, values: np.ndarray, ranks: np.ndarray, bits: int, middle: int):
        order = np.argsort(at, kind="stable")
        self.at, far = at[order], values[order] - middle
        exact = np.int64 if len(far) == 0 or int(np.abs(far).max()) ** 2 * len(far) < 2**62 else object
        far = far.astype(exact)
        self.s1, self.s2 = (np.concatenate([np.zeros(1, exact), np.cumsum(v, dtype=exact)]) for v in (far, far * far))
        self.unset, now = [], ranks[order]
        for b in reversed(range(bits)):
            bit = (now >> b) & 1 == 0
            self.unset.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            now = np.concatenate([now[bit], now[~bit]])

    def span(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.at, low, "left"), np.searchsorted(self.at, high, "right")


def kth(every: Ordered, less: Ordered, spans, k: np.ndarray, bits: int) -> np.ndarray:
    """The rank of the k-th smallest (from 0) of each span of every without those in the span of less."""
    own, found, k = [list(s) for s in spans], np.zeros(len(k), np.int64), k.copy()
    for i, b in enumerate(reversed(range(bits))):
        before = [[t.unset[i][p] for p in s] for t, s in zip((every, less), own, strict=True)]
        low = (before[0][1] - before[0][0]) - (before[1][1] - before[1][0])
        up = k >= low
        own = [[np.where(up, t.unset[i][-1] + p - z, z) for p, z in zip(s, zs, strict=True)] for t, s, zs in zip((every, less), own, before, strict=True)]
        k, found = k - np.where(up, low, 0), found | (up.astype(np.int64) << b)
    return found


def statistics(at: np.ndarray, values: np.ndarray, left_out: tuple[np.ndarray, np.ndarray], asked: np.ndarray, width: int, tree: Ordered | None = None):
    """(n, median, population deviation, tree) of the points within width of each time asked, without those left out; the tree may be used again."""
    distinct = np.unique(values)
    bits, middle = max(1, int(len(distinct) - 1).bit_length()), int(distinct[len(distinct) // 2]) if len(distinct) else 0
    make = lambda t, v: Ordered(t, v, np.searchsorted(distinct, v), bits, middle)
    tree = tree or make(at, values)
    less = make(*left_out)
    spans = [t.span(asked - width, asked + width) for t in (tree, less)]
    part = lambda name: [getattr(tree, name)[spans[0][1]] - getattr(tree, name)[spans[0][0]], getattr(less, name)[spans[1][1]] - getattr(less, name)[spans[1][0]]]
    n = (spans[0][1] - spans[0][0]) - (spans[1][1] - spans[1][0])
    s1, s2 = ([int(a) - int(b) for a, b in zip(*part(name), strict=True)] for name in ("s1", "s2"))
    some = n > 0
    halves = [distinct[kth(tree, less, spans, np.where(some, k, 0), bits)[some]] for k in ((n - 1) // 2, n // 2)]
    median, spread = np.full(len(n), np.nan), np.full(len(n), np.nan)
    median[some] = (halves[0].astype(float) + halves[1].astype(float)) / 2
    spread[some] = [float(b * int(m) - a * a) ** 0.5 / int(m) for a, b, m in zip(s1, s2, n, strict=True) if m > 0]
    return n, median, spread, tree
