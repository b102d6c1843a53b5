"""Jaro-Winkler similarity (STR-07) and lossless bounds for joins on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for j, c in enumerate(b) if not free[j]]
    half = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, boost_above: float = 0.7) -> float:
    """Jaro similarity plus a tenth of what is missing per equal first letter, four at most, above ``boost_above``."""
    j = jaro(a, b)
    if j <= boost_above:
        return j
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


class Candidates:
    """A catalogue for many similarity searches at one threshold. Bounds cut candidates without loss: with an equal prefix of p
    letters a similarity of t needs a Jaro value of (t - p/10) / (1 - p/10), hence enough letters in common. The bounds of all
    names are array operations; letters are counted by their place in a table, which never gives less in common."""

    PLACES = 64

    def __init__(self, names: list[str]):
        self.names = sorted(set(names))
        self.size = np.array([len(n) for n in self.names], float)
        self.letters = np.zeros((len(self.names), self.PLACES), np.int16)
        self.first = np.full((len(self.names), 4), -1, np.int32)
        for i, n in enumerate(self.names):
            for c in n[:30_000]:
                self.letters[i, ord(c) % self.PLACES] += 1
            self.first[i, : min(4, len(n))] = [ord(c) for c in n[:4]]
        # names longer than the counts hold are always compared
        self.long = self.size > 30_000

    def search(self, q: str, threshold: float, top: int = 2) -> list[tuple[str, float]]:
        """The best ``top`` names at or above the threshold, ties in name order."""
        if not q or not self.names:
            return []
        bag = np.zeros(self.PLACES, np.int64)
        for c in q:
            bag[ord(c) % self.PLACES] += 1
        head = np.full(4, -2, np.int32)
        head[: min(4, len(q))] = [ord(c) for c in q[:4]]
        prefix = np.cumprod(self.first == head, axis=1).sum(axis=1)
        need = (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)
        size = np.maximum(self.size, 1)
        # the lengths alone first
        least = np.minimum(len(q), self.size)
        near = np.flatnonzero(((least / len(q) + least / size + 1) / 3 >= need - 1e-9) & (self.size > 0))
        common = np.minimum(self.letters[near], bag).sum(axis=1)
        near = near[((common / len(q) + common / size[near] + 1) / 3 >= need[near] - 1e-9) | self.long[near]]
        found = [(self.names[i], s) for i in near if (s := jaro_winkler(q, self.names[i])) >= threshold]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:top]
