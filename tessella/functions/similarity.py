"""Similarities of strings and token sets: column expressions, and Arrow functions where Spark has none."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common(a, b) / F.size(F.array_union(a, b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def guarded(x: Column, y: Column, least: float = 1e-6) -> Column:
    """x / max(y, least)."""
    return x / F.greatest(y, F.lit(least))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def f05(precision: Column, recall: Column) -> Column:
    """F-measure that weights precision; 0 where both are 0."""
    return F.coalesce(F.try_divide(F.lit(1.25) * precision * recall, F.lit(0.25) * precision + recall), F.lit(0.0))


def jaro_winkler_score(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it exceeds 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, deque()).append(j)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        if at := free.get(c):
            while at and at[0] < i - reach:  # reaches only move on, so what lies behind one is never taken
                at.popleft()
            if at and at[0] <= i + reach:
                taken[at.popleft()] = True
                left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    v = mask = (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def ratio_score(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length; two empty strings are alike."""
    return 200 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def window_strands(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """(s, e) such that the longest common subsequence of a and b[i:j] is j - i less the number of s >= i with e < j.

    A strand starts above each place of b and beside each place of a; in a cell of the grid two strands cross where the
    characters match or where they have crossed before. Cells of a diagonal do not depend on each other.
    """
    m, n = len(a), len(b)
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a[::-1], b))
    beside, above = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    for d in range(m + n - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        h, v = beside[m - 1 - d + lo : m - 1 - d + hi], above[lo:hi]
        cross = x[m - 1 - d + lo : m - 1 - d + hi] == y[lo:hi]
        cross |= h > v
        h[:], v[:] = np.where(cross, v, h), np.where(cross, h, v)
    e = np.flatnonzero(above >= m)
    return above[e] - m, e


def partial_score(a: str, b: str) -> float:
    """The best ratio of the shorter string and a stretch of the longer one that is as long or cut off by an end.

    All stretches follow from one grid of the two strings.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = 0.0
    for x, y in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        m, n = len(x), len(y)
        s, e = window_strands(x, y)
        lo, hi = np.maximum(e - m + 1, 0), np.minimum(s, n - m)
        ok = lo <= hi
        lost = np.cumsum(np.bincount(lo[ok], minlength=n + 2) - np.bincount(hi[ok] + 1, minlength=n + 2))[: n - m + 1]
        k = np.arange(1, m)
        front = k - np.cumsum(np.bincount(e, minlength=n))[: m - 1]
        back = k - np.cumsum(np.bincount(s, minlength=n)[::-1])[: m - 1]
        best = max(best, 100 * (m - int(lost.min())) / m, *(float((200 * f / (m + k)).max()) for f in (front, back) if m > 1))
    return best


def token_sort_score(a: str, b: str) -> float:
    return ratio_score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_score(a: str, b: str) -> float:
    """The best ratio among common tokens, and common tokens with either side's own; 0 if a side has no tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (not x - y or not y - x):
        return 100.0
    own = [" ".join(sorted(s)) for s in (both, x - y, y - x)]
    one, two = (" ".join(p for p in (own[0], o) if p) for o in own[1:])
    scores = [ratio_score(one, two)]
    if both:
        scores += [ratio_score(own[0], one), ratio_score(own[0], two)]
    return max(scores)


def token_differences(a: str, b: str, tolerance: float = 65) -> tuple[int, int, int]:
    """(tokens of b that resemble none of a, tokens of a that resemble none of b, characters of the former)."""
    x, y = set(a.split()), set(b.split())
    far = lambda t, others: all(ratio_score(t, u) < tolerance for u in others)
    extra = [t for t in y - x if far(t, x)]
    return len(extra), sum(far(t, y) for t in x - y), sum(map(len, extra))


def scored(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


jaro_winkler = scored(jaro_winkler_score)
ratio = scored(ratio_score)
partial_ratio = scored(partial_score)
token_sort_ratio = scored(token_sort_score)
token_set_ratio = scored(token_set_score)


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("extra", "missing", "extra_length")]))
def token_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([token_differences(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["extra", "missing", "extra_length"])
