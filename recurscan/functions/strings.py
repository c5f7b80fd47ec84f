"""String similarities that Spark has no function for (Arrow batches), and those that it has."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append((i, j))
                break
    if not hits:
        return 0.0
    theirs = [b[j] for j in sorted(j for _, j in hits)]
    moved = sum(a[i] != y for (i, _), y in zip(hits, theirs)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    s = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + same * weight * (1 - s) if s > 0.7 else s


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions / total length."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def _pairs(f, kind):
    return F.pandas_udf(lambda a, b: pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)]), kind)


def jaro_similarity(a: Column, b: Column) -> Column:
    return _pairs(jaro, T.DoubleType())(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _pairs(jaro_winkler, T.DoubleType())(a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return _pairs(indel_ratio, T.DoubleType())(a, b)


_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _piecewise(data: bytes, size: int, length: int = 64) -> str:
    """A character for each stretch that ends where the rolling sum of seven bytes is size - 1 modulo size."""
    out, h, last = [], 0x28021967, [0] * 7
    a = b = c = 0
    for i, x in enumerate(data):
        b += 7 * x - a
        a += x - last[i % 7]
        last[i % 7] = x
        c = (c << 5 & 0xFFFFFFFF) ^ x
        h = h * 0x01000193 & 0xFFFFFFFF ^ x
        if (a + b + c) % size == size - 1 and len(out) < length - 1:
            out.append(_B64[h & 63])
            h = 0x28021967
    if data:
        out.append(_B64[h & 63])
    return "".join(out)


def fuzzy_digest(text: str) -> str:
    """size:chunks:chunks at twice the size, in the manner of context-triggered piecewise hashing."""
    data = text.encode()
    size = 3
    while size * 64 < len(data):
        size *= 2
    first = _piecewise(data, size)
    while size > 3 and len(first) < 32:
        size //= 2
        first = _piecewise(data, size)
    return f"{size}:{first}:{_piecewise(data, 2 * size, 32)}"


def fuzzy_score(a: str, b: str) -> int:
    """0 to 100; 0 where the sizes don't meet or no seven characters in a row are common."""
    x, y = a.split(":"), b.split(":")
    best = 0
    for i, p in ((0, x[1]), (1, x[2])):
        for j, q in ((0, y[1]), (1, y[2])):
            if int(x[0]) << i == int(y[0]) << j and p and q:
                grams = {p[k : k + 7] for k in range(max(1, len(p) - 6))}
                if p == q or any(q[k : k + 7] in grams for k in range(len(q) - 6)):
                    best = max(best, round(100 * indel_ratio(p, q)))
    return best


def fuzzy_hash(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else fuzzy_digest(t)), T.StringType())(c)


def fuzzy_similarity(a: Column, b: Column) -> Column:
    return _pairs(fuzzy_score, T.IntegerType())(a, b)
