"""Name similarity, which Spark lacks: Arrow-batched functions over pairs of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str, prefix: float = 0.1) -> float:
    """Jaro similarity, raised by a common prefix of up to four letters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    mine: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * prefix * (1 - jaro) if jaro > 0.7 else jaro


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths."""
    if not a and not b:
        return 1.0
    last = [0] * (len(b) + 1)
    for c in a:
        now = [0]
        for j, d in enumerate(b):
            now.append(last[j] + 1 if c == d else max(now[j], last[j + 1]))
        last = now
    return 2 * last[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger of Jaro-Winkler and token-sort ratio of two fuzzy forms; 0 if either is empty."""
    return pd.Series([max(jaro_winkler(x, y), token_sort_ratio(x, y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")
