"""Similarities: of bit patterns, vectors and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL if a vector is NULL or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for j, y in enumerate(b) if used[j]]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler_of(a: str | None, b: str | None) -> float | None:
    """Prefix of up to four characters counts a tenth each; without a threshold for the bonus."""
    if a is None or b is None:
        return None
    j = _jaro(a, b)
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity in Arrow batches; repeated pairs of a batch are computed once."""
    seen: dict = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, jaro_winkler_of(*p)) for p in zip(a, b, strict=True)], dtype="float64")
