"""Fuzzy string similarity: the indel (longest-common-subsequence) ratio of 0 to 100.

score = 100 * 2 * LCS / (len(a) + len(b)). Two empty strings score 100; a null on
either side gives null. Substitutions cost two, so this is not Levenshtein.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one machine-integer row per sign of b."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a:
        return start
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    v = mask
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & mask
    return start + (mask & ~v).bit_count()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    """Indel ratio of two string columns, not rounded."""
    return _ratio(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Cheap and lossless test in the JVM: can the ratio reach ``least``? LCS is at most the shorter length."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
