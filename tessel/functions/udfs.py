"""Functions that Spark lacks, as Arrow-batched pandas UDFs: longest common subsequences, compressibility."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of one longest common subsequence; of equal choices the first list advances."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(DoubleType())
def gzip_ratio(text: pd.Series) -> pd.Series:
    """Compressed bytes over bytes; null for null, 1 for empty."""
    return text.map(lambda t: None if t is None else len(gzip.compress(t.encode(), mtime=0)) / len(t.encode()) if t else 1.0)
