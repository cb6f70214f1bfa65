"""String similarities that Spark has no function for, as Arrow-batched pandas UDFs over distinct pairs.

Callers join or block first, so that only candidate pairs get here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [b[j] for j, u in enumerate(used) if u]
    m, swapped = len(first), sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_pair(a: str, b: str) -> float:
    """Jaro with a bonus of a tenth for each common first character, up to four, where Jaro is over 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + 0.1 * same * (1 - base)


def damerau_pair(a: str, b: str) -> float:
    """1 less the optimal-string-alignment distance over the longer length."""
    if not a and not b:
        return 1.0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return 1 - last[-1] / max(len(a), len(b))


def _batched(pair):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for key in zip(a, b):
            if key not in known:
                known[key] = None if key[0] is None or key[1] is None else pair(*key)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    over.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return over


#: Jaro-Winkler of two columns, null if one is null.
jaro_winkler = F.pandas_udf(_batched(jaro_winkler_pair), DoubleType())
#: Normalised Damerau-Levenshtein of two columns, null if one is null.
damerau = F.pandas_udf(_batched(damerau_pair), DoubleType())
