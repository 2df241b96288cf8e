"""Edit distance with adjacent swaps (optimal string alignment), and the budget by length.

Spark's ``levenshtein`` has no swaps. One swap costs it two steps, so it never exceeds twice the distance:
that bound, JVM-side and with an early exit, sifts pairs before the exact distance in an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str, most: int | None = None) -> int:
    """Distance, or most + 1 as soon as it must exceed ``most``."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if most is not None and min(row) > most and min(last) > most:
            return most + 1
        older, last = last, row
    return last[-1] if most is None else min(last[-1], most + 1)


FAR = 1 << 20


def _letters(words: list[str], lengths: np.ndarray) -> np.ndarray:
    """Code points of words, a row each, filled up with 0."""
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    out[np.repeat(np.arange(len(words)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(words) else []] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out


def osa_batch(a: list[str], b: list[str], most: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """The distances of many pairs, each at most its ``most`` + 1: all matrices are filled at once, band by band.

    A cell further from the diagonal than the largest bound can't be part of a way that short, so only the band is filled.
    """
    la, lb = (np.array([len(w) for w in words], np.int64) for words in (a, b))
    out = most.astype(np.int64) + 1
    near = np.flatnonzero(np.abs(la - lb) <= most)
    order = near[np.argsort(la[near], kind="stable")]
    start = 0
    while start < len(order):
        # Pairs of like lengths share a block of bounded size.
        widest = max(1, int(la[order[start]]) * 2)
        end = min(len(order), start + max(1, cells // (widest + int(most.max()) + 1)))
        end = start + max(1, int(np.searchsorted(la[order[start:end]], widest, "right")))
        block = order[start:end]
        out[block] = np.minimum(_block(_letters([a[i] for i in block], la[block]), _letters([b[i] for i in block], lb[block]), la[block], lb[block], int(most[block].max())), most[block] + 1)
        start = end
    return out


def _block(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, band: int) -> np.ndarray:
    n, width = y.shape
    rows = np.arange(n)
    last = np.tile(np.arange(width + 1), (n, 1))
    older = np.full_like(last, FAR)
    found = np.where(lx == 0, ly, FAR)
    for i in range(1, x.shape[1] + 1):
        now = np.full_like(last, FAR)
        if i <= band:
            now[:, 0] = i
        for j in range(max(1, i - band), min(width, i + band) + 1):
            cost = np.minimum(np.minimum(last[:, j], now[:, j - 1]) + 1, last[:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                cost = np.where(swap, np.minimum(cost, older[:, j - 2] + 1), cost)
            now[:, j] = cost
        ends = lx == i
        found[ends] = now[rows[ends], ly[ends]]
        older, last = last, now
    return found


@F.pandas_udf(IntegerType())
def osa_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna() & most.notna()).to_numpy()
    out = pd.Series(pd.array([None] * len(a), dtype="Int32"))
    if known.any():
        out[known] = osa_batch(a[known].tolist(), b[known].tolist(), most[known].to_numpy(np.int64)).astype(np.int32)
    return out


def may_be_within(a: Column, b: Column, most: int) -> Column:
    """True for every pair within ``most``; a cheap sieve."""
    return F.levenshtein(a, b, 2 * most) >= 0


def budget(length: Column) -> Column:
    """Distance a word of that length may be corrected over."""
    return F.when(length <= 3, 0).when(length <= 6, 1).otherwise(2)


def budget_of(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 6 else 2
