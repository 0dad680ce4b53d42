"""Jaro similarity, the one expression Spark has no built-in for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: bytes, b: bytes) -> float:
    """Jaro similarity of two byte strings, transpositions halved as whole numbers."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = bytearray(len(b)), []
    for i, x in enumerate(a):
        at = b.find(x, max(0, i - reach), i + reach + 1)
        while at >= 0 and used[at]:
            at = b.find(x, at + 1, i + reach + 1)
        if at >= 0:
            used[at] = 1
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for y, u in zip(b, used) if u)))
    return (m / len(a) + m / len(b) + (m - moved // 2) / m) / 3


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max()))), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return out, size


def jaro_many(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """As jaro, of many pairs at once: a step matches one character of every a."""
    if not a:
        return np.empty(0)
    (x, n), (y, m) = _padded(a), _padded(b)
    rows, columns = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
    free, left = columns < m[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        near = free & (y == x[:, i : i + 1]) & (np.abs(columns - i) <= reach)
        at = near.argmax(axis=1)
        hit = near[rows, at] & (i < n)
        left[:, i] = hit
        free[rows[hit], at[hit]] = False
    used = ~free & (columns < m[:, None])
    common = left.sum(axis=1)
    first = np.take_along_axis(x, np.argsort(~left, axis=1, kind="stable"), axis=1)
    second = np.take_along_axis(y, np.argsort(~used, axis=1, kind="stable"), axis=1)
    width = min(x.shape[1], y.shape[1])
    moved = ((first[:, :width] != second[:, :width]) & (np.arange(width) < common[:, None])).sum(axis=1)
    some = np.maximum(common, 1)
    found = (common / np.maximum(n, 1) + common / np.maximum(m, 1) + (common - moved // 2) / some) / 3
    return np.where(common > 0, found, 0.0)


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched Jaro similarity on UTF-8 bytes; null in, null out."""
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = ([t.encode() for t in s.iloc[there]] for s in (a, b))
    order = np.argsort([len(p) + len(q) for p, q in zip(x, y)], kind="stable") if len(x) else there
    out = np.full(len(a), np.nan)
    for at in range(0, len(order), 2048):
        part = order[at : at + 2048]
        out[there[part]] = jaro_many([x[k] for k in part], [y[k] for k in part])
    found = pd.Series(out, dtype="float64")
    return found.where(~np.isnan(out), None)


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Native bound: Jaro is at most (2 + shorter / longer) / 3, so other pairs need no scoring."""
    x, y = F.octet_length(a), F.octet_length(b)
    return (2 + F.try_divide(F.least(x, y), F.greatest(x, y))) / 3 > cutoff - 0.001
