"""Links between 64-bit fingerprints at a small Hamming distance.

Candidates meet in tables keyed by a few agreeing bit blocks (with d differing bits spread
over d + r blocks, at least r blocks agree, so no link is lost). Inside a bucket the pivot
distance table decides, computed once for every fingerprint and carried along: distances to
fixed reference fingerprints differ by at most the distance of the pair, so a pair whose
largest coordinate difference exceeds the limit is dropped, and survivors are verified on
all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reference fingerprints of the pivot table.
PIVOTS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**64, 24, dtype=np.uint64, endpoint=False)
#: Groups up to this size are compared pair by pair in one vectorised step; larger ones by a search that visits each member once.
SMALL = 24


def block_masks(limit: int, agree: int) -> list[int]:
    """Signed masks of all choices of ``agree`` blocks out of ``limit + agree``."""
    n = limit + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    masks = [sum(chosen) for chosen in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def agreeing(count: int, limit: int) -> int:
    """Blocks that should agree among ``count`` fingerprints, so that a bucket holds few by
    chance; every choice finds the same links."""
    agree = 2
    while 64 * agree // (limit + agree) < math.log2(max(count, 2)) - 5 and agree < 8:
        agree += 1
    return agree


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, one row per pivot."""
    return np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS]).astype(np.int8)


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the pairs (i, j) whose largest coordinate difference is within ``limit``."""
    left = np.arange(len(i))
    for row in table:
        left = left[np.abs(row[i[left]] - row[j[left]]) <= limit]
    return left


def _precomputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, p0, p1, p2): each fingerprint with its distances to the pivots, a byte each."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        packed = np.ascontiguousarray(pivot_table(fp).T).view(np.int64).reshape(-1, len(PIVOTS) // 8)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in packed.T)], ["fp", "p0", "p1", "p2"])


def _unpacked(columns: list[np.ndarray]) -> np.ndarray:
    """The pivot table of rows that carry it, one row per pivot."""
    return np.ascontiguousarray(np.stack(columns, axis=1)).view(np.int8).reshape(-1, len(PIVOTS)).T


def forest(fp: np.ndarray, limit: int, table: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each linked set of ``fp``: every member is visited once and then
    compared only with members not reached before."""
    rest = np.arange(len(fp))
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = rest
            for row in table:
                near = near[np.abs(row[near] - row[at]) <= limit]
            near = near[np.bitwise_count(fp[near] ^ fp[at]) <= limit]
            if len(near):
                a.append(np.full(len(near), at))
                b.append(near)
                queue.extend(near)
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def _bucket_links(fp: np.ndarray, table: np.ndarray, start: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside the buckets of ``fp`` that begin at ``start``."""
    size = np.diff(np.append(start, len(fp)))
    for n in np.unique(size):
        if n == 1:
            continue
        first = start[size == n]
        if n <= SMALL:
            i, j = np.triu_indices(n, 1)
            i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            left = survivors(table, i, j, limit)
            i, j = i[left], j[left]
            left = np.bitwise_count(fp[i] ^ fp[j]) <= limit
            yield fp[i[left]], fp[j[left]]
        else:
            for s in first:
                i, j = forest(fp[s : s + n], limit, table[:, s : s + n])
                yield fp[s + i], fp[s + j]


def _links_of_sorted(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(key, fp, *packed):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for a, b in _bucket_links(fp, _unpacked(list(packed)), start, limit):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key, fp, *packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            if not len(key):
                continue
            held.append((key, fp.view(np.uint64), *packed))
            last = np.flatnonzero(key != key[-1])
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                whole = sum(len(x[0]) for x in held) - (batch.num_rows - cut)
                every = [np.concatenate(x) for x in zip(*held)]
                yield from out(*(x[:whole] for x in every))
                held = [tuple(x[whole:] for x in every)]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held)))

    return run


def hamming_links(prints: DataFrame, limit: int, agree: int) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``limit`` differing bits.

    ``prints`` has one long column of distinct fingerprints. Every pair within the limit is
    connected by the links of some bucket; inside a large bucket a spanning set of links is
    returned instead of all pairs. No rows in, no rows out.
    """
    tabled = prints.select(F.col(prints.columns[0]).alias("fp")).mapInArrow(_precomputed, "fp long, p0 long, p1 long, p2 long")
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(limit, agree)])
    # One long as key sorts by radix; should two keys ever collide, their buckets are compared as one.
    keyed = tabled.select(F.posexplode(masks).alias("t", "mask"), "fp", "p0", "p1", "p2").select(
        F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "p0", "p1", "p2"
    )
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links_of_sorted(limit), "a long, b long").distinct()
