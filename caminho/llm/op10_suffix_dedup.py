"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if some string of ``length`` bytes that covers it also starts earlier. Suffixes
only have to be sorted where a match is possible:

1. Each window of ``length`` bytes picks the k-gram of least hash in it as its anchor. Equal
   windows pick equal anchors, so all copies of a window meet under one anchor hash.
2. An anchor occurrence with the bytes of all its windows (its context) equal to an earlier
   one is a copy as a whole; that needs only hashes, and is settled per batch first, so a
   passage in a third of all documents leaves one row a batch.
3. Where one anchor has different contexts, the windows of these are sorted as suffixes.
   The previous smaller position in suffix order gives the longest previous factor; the
   window is a later copy if that factor reaches ``length``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import blobs, lean, lists, to_batch
from .store import materialize, table

#: Bytes of a string that counts as repeated, and of the grams that anchor it.
LENGTH, GRAM = 100, 28
#: An anchor with more different contexts than this is settled window by window, over all executors.
HOT = 4000
#: Windows sorted at once.
BLOCK = 30_000
#: Bytes hashed at once; longer texts are read in overlapping pieces.
PIECE = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(10))
_OF_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_POWER, _INVERSE = (
    np.cumprod(np.r_[np.uint64(1), np.full(PIECE + 4096, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))
)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _prefix(data: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum(_OF_BYTE[data] * _INVERSE[: len(data)]))


def _hashes(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, power: np.ndarray) -> np.ndarray:
    return _mixed((prefix[end] - prefix[start]) * power)


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return x if width == size else np.minimum(x[: len(x) - (size - width)], x[size - width :])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, anchor position, first and last window start, for each anchor of ``data``."""
    found = []
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[base : base + PIECE + length - 1]
        prefix, n = _prefix(piece), len(piece) - gram + 1
        hashes = _hashes(prefix, slice(0, n), slice(gram, n + gram), _POWER[:n])
        least = _sliding_least((hashes & ~_PLACE) | np.arange(n, dtype=np.uint64), length - gram + 1)
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        context = _hashes(prefix, first, last + length, _POWER[first])
        context += (at - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        found.append((hashes[at] | np.uint64(1), context, at + base, first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (*(np.empty(0, np.uint64),) * 2, *(np.empty(0, np.int64),) * 3)


def _later(new: np.ndarray, identity: list[np.ndarray], carried: list[int] | None = None) -> np.ndarray:
    """Rows of runs (beginning where ``new``) that are not the run's first, nor the same place once more.

    ``carried`` is the identity of the first row of a run that began before these rows.
    """
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    other = [x != np.where(first < 0, c, x[first]) for x, c in zip(identity, carried or [0] * len(identity))]
    return ~new & np.logical_or.reduce(other)


def factors(order: list[int], lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest previous factor of every position.

    ``order`` are the positions in suffix order, ``lcp`` the common prefix of each with the
    one before. One stack finds the previous and the next smaller position in suffix order,
    with the least common prefix on the way; source is -1 where nothing earlier matches.
    """
    n = len(order)
    size, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []
    for at, common in zip([*order, -1], [*lcp, 0]):
        while stack and stack[-1][0] > at:
            top, before = stack.pop()
            if stack and before > size[top]:
                size[top], source[top] = before, stack[-1][0]
            if at >= 0 and common > size[top]:
                size[top], source[top] = common, at
            common = min(common, before)
        stack.append((at, common))
    return np.array(size, np.int64), np.array(source, np.int64)


def window_factors(windows: np.ndarray) -> np.ndarray:
    """Length of the longest previous factor of each row of ``windows`` (in text order, equal
    width) among the rows before it, found in the suffix order of the rows' bytes."""
    n, width = windows.shape
    rows = np.ascontiguousarray(windows)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 8192):
        differs = rows[order[at : at + 8192]] != rows[order[at - 1 : at + 8191][: len(order[at : at + 8192])]]
        lcp[at : at + 8192] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return factors(order.tolist(), lcp.tolist())[0]


def longest_previous_factors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, start) of the longest earlier match of each position of one text; start is -1 where nothing earlier matches."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    lcp = [0] * n
    for r in range(1, n):
        a, b = order[r - 1], order[r]
        while max(a, b) + lcp[r] < n and data[a + lcp[r]] == data[b + lcp[r]]:
            lcp[r] += 1
    return factors(order, lcp)


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at << 14) | ((at - first) << 7) | (last - first)


def _unpacked(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window start, last window start."""
    first = (info >> 14) - ((info >> 7) & 127)
    return first, first + (info & 127)


def _sketch(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, ctx, doc, row_key, info): odd h for an open anchor; even h, with the range in ctx, for bytes that surely go."""
        for batch in batches:
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            offsets, data = blobs(batch.column(2))
            parts = [anchors(data[s:e], length, gram) for s, e in zip(offsets[:-1], offsets[1:])]
            count = [len(x[0]) for x in parts]
            h, ctx, at, first, last = (np.concatenate([x[c] for x in parts]) for c in range(5))
            doc, key = np.repeat(doc, count), np.repeat(key, count)
            order = np.lexsort((at, key, doc, ctx, h))
            h, ctx, doc, key, at, first, last = (x[order] for x in (h, ctx, doc, key, at, first, last))
            new = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])][: len(h)]
            again = _later(new, [doc, key, at])
            p, q = np.flatnonzero(again), np.flatnonzero(new)
            p = p[np.lexsort((first[p], key[p], doc[p]))]
            start, end = first[p], last[p]
            joined = np.r_[False, (doc[p[1:]] == doc[p[:-1]]) & (key[p[1:]] == key[p[:-1]]) & (start[1:] == end[:-1] + 1)]
            runs = np.flatnonzero(~joined[: len(p)])
            start, end, p = start[runs], end[np.append(runs[1:], len(p)) - 1] + length if len(p) else end, p[runs]
            spread = _mixed((doc[p] + start).astype(np.uint64)) & ~np.uint64(1)
            yield to_batch(
                h=np.r_[h[q], spread].view(np.int64),
                ctx=np.r_[ctx[q].view(np.int64), (start << 32) | end],
                doc=np.r_[doc[q], doc[p]],
                row_key=np.r_[key[q], key[p]],
                info=np.r_[_packed(at[q], first[q], last[q]), np.zeros(len(p), np.int64)],
            )

    return run


def _settle(length: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (h, ctx, doc, row_key, info): ranges that go (h 0), and contexts to compare under their h (negated: a hot one)."""
        group: int | None = None  # anchor hash of the last row, its context, that context's first place, and the contexts that wait
        last_ctx, place = 0, [0, 0, 0]
        waiting: list[tuple[np.ndarray, ...]] = []
        n_waiting, is_hot = 0, False

        def made(h, doc, key, start, end):
            return to_batch(h=h, doc=doc, row_key=key, s=start, e=end)

        def told(rows: tuple[np.ndarray, ...], flag: int):
            h, doc, key, info = rows
            first, last = _unpacked(info)
            return made((h >> 1 << 1 | flag), doc, key, first, last + length)

        for batch in batches:
            h, ctx, doc, key, info = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            sure = (h & 1) == 0
            if sure.any():
                s = ctx[sure]
                yield made(np.zeros(len(s), np.int64), doc[sure], key[sure], s >> 32, s & 0xFFFFFFFF)
                h, ctx, doc, key, info = (x[~sure] for x in (h, ctx, doc, key, info))
            if not len(h):
                continue
            new_h = np.r_[group is None or h[0] != group, h[1:] != h[:-1]]
            new_ctx = new_h | np.r_[ctx[0] != last_ctx, ctx[1:] != ctx[:-1]]
            again = _later(new_ctx, [doc, key, info], place)
            first, last = _unpacked(info[again])
            yield made(np.zeros(len(first), np.int64), doc[again], key[again], first, last + length)
            if new_ctx.any():
                place = [x[np.flatnonzero(new_ctx)[-1]] for x in (doc, key, info)]
            rows, starts = (h[new_ctx], doc[new_ctx], key[new_ctx], info[new_ctx]), np.flatnonzero(new_h[new_ctx])
            edges = np.append(starts, len(rows[0]))
            ahead = edges[0]  # contexts that go on with the group of the last batch
            if ahead:
                waiting.append(tuple(x[:ahead] for x in rows))
                n_waiting += ahead
            if len(starts):
                if n_waiting > 1:
                    yield from (told(w, int(is_hot)) for w in waiting)
                size = np.diff(edges)
                chosen = np.repeat((size > 1) & (size <= hot), size)
                chosen[edges[-2] - edges[0] :] = False
                within = tuple(x[ahead:] for x in rows)
                yield told(tuple(x[chosen] for x in within), 0)
                large = np.repeat(size > hot, size)
                large[edges[-2] - edges[0] :] = False
                if large.any():
                    yield told(tuple(x[large] for x in within), 1)
                waiting, n_waiting, is_hot = [tuple(x[edges[-2] :] for x in rows)], size[-1], False
            if is_hot or n_waiting > hot:
                is_hot = True
                yield from (told(w, 1) for w in waiting)
                waiting = []
            group, last_ctx = h[-1], ctx[-1]
        if n_waiting > 1:
            yield from (told(w, int(is_hot)) for w in waiting)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that each text has."""
    for batch in batches:
        doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        offsets, data = blobs(batch.column(3))
        (edges, h), (_, span) = lists(batch.column(4)), lists(batch.column(5))
        row = np.repeat(np.arange(len(doc)), np.diff(edges))
        start, end = span >> 32, span & 0xFFFFFFFF
        size = end - start
        ends = np.cumsum(size)
        taken = np.repeat(offsets[row] + start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        bytes_ = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data[taken])]).cast(pa.binary())
        yield to_batch(h=h, doc=doc[row], row_key=key[row], s=start, context=bytes_)


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch of contexts; for each window its offset there and its row."""
    offsets, data = blobs(batch.column(4))
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(batch.num_rows), count)
    return data, offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), row


def _ranges(doc, key, start, length: int) -> pa.RecordBatch:
    """Ranges of the windows at ``start``; runs of neighbours in one document become one range."""
    if not len(doc):
        return to_batch(doc=doc, row_key=key, s=start, e=start)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
    return to_batch(doc=doc[first], row_key=key[first], s=start[first], e=start[np.append(first[1:], len(doc)) - 1] + length)


def _compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of contexts sorted by (h, doc, row_key, s): the ranges that go. Whole groups are sorted in blocks."""
        held: list[pa.RecordBatch] = []

        def settled(block: pa.RecordBatch) -> pa.RecordBatch:
            h, doc, key, s = (block.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (s[1:] != s[:-1])][: len(h)]
            block, doc, key, s = block.filter(pa.array(once)), doc[once], key[once], s[once]  # equal rows are one document
            data, at, row = _windows(block, length)
            offsets = blobs(block.column(4))[0]
            start = s[row] + at - offsets[row]
            again = window_factors(data[at[:, None] + np.arange(length)]) >= length
            return _ranges(doc[row[again]], key[row[again]], start[again], length)

        for batch in batches:
            held.append(batch)
            block = pa.concat_batches(held)
            h = block.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            weight = np.append(0, np.cumsum(np.diff(blobs(block.column(4))[0]) - length + 1))
            begin = 0
            for nxt in starts[1:]:
                if weight[nxt] - weight[begin] >= BLOCK:
                    yield settled(block.slice(begin, nxt - begin))
                    begin = nxt
            held = [block.slice(begin)]
        if held:
            block = pa.concat_batches(held)
            h = block.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            yield settled(block)

    return run


def _spread(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a window of hot contexts, under the window's own hash."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                data, at, row = _windows(part, length)
                doc, key, s = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                offsets = blobs(part.column(4))[0]
                prefix = _prefix(data[offsets[0] : offsets[-1]])
                at0 = at - offsets[0]
                h = part.column(0).to_numpy(zero_copy_only=False)
                yield to_batch(w=_hashes(prefix, at0, at0 + length, _POWER[at0]).view(np.int64), h=h[row], doc=doc[row], row_key=key[row], s=s[row] + at - offsets[row])

    return run


def _first_of_sorted(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place = None, [0, 0, 0]
        for batch in batches:
            w, h, doc, key, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            if not len(w):
                continue
            new = np.r_[(w[0], h[0]) != before, (w[1:] != w[:-1]) | (h[1:] != h[:-1])]
            again = _later(new, [doc, key, s], place)
            before = (w[-1], h[-1])
            if new.any():
                place = [x[np.flatnonzero(new)[-1]] for x in (doc, key, s)]
            yield to_batch(doc=doc[again], row_key=key[again], s=s[again], e=s[again] + length)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = blobs(batch.column(3))
        edges, spans = lists(batch.column(4))
        removed, runs, kept = [], [], []
        for k in range(batch.num_rows):
            text, span = data[offsets[k] : offsets[k + 1]], spans[edges[k] : edges[k + 1]]
            if not len(span):
                removed.append(0)
                runs.append(0)
                kept.append(text.tobytes())
                continue
            depth = np.bincount(span >> 32, minlength=len(text) + 1) - np.bincount(span & 0xFFFFFFFF, minlength=len(text) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(text[~gone].tobytes())
        yield to_batch(doc_id=batch.column(2), n_bytes=np.diff(offsets), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept=pa.array(kept, pa.binary()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of ``docs``.

    ``kept`` is binary: a cut may part a code point. Earlier means a smaller doc_id, or an
    earlier start in the same document; a null doc_id comes after all others. Rows that
    repeat a doc_id with other text count as later or earlier by a hash of their text; rows
    equal in both are one document and all get its result. Null texts are empty; texts
    shorter than ``length`` stay whole; other columns are ignored; no rows give no rows. Equal
    contexts, and windows of hot anchors, are equal by two independent 64-bit hashes; all other
    windows are compared byte by byte.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text).alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
    )
    sketch = rows.select("doc", "row_key", "text").mapInArrow(lean(_sketch(length, gram)), "h long, ctx long, doc long, row_key long, info long")
    dealt = sketch.repartition("h").sortWithinPartitions("h", "ctx", "doc", "row_key", "info")
    settled = materialize(dealt.mapInArrow(_settle(length, hot), "h long, doc long, row_key long, s long, e long"), "op10-settled")

    span = F.shiftleft("s", 32).bitwiseOR(F.col("e"))

    def contexts(which: str) -> DataFrame:
        asked = settled.where(which).groupBy("doc", "row_key").agg(F.collect_list(F.struct("h", span.alias("span"))).alias("asked"))
        asked = asked.select("doc", "row_key", F.col("asked.h").alias("h"), F.col("asked.span").alias("span"))
        found = rows.join(asked, ["doc", "row_key"]).select("doc", "row_key", "doc_id", "text", "h", "span")
        return found.mapInArrow(lean(_contexts), "h long, doc long, row_key long, s long, context binary")

    cold = contexts("h <> 0 and h & 1 = 0").repartition("h").sortWithinPartitions("h", "doc", "row_key", "s")
    cold = cold.mapInArrow(lean(_compare(length)), "doc long, row_key long, s long, e long")
    spread = contexts("h & 1 = 1").mapInArrow(_spread(length), "w long, h long, doc long, row_key long, s long")
    spread = spread.repartition("w").sortWithinPartitions("w", "h", "doc", "row_key", "s")
    spread = spread.mapInArrow(_first_of_sorted(length), "doc long, row_key long, s long, e long")
    gone = settled.where("h = 0").select("doc", "row_key", "s", "e").union(cold).union(spread)
    gone = gone.groupBy("doc", "row_key").agg(F.collect_list(span).alias("spans"))
    whole = rows.join(gone, ["doc", "row_key"], "left").select("doc", "row_key", "doc_id", "text", "spans")
    return whole.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat earlier ones."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
