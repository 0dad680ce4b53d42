"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import to_batch
from .store import delete, materialize

#: Links of a task that are contracted at once.
HELD = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) that connect the same nodes: each node with the least it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (least[x] != least[y]).any():
        u, v = least[x], least[y]
        low = np.minimum(u, v)
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
        while (least[least] != least).any():
            least = least[least]
    far = np.flatnonzero(least != np.arange(len(nodes)))
    return to_batch(a=nodes[far], b=nodes[least[far]])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) that a task holds as stars, so that rounds only settle what lies between tasks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= HELD:
            yield _stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
            held.clear()
    if held:
        yield _stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long); label is the least node reachable.

    What one task holds is contracted there. Rounds end when the link set stays the same; only its size and a checksum reach the
    driver. Self links are ignored, repeated links count once, no links give no rows. Each
    round is written to the shared folder, so nothing is recomputed after a lost executor; the
    one before is then deleted.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = lambda links: materialize(links.mapInArrow(_contracted, "a long, b long"), tag)
    now, seen = stars(now), None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        before, now = now, stars(_small_star(_large_star(now)))
        delete(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
