"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import lean
from .components import components
from .hamming import agreeing, hamming_links
from .store import join_hot, materialize, table

#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 4, 42
#: Fingerprints link at this many differing bits or fewer.
LIMIT = 4


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included.

    bytes.lower() changes A to Z only, and bytes.split() parts at the space and U+0009 to U+000D.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.append(0, ends[:-shingle]).tolist()
    digest, ends = xxhash.xxh64_intdigest, (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash(shingle_hashes(t.as_py())) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "tie", "fp"])


def _tie() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp) of each row of ``docs``, tie a hash of the text; the whole text is read, null counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_fingerprints), "doc_id long, tie long, fp long")


def _labelled(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fp) of every row, and (fp, label) of every fingerprint."""
    prints = materialize(fingerprints(docs), "op8-prints")
    classes = materialize(prints.select("fp").distinct(), "op8-classes")
    labels = components(hamming_links(classes, limit, agreeing(classes.count(), limit)), "op8-links")
    return prints, classes.join(labels, classes.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id.

    Fingerprints within ``limit`` differing bits are linked; component_id is the least
    doc_id reachable. Equal fingerprints form one class before any comparison, so exact
    copies cost nothing. Null and empty texts have fingerprint zero and are linked like any
    other. Rows that repeat a doc_id each get a row; a null doc_id is never the least unless
    its component has no other. Other columns are ignored; an empty table gives no rows.
    """
    prints, labelled = _labelled(docs, limit)
    placed = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labelled, "fp")
    ids = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = join_hot(placed.select("fp", "label"), ids, "label").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(of_class, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least doc_id, null
    ids last, and among rows of one id that of the least text hash. Rows that share an id but
    are no near-duplicates all stay; of rows equal in id and text one does.
    """
    prints, labelled = _labelled(docs, limit)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    least = prints.groupBy("fp").agg(F.min(place).alias("place")).join(labelled, "fp").groupBy("label").agg(F.min("place").alias("p"))
    chosen = least.select(F.col("p.doc_id").alias("_id"), F.col("p.tie").alias("_t"))
    again = prints.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_i"), F.col("tie").alias("_u"))
    chosen = chosen.join(again, F.expr("_id <=> _i and _t = _u"), "left").select("_id", "_t", F.col("_u").isNotNull().alias("_several"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_d"), _tie().alias("_tie"))
    kept = rows.join(chosen, F.expr("_d <=> _id and _tie = _t")).select("_row", "_d", "_tie", "_several")
    single, several = kept.where("not _several"), kept.where("_several").dropDuplicates(["_d", "_tie"])
    return single.union(several).select("_row.*")


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
