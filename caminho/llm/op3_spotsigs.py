"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import to_batch
from .components import components
from .store import materialize, table
from .words_common import STOP_WORDS

#: Content words of a chain, and the likeness of near-duplicates.
CHAIN, SIMILAR = 2, 0.8
#: Bytes of text that one task of the neighbour query holds, about.
TASK_BYTES = 16 << 20
#: Ranges of doc_id, about a terabyte; of more text they grow, and their sorted rows stream through a task one by one.
RANGES = 1 << 16
#: Anchors, fixed values: frequent words that prose of four languages has in every sentence or so.
ANCHORS = frozenset("the of and is to in le la de et les un der die und ist von das el que en los".split())

#: One content word in so many, by its hash, is an anchor too, so that texts without common words have anchors.
SPARSE = 12

_EDGES = ".,;:!?\"'()[]{}|#*$%&<>-"
_SEED = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """(hash << 2 | 2 for a common word | 1 for an anchor) of each word seen, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = word.strip(_EDGES)
        value = xxhash.xxh64_intdigest(plain)
        common = plain in STOP_WORDS or not plain
        anchor = plain in ANCHORS or (not common and value % SPARSE == 0)
        self[word] = found = (value >> 2 << 2) | common << 1 | anchor
        return found


def signatures(text: str, of_word: dict, chain: int = CHAIN) -> np.ndarray:
    """Sorted different 32-bit hashes of the anchor and the ``chain`` content words after it.

    A chain may run short at the end of the text. A (short) text without anchors has a signature for
    each of its words instead, so only texts without words have none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint32)
    words = np.array([of_word[w] for w in found], np.uint64)
    hashes, flags = words >> np.uint64(2), words & np.uint64(3)
    anchors = np.flatnonzero(flags & np.uint64(1))
    content = np.flatnonzero(flags < 2)
    if not len(anchors) or not len(content):
        mixed = hashes * _SEED
    else:
        places = np.append(content, np.full(chain, len(words)))
        values = np.append(hashes, np.uint64(7))
        at = np.searchsorted(content, anchors, side="right")
        mixed = hashes[anchors] * _SEED
        for k in range(chain):
            mixed = (mixed ^ values[places[at + k]]) * _SEED
            mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 0 as soon as their lengths show that it is below ``least``; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (len(a) + len(b) - both)
    return found if found >= least else 0.0


def as_text(found: np.ndarray) -> str:
    """A fingerprint: the signatures as hex, eight digits each."""
    return found.astype(">u4").tobytes().hex()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_word = _Words()
    for batch in batches:
        found = [signatures(t.as_py() or "", of_word).astype(np.int64) for t in batch.column(1)]
        yield to_batch(doc_id=batch.column(0), sigs=pa.array(found, pa.list_(pa.int64())))


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id): documents whose signature sets have Jaccard ``least`` or more
    are linked; component_id is the smallest doc_id reachable.

    Equal sets form one class first. Classes meet if they share one of their rarest
    signatures (a set of n needs n - ceil(least * n) + 1 of them, no link is lost) and lie in
    the same or neighbouring partitions by set length; lengths that rule the likeness out are
    pruned before the sets are compared. Texts without words are one class. Null ids are left
    out; repeated ids join their classes.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = rows.mapInArrow(_fingerprints, "doc_id long, sigs array<bigint>")
    prints = materialize(prints.withColumn("key", F.xxhash64("sigs")), "op3-prints")
    classes = materialize(prints.groupBy("key").agg(F.first("sigs").alias("sigs")).where("size(sigs) > 0"), "op3-classes")
    each = classes.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    rare = each.join(common, "sig").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("s"))
    alone = F.col("n") - F.size("s")  # signatures no other class has come first in the order and need not meet
    need = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - alone
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    probes = rare.where(need > 0).select("key", "n", part.alias("part"), F.explode(F.slice("s", F.lit(1), need)).alias("x")).select("key", "n", "part", F.col("x.sig").alias("sig"))
    left = probes.select("sig", F.col("key").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = probes.select("sig", F.col("key").alias("b"), F.col("n").alias("nb"), "part")
    pairs = left.join(right, ["sig", "part"]).where("a <> b and na <= nb").where(F.col("na") >= F.col("nb") * least - 1e-9).select("a", "b").distinct()
    sets = pairs.join(classes.select(F.col("key").alias("a"), F.col("sigs").alias("sa")), "a").join(classes.select(F.col("key").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = sets.where(both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")
    labels = components(links, "op3-links")
    labelled = prints.select("doc_id", "key").join(labels, F.col("key") == F.col("node"), "left").select("doc_id", F.coalesce("label", "key").alias("label"))
    return labelled.join(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (range, place): each own row against the row after it. Borrowed rows only follow."""
    of_word = _Words()
    before: tuple | None = None
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        ranges, borrowed, ids = (batch.column(c).to_pylist() for c in (0, 1, 2))
        for k in range(batch.num_rows):
            text = batch.column(3)[k].as_py() or ""
            own = signatures(text, of_word)
            if before is not None and before[0] == ranges[k]:
                _, doc_id, first, sigs = before
                changed = edited(first, text)
                other = signatures(changed, of_word)
                out["doc_id"].append(doc_id)
                out["n_chars"].append(len(first))
                out["edited_sha256"].append(hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest())
                out["fingerprint"].append(as_text(sigs))
                out["edited_fingerprint"].append(as_text(other))
                out["near_edited"].append(jaccard(sigs, other))
                out["near_next"].append(jaccard(sigs, own))
            before = None if borrowed[k] else (ranges[k], ids[k], text, own)
        types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        yield to_batch(**{c: pa.array(v, types.get(c, pa.string())) for c, v in out.items()})


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` against its edited text and against the next row.

    The next row is that of the next smaller doc_id (null ids after all others, rows of one
    id in the order of a hash of their text), after the last one the first. Rows are dealt in
    ranges of doc_id of bounded size, and only the first row of a range is sent to the range
    before as well. A single row is its own next. Null texts are empty; other columns are
    ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.bitwise_not("doc_id").alias("turn"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    # The order is (null last, turn, tie); bounds come from all ids, their number from all sizes.
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    size, none = F.octet_length("text").cast("long"), F.col("turn").isNull()
    total = rows.agg(F.sum(F.when(~none, size)).alias("known"), F.count("turn").alias("ids"), F.sum(F.when(none, size)).alias("none")).first()
    n = max(1, min(total.ids, (total.known or 0) // TASK_BYTES + 1, RANGES))
    bounds = sorted({int(b) for b in rows.where(~none).approxQuantile("turn", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    # Two steps of about the root of the bounds each: the stretch of bounds, then the place in it.
    step = max(1, math.isqrt(len(bounds)))
    stretches = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda edges: F.size(F.filter(edges, lambda e: F.col("turn") > e))
    tops = F.array(*[F.lit(x[-1]) for x in stretches]).cast("array<bigint>")
    fine = F.array(*[F.array(*map(F.lit, x)).cast("array<bigint>") for x in stretches]) if stretches else F.array(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_s", below(tops))
    part = F.col("_s") * step + F.coalesce(below(F.get(fine, F.col("_s"))), F.lit(0))
    # Rows without doc_id stand in the order of their hash, so that ranges of the hash split them.
    m = (total.none or 0) // TASK_BYTES + 1
    hashed = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * m), F.lit(m - 1)) + len(bounds) + 1
    rows = rows.withColumn("part", F.when(none, hashed).otherwise(part).cast("int")).drop("_s")
    place = F.struct(F.col("turn").isNull().alias("none"), F.col("turn").alias("turn"), F.col("tie").alias("tie"))
    heads = rows.groupBy("part").agg(F.min(place).alias("head")).orderBy("part").collect()  # a row a range
    known = [(h.part, heads[k - 1].part, h["head"]) for k, h in enumerate(heads)]
    known = docs.sparkSession.createDataFrame(known, "of int, lender int, head struct<none: boolean, turn: long, tie: long>")
    rows = rows.join(F.broadcast(known), F.col("part") == F.col("of"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("lender").alias("part"), F.lit(True).alias("borrowed"))
    places = F.when(place.eqNullSafe(F.col("head")), F.array(own, lent)).otherwise(F.array(own))
    rows = rows.select("turn", "tie", "doc_id", "text", F.explode(places).alias("at")).select("at.*", "turn", "tie", "doc_id", "text")
    dealt = rows.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "borrowed", F.col("turn").asc_nulls_last(), "tie")
    return dealt.select("part", "borrowed", "doc_id", "text").mapInArrow(_compared, schema)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
