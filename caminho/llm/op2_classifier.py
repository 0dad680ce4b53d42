"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import to_batch
from .store import table

#: Word buckets, factors, and the most labelled documents the model is fitted on.
BUCKETS, FACTORS, SAMPLE = 4096, 8, 6000
#: Passes over the sample, step of the optimiser, decay of the weights, documents of a step.
EPOCHS, STEP, DECAY, CHUNK = 10, 0.02, 1e-5, 64
#: A document whose crc32(doc_id as text) leaves this remainder modulo 4 is never learned from.
HELD_OUT = 2
#: Score from which a document is predicted good.
CUT = 0.7

_SYMBOLS = frozenset("#*$%&|<>")


class _Buckets(dict):
    """Bucket of each word seen, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def structure(text: str, words: list[str], counts: np.ndarray) -> list[float]:
    """Structure statistics and metadata of a text, each about 0 to 1; all 0 for an empty one."""
    n, size = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    different = len(set(words))
    stutter = sum(map(str.__eq__, words, words[1:]))
    symbols = sum(text.count(c) for c in _SYMBOLS)
    upper = sum(w.isupper() for w in words)
    stops = sum(w[-1] in ".!?" for w in words)
    return [
        min(1.0, math.log1p(n) / 10),
        min(1.0, math.log1p(size) / 12),
        min(1.0, math.log1p(len(lines)) / 6),
        min(1.0, _share(letters, n) / 20),
        min(1.0, 5 * _share(symbols, letters)),
        min(1.0, _share(text.count("|"), n)),
        _share(upper, n),
        _share(n - different, n),
        _share(stutter, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        min(1.0, 4 * _share(stops, n)),
        min(1.0, 10 * _share(sum(map(str.isdigit, words)), n)),
        _share(float(counts.max()) if n else 0.0, n),
        min(1.0, 3 * _share(text.count("!"), n)),
        min(1.0, 3 * _share(sum(w.isalpha() for w in words), 3 * n)),
        float(n < 20),
    ]


N_STRUCTURE = 16
SIZE = BUCKETS + N_STRUCTURE


def vector(text: str, of_word: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: words weigh log(1 + count), scaled to length 1, then the statistics."""
    words = text.split()
    counts = np.bincount([of_word[w] for w in words], minlength=1) if words else np.zeros(1, np.int64)
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index])
    value = value / (np.linalg.norm(value) or 1.0)
    return np.append(index, np.arange(BUCKETS, SIZE)), np.append(value, structure(text, words, counts))


class Machine:
    """y(x) = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j.

    The pair term is half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2, linear
    in the number of features present.
    """

    def __init__(self, seed: int = 2):
        self.bias = 0.0
        self.weights = np.zeros(SIZE)
        self.factors = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.05, (SIZE, FACTORS))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """y of each run of features that begins at ``starts``."""
        if not len(starts):
            return np.empty(0)
        parts = self.factors[index] * value[:, None]
        sums = np.add.reduceat(parts, starts, axis=0)
        squares = np.add.reduceat(parts**2, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * (sums**2 - squares).sum(axis=1)

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
        """Minimise the log loss by Adam in a fixed order, so reruns agree."""
        if not len(labels):
            return self
        rate = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = math.log(rate / (1 - rate))
        params = np.concatenate([self.weights[:, None], self.factors], axis=1)
        first, second, step = np.zeros_like(params), np.zeros_like(params), 0
        rng = np.random.Generator(np.random.PCG64(3))
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), CHUNK):
                chosen = order[at : at + CHUNK]
                index = np.concatenate([vectors[k][0] for k in chosen])
                value = np.concatenate([vectors[k][1] for k in chosen])
                size = np.array([len(vectors[k][0]) for k in chosen])
                starts = np.cumsum(size) - size
                row = np.repeat(np.arange(len(chosen)), size)
                self.weights, self.factors = params[:, 0], params[:, 1:]
                error = 1 / (1 + np.exp(-self.margins(index, value, starts))) - labels[chosen]
                parts = self.factors[index] * value[:, None]
                sums = np.add.reduceat(parts, starts, axis=0)[row]
                slope = np.concatenate([np.ones((len(index), 1)), sums - parts], axis=1) * (value * error[row] / len(chosen))[:, None]
                present, inverse = np.unique(index, return_inverse=True)
                grad = np.zeros((len(present), 1 + FACTORS))
                np.add.at(grad, inverse, slope)
                grad += DECAY * params[present]
                self.bias -= STEP * float(error.mean())
                step += 1
                first[present] = 0.9 * first[present] + 0.1 * grad
                second[present] = 0.99 * second[present] + 0.01 * grad**2
                params[present] -= STEP * (first[present] / (1 - 0.9**step)) / (np.sqrt(second[present] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.factors = params[:, 0].copy(), params[:, 1:].copy()
        return self


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_word = _Buckets()
    for batch in batches:
        index, value = [], []
        for text in batch.column(1):
            i, v = vector(text.as_py() or "", of_word)
            index.append(i.astype(np.int32))
            value.append(v.astype(np.float32))
        yield to_batch(quality=batch.column(0), index=pa.array(index, pa.list_(pa.int32())), value=pa.array(value, pa.list_(pa.float32())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled documents that are not held out.

    The sample is the first by a hash of doc_id, so it does not change from run to run. Of
    repeated labels the best counts; null labels and labels without a document do not count.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("_id"))  # at most ``sample`` rows of two numbers
    rows = chosen.select("doc_id", "quality", F.col("text").cast("string").alias("text")).where("quality is not null")
    found = rows.select("quality", "text").mapInArrow(_vectors, "quality double, index array<int>, value array<float>").limit(sample).toArrow()
    if not found.num_rows:
        return Machine()
    order = sorted(range(found.num_rows), key=lambda k: (found["quality"][k].as_py(), found["index"][k].as_py(), found["value"][k].as_py()))
    vectors = [(np.array(found["index"][k].as_py()), np.array(found["value"][k].as_py())) for k in order]
    return Machine().fit(vectors, np.array([found["quality"][k].as_py() for k in order]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = _Buckets()
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                found = [vector(text.as_py() or "", of_word) for text in batch.column(1).slice(at, 256)]
                size = np.array([len(i) for i, _ in found])
                margins = machine.margins(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), np.cumsum(size) - size)
                scores.append(1 / (1 + np.exp(-np.clip(margins, -60, 60))))
            yield to_batch(doc_id=batch.column(0), score=np.concatenate(scores) if scores else np.empty(0))

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``, from its whole text alone.

    Null and empty texts are scored as texts without words. Rows that repeat a doc_id are
    each scored; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scorer(machine), f"doc_id {kind}, score double")


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
