"""Order-preserving packing of token streams by dynamic programming.

Windows are cut so that padding plus truncation penalties are least: f(j) is the least cost
of the stream up to position j, f(j) = penalty(j) + min over i of f(i) + pad(i, j). A cut
costs nothing at a document's end, little at a sentence's end and more elsewhere. Every
window is priced at SIZE - (j - i), also one that need not be padded because its length is a
power of two: else short windows would be free and there would be many of them. So the best i
is the least f(i) + i of a sliding window, kept in a monotone queue.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import lean, to_batch
from .store import table

#: Tokens of a sequence, the id that ends a document, and its vocabulary.
SIZE, END, VOCABULARY = 2048, 1, "byte_bpe_50k"
#: What a cut costs in tokens of padding: at the end of a sentence, and elsewhere.
AT_SENTENCE, INSIDE = 4, 24
#: Tokens that one run of the dynamic programme sees; its last sequence goes on in the next run.
BLOCK = 1 << 18
#: Positions in running text at which a cut is considered, besides document and sentence ends.
STRIDE = 16
#: Special tokens of the vocabulary; a text that has one goes to the tokenizer itself.
SPECIAL = ("<|endoftext|>",)
#: Characters encoded at once.
PIECE = 1 << 20

_OTHER = re.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_BETWEEN = re.compile(r"\S(?= \S)")


class Encoder:
    """Ids of whole texts, exactly as the vocabulary's own tokenizer gives them.

    Texts of Latin letters and common punctuation are encoded with the same vocabulary's
    ranks, which is several times faster and gives the same ids; all others, and texts with
    a special token in them, go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, folder: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self._load = lambda: Tokenizer.from_file(str(path(f"{vocabulary}.json")))
        with open(path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 2, bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded when a text needs it."""
        return self._load()

    def __call__(self, text: str) -> np.ndarray:
        """The ids of ``text`` and the end id. Long texts are encoded in pieces: a piece may
        begin at a plain space between two words, where the tokenizer begins one as well."""
        plain = _OTHER.search(text) is None and not any(x in text for x in SPECIAL)
        if not plain:
            return np.array([*self.whole.encode(text, add_special_tokens=False).ids, END], np.uint32)
        out, at = [], 0
        while at < len(text):
            split = _BETWEEN.search(text, at + PIECE)
            stop = split.start() + 1 if split else len(text)
            out.append(np.array(self.ranked.encode_ordinary(text[at:stop]), np.uint32))
            at = stop
        return np.concatenate([*out, np.array([END], np.uint32)])


@lru_cache(maxsize=2)
def encoder(vocabulary: str, folder: str | None) -> Encoder:
    """One encoder per worker process."""
    return Encoder(vocabulary, folder)


def cuts(points: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Cut positions of least total cost, the last of ``points`` included and 0 left out.

    ``points`` are increasing positions from 0 on, at most ``size`` apart; ``penalty`` is
    what a cut costs at each.
    """
    at = points.tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j, (p, extra) in enumerate(zip(at[1:], penalty.tolist()[1:]), 1):
        while at[queue[0][1]] < p - size:
            queue.popleft()
        best[j], back[j] = queue[0][0] + size - p + extra, queue[0][1]
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def _candidates(stream: np.ndarray, ends: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``stream`` may be cut, and what each costs."""
    n = len(stream)
    inside = np.flatnonzero(sentence[stream]) + 1
    points = np.unique(np.concatenate([[0, n], ends, inside, np.arange(0, n, min(STRIDE, size))]))
    penalty = np.full(len(points), float(INSIDE))
    penalty[np.searchsorted(points, inside)] = AT_SENTENCE
    penalty[np.searchsorted(points, ends)] = 0
    return points, penalty


def _packer(size: int, vocabulary: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder)
        partition = TaskContext.get().partitionId() << 36
        sequence = 0
        held: list[tuple[object, int, np.ndarray, int]] = []  # document, first token held, tokens held, tokens of the document
        n_held = 0

        def pack(last: bool) -> pa.RecordBatch:
            nonlocal held, n_held, sequence
            stream = np.concatenate([x[2] for x in held])
            over = np.cumsum([len(x[2]) for x in held])
            done = [x[1] + len(x[2]) == x[3] for x in held]
            edges = cuts(*_candidates(stream, over[done], encode.ends, size), size)
            if not last and len(edges) > 1:
                edges.pop()
            stop = edges[-1]
            bounds = np.unique(np.concatenate([[0], edges, over[over < stop]]))
            begins, ends = bounds[:-1], bounds[1:]
            of = np.searchsorted(over, begins, side="right")
            first = np.append(0, edges)
            seq = np.searchsorted(first, begins, side="right") - 1
            starts = begins - np.append(0, over[:-1])[of] + np.array([x[1] for x in held])[of]
            raw = stream.astype("<u4")
            out = to_batch(
                doc_id=pa.array([held[k][0] for k in of], pa.int64()),
                start=starts,
                length=ends - begins,
                ids_crc32=pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64()),
                doc_tokens=np.array([x[3] for x in held])[of],
                sequence_id=partition + sequence + seq,
                offset=begins - first[seq],
            )
            sequence += len(edges)
            rest = []
            for (doc, begin, ids, total), top in zip(held, over):
                if top > stop:
                    skip = max(0, len(ids) - int(top - stop))
                    rest.append((doc, begin + skip, ids[skip:], total))
            held, n_held = rest, len(stream) - stop
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                for begin in range(0, len(ids), BLOCK):
                    held.append((doc, begin, ids[begin : begin + BLOCK], len(ids)))
                    n_held += len(held[-1][2])
                    while n_held >= BLOCK:
                        yield pack(False)
        while n_held:
            yield pack(True)

    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the order in which they are read, and each input partition packs its own
    stream, so texts are never shuffled and a lost task repeats its own work only. Null texts are empty:
    such documents are their end id alone. Rows that repeat a doc_id are packed each; a null
    doc_id stays null; other columns are ignored; no rows give no pieces.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_packer(size, vocabulary, folder)), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack(table(spark, sf_dir, "documents"))
