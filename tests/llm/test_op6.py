"""Packing: exact round trip, and the programme against exhaustive search."""

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from caminho.llm import op6_packing
from caminho.llm.op6_packing import END, cuts, encoder, pack

ODD = ["", " ", "a  b   c \n d", "  x", "x  ", "a\n \nb", " \n \n c", "hello <|endoftext|> you", "日本語 と words", "it's we're I'll 'd 123abc !!! ...", "tab\t x\r\n y", "nul \x00 a", "“so” — l’été 5 € œuvre", "x" * 3000]


def reference(text):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tokenizer.encode(text, add_special_tokens=False).ids, END]


def test_ids_are_the_tokenizers(monkeypatch):
    encode = encoder("byte_bpe_50k", None)
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(["a", "Zé", " ", "  ", "\n", "1", "'s", "ñ.", "\t"]) for _ in range(60)) for _ in range(150)]
    monkeypatch.setattr(op6_packing, "PIECE", 7)
    for text in texts:
        assert encode(text).tolist() == reference(text), text


def test_least_cost():
    rnd = random.Random(2)
    for _ in range(150):
        size = rnd.choice([8, 16])
        n = rnd.randint(1, 60)
        points = sorted({0, n, *range(0, n, size), *(rnd.randint(0, n) for _ in range(8))})
        penalty = [float(rnd.randint(0, 3)) for _ in points]

        @lru_cache
        def least(j):
            if j == 0:
                return 0.0
            return penalty[j] + min(least(i) + size - (points[j] - points[i]) for i in range(j) if points[j] - points[i] <= size)

        found = cuts(np.array(points), np.array(penalty), size)
        at, cost = 0, 0.0
        for p in found:
            x = p - at
            assert x <= size
            cost += penalty[points.index(p)] + size - x
            at = p
        assert at == n and cost == least(len(points) - 1)


def test_round_trip(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "été.", "no\n", "x1"]) for _ in range(rnd.choice([0, 3, 50, 900, 9000]))), "e") for i in range(40)]
    rows += [(40, None, "e"), (41, "", None), (None, "no id", "e"), (3, rows[3][1], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    pieces = [r.asDict() for r in pack(docs).collect()]
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(reference(t or ""))
    per_doc, per_sequence = {}, {}
    for p in pieces:
        per_doc.setdefault(p["doc_id"], []).append(p)
        per_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, wanted in ids.items():
        assert sum(p["length"] for p in per_doc[i]) == sum(map(len, wanted))
        if len(wanted) == 1:
            at = 0
            for p in sorted(per_doc[i], key=lambda p: p["start"]):
                part = wanted[0][at : at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(wanted[0])
                assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
                at += p["length"]
    padding = 0
    for parts in per_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(p["length"] for p in pieces)
    n_last = 3  # a partition's last sequence may be short
    assert padding <= 0.02 * total + 2048 * n_last and len(per_sequence) <= 1.05 * total / 2048 + n_last
    assert pack(docs.limit(0)).count() == 0
    monkeypatch.undo()
