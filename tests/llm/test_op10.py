"""Suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from caminho.llm.op10_suffix_dedup import _packed, _unpacked, longest_previous_factors, remove_repeats, window_factors

SCHEMA = "doc_id long, text string, h string"


def brute(rows, length):
    """{row index: (kept bytes, runs)}; rows equal in id and text are one document."""
    seen, found = set(), {}
    docs = sorted({(i, t) for i, t in rows}, key=lambda x: x[0])
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        keep = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        found[i] = (len(data), int(gone.sum()), runs, keep)
    return found


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    pool = [" ".join(word() for _ in range(rnd.randint(10, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 8))]
        text = " ".join(parts)
        if rnd.random() < 0.2 and rows:
            text = rnd.choice(rows)[1] or ""
            at = rnd.randint(0, max(0, len(text) - 1))
            text = text[:at] + "#" + text[at + rnd.randint(0, 1) :]
        rows.append((i, text))
    rows += [(60, "ab " * 400), (61, "x" * 500), (62, None), (63, ""), (64, "ab " * 300 + "z"), (65, rows[3][1]), (66, "\x00" * 250)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 100, 28, 4000), (2, 100, 28, 2), (3, 40, 12, 3)])
def test_matches_brute_force(spark, seed, length, gram, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "extra") for r in [*rows, rows[0], rows[5]]], SCHEMA).repartition(5)
    found = remove_repeats(docs, length, gram, hot).collect()
    want = brute(rows, length)
    assert len(found) == len(rows) + 2
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_empty_table_and_null_ids(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "abcdefghij" * 3 + "".join(chr(97 + i % 26) * (i % 5 + 1) for i in range(60))
    rows = [(None, text, "a"), (4, text, None)]
    found = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[4] == 0 and found[None] == len(text)


def test_longest_previous_factors():
    rnd = random.Random(5)
    for _ in range(30):
        data = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40)))
        size, _ = longest_previous_factors(data)
        for i in range(len(data)):
            best = max((next((k for k in range(len(data) - i) if data[i + k] != data[j + k]), len(data) - i) for j in range(i)), default=0)
            assert size[i] == best


def test_window_factors():
    rnd = np.random.Generator(np.random.PCG64(6))
    rows = rnd.integers(0, 2, (400, 7), np.uint8)
    found = window_factors(rows)
    for i in range(len(rows)):
        assert found[i] == max((int(np.argmin(np.r_[rows[i] == rows[j], False])) for j in range(i)), default=0)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_places_in_the_longest_texts():
    at, first = np.array([5, 1 << 27, (1 << 31) - 200]), np.array([0, (1 << 27) - 72, (1 << 31) - 210])
    begin, end = _unpacked(_packed(at, first, first + 72))
    assert begin.tolist() == first.tolist() and end.tolist() == (first + 72).tolist()
