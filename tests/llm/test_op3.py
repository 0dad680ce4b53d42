"""Fingerprints: neighbours by brute force, and near-duplicates against all pairs."""

import hashlib
import random

import pytest

from caminho.llm import op3_spotsigs
from caminho.llm.op3_spotsigs import SIMILAR, _Words, as_text, compare_neighbours, edited, jaccard, near_duplicates, signatures

SCHEMA = "doc_id long, text string, part string, borrowed string"


def corpus(n=120):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghß") for _ in range(rnd.randint(2, 6)))
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.4:
            words = (rnd.choice(rows)[1] or "x").split()
            for _ in range(rnd.choice([0, 1, 3])):
                words[rnd.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(rnd.choice(["the", "of", "und", word(), word()]) for _ in range(rnd.randint(1, 120)))
        rows.append((3 * i, text, "", ""))
    return rows + [(1000, None, "", ""), (1001, "", "", ""), (1002, "🙂 a🙂", "", "")]


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(op3_spotsigs, "TASK_BYTES", size)
    rows = corpus()
    found = {r.doc_id: r for r in compare_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        assert edited(text, after) == want
        r, of = found[i], _Words()
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        sets = [set(signatures(t, of).tolist()) for t in (text, want, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert [r.near_edited, r.near_next] == pytest.approx(like)
        assert r.fingerprint == as_text(signatures(text, of)) and r.edited_fingerprint == as_text(signatures(want, of))


def test_odd_rows(spark):
    one = compare_neighbours(spark.createDataFrame([(1, "the house of cards", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(None, "a b", "", ""), (None, "c d", "", ""), (5, "a b", "", ""), (5, "a b", "", ""), (5, "z", "", "")]
    assert compare_neighbours(spark.createDataFrame(rows, SCHEMA)).count() == 5
    assert compare_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates(spark):
    rows = corpus(90)
    of = _Words()
    sets = {i: signatures(t or "", of) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= SIMILAR:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: top(i) for i in sets}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
