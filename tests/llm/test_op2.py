"""Classifier: the machine's algebra, held-out accuracy, and what it may not see."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from caminho.llm.op2_classifier import SIZE, Machine, fit, held_out, score

SCHEMA = "doc_id long, text string, lang string, score string"


def test_pair_terms():
    machine = Machine(1)
    rng = np.random.Generator(np.random.PCG64(0))
    machine.weights, machine.bias = rng.normal(size=SIZE), 0.3
    index, value = np.array([3, 9, 20, 4]), np.array([0.5, 1.0, -2.0, 0.1])
    want = 0.3 + machine.weights[index] @ value
    want += sum(machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert np.allclose(machine.margins(index, value, np.array([0])), want)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(500):
        good = rnd.random() < 0.7
        text = " ".join(word() if good else rnd.choice(["spam", "buy", word() + "%%"]) for _ in range(rnd.randint(20, 60)))
        rows.append((i, text, "en", "x"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(900, None, None, None), (901, "", "", ""), (902, "w " * 50_000, "", ""), (None, "no id", "", ""), (3, "again", "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    named = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    machine = fit(docs, named)
    found = score(docs, machine).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    want = {i: q for i, q, _ in labels}
    for r in found:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
    hits = [(r.score >= 0.7) == want[r.doc_id] for r in found if r.held_out and r.doc_id in want]
    assert np.mean(hits) > 0.95
    flipped = named.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit(docs.repartition(3), flipped).factors, machine.factors)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(corpus()[0][:5], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(docs, fit(docs, none)).count() == 5
    assert score(docs.limit(0), Machine()).count() == 0
