"""Mixing against plain Python."""

import math
import random

from pyspark.sql import functions as F

from caminho.llm.op5_mixing import mix, mixed, multipliers, targets

SCHEMA = "doc_id long, text string, source string, copies string, rate string"


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing of what is above the limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


def test_targets(spark):
    rnd = random.Random(1)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i}": rnd.choice([0, 3, 50, 1000, 40_000]) for i in range(n)} | {None: 77}
        found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water(sizes)
        for r in found:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)


def corpus():
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "a", "a", "b", "c", None]), "x", "y") for i in range(900)]
    return rows + [(5, None, "b", "x", "y"), (5, "w w", "b", "x", "y"), (5, "w w", "b", "x", "y"), (None, "w", "a", "x", "y"), (None, "", "zz", "x", "y")]


def test_sources_meet_their_targets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    decided = mix(docs)
    assert decided.agg(F.sum("rows")).first()[0] == len(rows)
    for r in decided.groupBy("source", "target").agg(F.sum(F.expr("size * (rows * floor + more)")).alias("taken"), F.max(F.expr("floor + int(more > 0)")).alias("most")).collect():
        assert abs(r.taken - r.target) <= 61 and r.most <= 3
    again = mix(docs.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, decided.collect()))


def test_units_of_many_rows_are_taken_in_part(spark):
    """Rows without ids, of one size: the target is met all the same."""
    docs = spark.createDataFrame([(None, "w " * 10, "a", "", "")] * 400 + [(None, "w " * 10, "b", "", "")] * 300, SCHEMA)
    for r in mix(docs).groupBy("source", "target").agg(F.sum(F.expr("size * (rows * floor + more)")).alias("taken")).collect():
        assert abs(r.taken - r.target) <= 5
    assert {r.source: 10 * r["count"] for r in mixed(docs).groupBy("source").count().collect()} == {"a": 5000, "b": 2000}


def test_rates_solve_the_dual(spark):
    """Rates are tilted by size, and meet the targets before they are rounded."""
    rnd = random.Random(6)
    sizes = {s: [rnd.randint(0, 500) for _ in range(200)] for s in "abc"} | {"d": [3], "e": [0, 0]}
    cells = spark.createDataFrame([(s, x, sizes[s].count(x)) for s in sizes for x in set(sizes[s])], "source string, size long, n long")
    goal = {"a": 1.7, "b": 0.01, "c": 2.999, "d": 3.0, "e": 0.0}
    wanted = spark.createDataFrame([(s, goal[s] * sum(sizes[s])) for s in sizes], "source string, target double")
    found = {r.source: r for r in multipliers(cells, wanted).collect()}
    for s in "abc":
        rate = lambda x: min(3.0, math.exp(found[s].multiplier * x / found[s].scale))
        assert math.isclose(sum(x * rate(x) for x in sizes[s]), goal[s] * sum(sizes[s]), rel_tol=1e-6)
    assert found["d"].multiplier is None and len(found) == 5


def test_rows_are_repeated(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == mix(docs).agg(F.sum(F.expr("rows * floor + more"))).first()[0]
    assert mixed(docs.limit(0)).count() == 0
