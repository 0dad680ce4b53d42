"""Connected components: links contracted within tasks, and few rounds."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from caminho.llm import components as module
from caminho.llm.components import _contracted, components


def least_of(links):
    group = {x: x for link in links for x in link}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    return {k: root(k) for k in group}


def some_links(n, seed):
    rnd = random.Random(seed)
    chain = [(k * 7 - 900, k * 7 - 893) for k in range(100)]
    return chain + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 3)]


def test_links_of_a_task(monkeypatch):
    links = [x for x in some_links(900, 1) if x[0] != x[1]]
    a, b = (pa.array([x[k] for x in links]) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([a, b], ["a", "b"])
    found = pa.Table.from_batches(_contracted(iter([batch.slice(0, 150), batch.slice(150)])))
    assert dict(zip(*(found.column(c).to_pylist() for c in (0, 1)))) == {k: x for k, x in least_of(links).items() if k != x}
    monkeypatch.setattr(module, "HELD", 100)
    found = pa.Table.from_batches(_contracted(iter([batch.slice(0, 150), batch.slice(150)])))
    assert least_of(list(zip(*(found.column(c).to_pylist() for c in (0, 1))))) == least_of(links) and found.num_rows <= len(links)
    assert not list(_contracted(iter([])))


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    rounds, star = [], module._large_star
    monkeypatch.setattr(module, "_large_star", lambda links: (rounds.append(1), star(links))[1])
    links = some_links(900, 2)
    table = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = components(table, "few").select("node", F.col("label")).collect()
    want = {k: x for k, x in least_of([x for x in links if x[0] != x[1]]).items()}
    assert {r.node: r.label for r in found} == want and len(found) == len(want)
    assert len(rounds) <= 3
