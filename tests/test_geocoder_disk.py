"""What matching leaves in shuffles when its result is read."""

import re

from caminho.operators import lattice
from caminho.operators.fuzzy import with_similar_street
from caminho.operators.matching import collapsed
from caminho.plans.geocode import distinct_addresses
from caminho.sources.addresses import register_points

POINT = "pt_id long, estado string, municipio string, logradouro string, numero int, cep string, localidade string, lat double, lon double, setor string"


def test_matches_are_stored_table_by_table(spark):
    """The rows of each address and its candidates are read from stored tables: nothing of all tables is dealt at once."""
    houses = [(k, "S1", "C", "RUA MARIA", k + 1, f"0000{k % 5}-000", "CENTRO", -20 - k * 1e-4, -50.0, "s") for k in range(60)]
    points = spark.createDataFrame(houses, POINT)
    tables = {name: spark.createDataFrame(t.collect(), t.schema) for name, t in lattice.lattice(points).items()}
    same, addresses = distinct_addresses(points.withColumnRenamed("pt_id", "row_id").drop("lat", "lon", "setor"))
    found = collapsed(with_similar_street(addresses, tables), tables)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join", plan(same) + plan(found))
    assert same.count() == 60 and found.count() == 60


def test_orders_are_dealt_without_the_nation(spark):
    """The two shuffles of all orders hold keys, code and segment; names join after them."""
    points = register_points(spark, "/root/testdata/sf0.001")
    plan = points._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda name: next(line.index("Relation") for line in plan if name in line and "Relation" in line)
    assert depth("n_nationkey") < depth("p_partkey") < depth("o_orderkey")
    assert points.count() == 1500
