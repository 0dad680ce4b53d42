"""What the cascade makes of equal rows and of streets with many houses."""

from pyspark.sql import functions as F

from caminho.operators import lattice
from caminho.operators.fuzzy import with_similar_street
from caminho.operators.matching import collapsed
from caminho.plans.geocode import distinct_addresses, match

POINT = "pt_id long, estado string, municipio string, logradouro string, numero int, cep string, localidade string, lat double, lon double, setor string"


def test_rows_meet_only_the_table_of_their_stage(spark):
    """One street of 300 houses, all known: of 600 equal and other rows none makes candidates of later stages."""
    houses = [(k, "S1", "C", "RUA MARIA", k + 1, f"0000{k % 5}-000", "CENTRO", -20 - k * 1e-4, -50.0, "s") for k in range(300)]
    points = spark.createDataFrame(houses + houses, POINT)
    tables = {name: spark.createDataFrame(t.collect(), t.schema) for name, t in lattice.lattice(points).items()}
    assert tables["T1"].count() == 300 and {r.n_casos for r in tables["T1"].collect()} == {2}
    rows = spark.range(600).join(points.where("pt_id < 3").distinct().withColumn("k", F.col("pt_id")), F.col("id") % 3 == F.col("k"))
    rows = rows.select(F.col("id").alias("row_id"), "estado", "municipio", "logradouro", "numero", "cep", F.when(F.col("k") < 2, F.col("localidade")).alias("localidade"))
    addresses = distinct_addresses(rows)[1]
    assert addresses.count() == 3
    found = collapsed(with_similar_street(addresses, tables), tables)
    assert "Window" not in found._jdf.queryExecution().toString()
    got = match(rows, tables).groupBy("tipo_resultado").count().collect()
    assert {r.tipo_resultado: r["count"] for r in got} == {"dn01": 400, "dn02": 200}
