"""The geocoder: stages, ties, both cascade plans, and the public functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caminho.errors import ArgumentError, NothingFoundError, OutsideCoverageError, ReferenceDataError
from caminho.fields import AddressFields
from caminho.functions.geo import renumber, utm_forward, utm_inverse
from caminho.functions.h3 import h3_cell, h3_cells
from caminho.functions.register import register_functions, register_tables
from caminho.functions.similarity import jaro, jaro_many, jaro_similarity, may_reach
from caminho.functions.standardize import ambiguous_street, cep, number, state, street
from caminho.operators.fuzzy import with_similar_street
from caminho.operators.lattice import lattice
from caminho.operators.matching import by_stages, collapsed
from caminho.operators.ties import resolve
from caminho.plans.cep import find_cep
from caminho.plans.geocode import geocode, numbered
from caminho.plans.reverse import reverse_geocode
from caminho.plans.stages import STAGES
from caminho.sources.addresses import input_rows, register_points
from caminho.sources import store as store_module
from caminho.sources.store import ReferenceStore, stored
from caminho.streaming.geocode import geocode_stream

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def tables(spark):
    points = stored(register_points(spark, SF))
    return {name: stored(t) for name, t in lattice(points).items()}


def test_stage_table():
    assert [s.rank for s in STAGES] == list(range(1, 26))
    assert [s.code for s in STAGES][:4] == ["dn01", "da01", "pn01", "pa01"] and STAGES[-1].code == "dm01"
    assert {s.code: s.table for s in STAGES}["da03"] == "T2"


def test_collapsed_plan_equals_the_loop(spark, tables):
    rows = stored(with_similar_street(stored(input_rows(register_points(spark, SF))), tables))
    key = lambda r: (r.row_id, r["rank"], r.endereco_encontrado, round(r.lat, 7), round(r.lon, 7), r.contagem_cnefe, r.desvio_metros, r.numero_encontrado)
    whole = sorted(map(key, collapsed(rows, tables).collect()), key=str)
    loop = sorted(map(key, by_stages(rows, tables, STAGES[:4]).collect()), key=str)
    assert [x for x in whole if x[1] <= 4] == loop and len({x[1] for x in whole}) >= 20


def test_similarity(spark):
    for a, b, want in [("MARTHA", "MARHTA", 0.9444), ("A", "", 0), ("", "", 0), ("AB", "BA", 0), ("IPÊ ROXO", "IPE ROXO", 0.8843)]:
        assert jaro(a.encode(), b.encode()) == pytest.approx(want, abs=1e-4)
    rows = spark.createDataFrame([("RUA DAS FLORES", "RUA DAS FLORE"), (None, "X"), ("A", "ABCDEFGHIJ")], "a string, b string")
    found = rows.select(jaro_similarity("a", "b").alias("s"), may_reach(F.col("a"), F.col("b"), 0.85).alias("m")).collect()
    assert found[0].s > 0.9 and found[0].m and found[1].s is None and not found[2].m


@pytest.mark.parametrize("name,want", [("RUA A", True), ("RUA MARIA 12", False), ("RUA PROJETADA 5", False), ("AVENIDA BRASIL 2000", False), ("RUA AB 123", True), ("RUA 1234", False), ("AVENIDA E", True), ("RUA 10", True), ("RODOVIA BR 364", True), ("RODOVIA BR-364 KM 12", True), ("RUA DEZ", True), ("TRAVESSA RUA DEZ", True), ("RUA DO BECO", False), ("RUA QUATRO", False), ("RUA 15 DE NOVEMBRO", False), (None, False)])
def test_ambiguous_streets(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(ambiguous_street(F.col("s"))).first()[0] is want


def test_standard_forms(spark):
    c = F.col("s")
    assert one(spark, street(c), s=" av.  São João ") == "AVENIDA SAO JOAO"
    assert one(spark, state(c), s="são paulo") == "SP" and one(spark, state(c), s="rj") == "RJ"
    assert [one(spark, number(c), s=x) for x in ("12", "0", "S/N", "10a")] == [12, None, None, None]
    assert [one(spark, cep(c), s=x) for x in ("70390-025", "1234567", "banana")] == ["70390-025", "01234-567", None]
    assert one(spark, renumber(c, F.lit(7)), s="RUA X, 32 - B, 5 - C") == "RUA X, 7 - B, 5 - C"


def test_projection(spark):
    x, y = utm_forward(F.col("lat"), F.col("lon"))
    assert one(spark, x, lat=-23.5, lon=-45.0) == pytest.approx(500_000) and one(spark, y, lat=0.0, lon=-45.0) == pytest.approx(10_000_000)
    assert one(spark, y, lat=-23.5, lon=-45.0) == pytest.approx(7401067.7, abs=1000)


def tied(spark, rows):
    """Candidates (row_id, metres north, cases, street, confusing) in the shape of the cascade's."""
    schema = "row_id long, m double, contagem_cnefe int, logradouro_encontrado string, log_causa_confusao boolean"
    return spark.createDataFrame(rows, schema).select("*", (F.col("m") / 111319.49).alias("lat"), F.lit(-45.0).alias("lon"), F.lit(10).alias("desvio_metros"), F.concat(F.lit("E"), F.col("m").cast("int").cast("string")).alias("endereco_encontrado"))


def test_ties(spark):
    found = {r.row_id: r for r in resolve(tied(spark, [
        (1, 0.0, 5, "RUA X", False),
        (2, 0.0, 5, "RUA X", False), (2, 100.0, 3, "RUA X", False),
        (3, 0.0, 6, "RUA X", False), (3, 500.0, 2, "RUA X", False),
        (4, 0.0, 6, "RUA X", False), (4, 2000.0, 2, "RUA X", False),
        (5, 0.0, 6, "RUA A", True), (5, 500.0, 2, "RUA A", True),
        (6, 0.0, 6, "RUA 7 DE SETEMBRO", True), (6, 2000.0, 2, "RUA 7 DE SETEMBRO", True),
        (7, 0.0, 6, None, False), (7, 2000.0, 6, None, False),
    ])).collect()}
    metres = {k: round(r.lat * 111319.49) for k, r in found.items()}
    assert metres == {1: 0, 2: 100, 3: 125, 4: 0, 5: 0, 6: 500, 7: 0}
    assert {k for k, r in found.items() if r.empate} == {3, 4, 5, 6, 7}


def test_geocode(spark, tables):
    want = register_points(spark, SF).where("pt_id % 40 = 0")
    rows = want.select("pt_id", "estado", "municipio", "logradouro", F.col("numero").cast("string").alias("n"), "cep", "localidade").orderBy("pt_id")
    fields = AddressFields(estado="estado", municipio="municipio", logradouro="logradouro", numero="n", cep="cep", localidade="localidade")
    out = geocode(rows, fields, tables, full=True, keep_order=True, geometry=True, h3_res=9)
    found = out.collect()
    assert [r.pt_id for r in found] == [r.pt_id for r in rows.collect()]
    assert {r.tipo_resultado for r in found} == {"dn01"} and not any(r.empate for r in found)
    assert all(r.geometry.startswith("POINT (") and r.h3_09.startswith("89") for r in found)
    only_city = geocode(rows.select("pt_id", "estado", "municipio"), AddressFields(estado="estado", municipio="municipio"), tables)
    assert {r.precisao for r in only_city.collect()} == {"municipio"}


def test_arguments(spark, tables):
    rows = spark.createDataFrame([("S0", "X", 1.0)], "uf string, city string, lat double")
    with pytest.raises(ArgumentError):
        AddressFields(estado="uf", municipio=None)
    with pytest.raises(ArgumentError):
        AddressFields(estado="uf", municipio="uf")
    for fields, df in [(AddressFields(estado="uf", municipio="nope"), rows), (AddressFields(estado="uf", municipio="city"), rows), (AddressFields(estado="uf", municipio="city"), rows.withColumnRenamed("lat", "a!b"))]:
        with pytest.raises(ArgumentError):
            geocode(df, fields, tables)
    with pytest.raises(ArgumentError):
        geocode(rows.drop("lat"), AddressFields(estado="uf", municipio="city"), tables, full="yes")


def test_reverse_and_codes(spark, tables):
    points = spark.createDataFrame([(1, -59.0, -28.0), (2, -35.0, -3.0)], "id int, lon double, lat double")
    t1 = tables["T1"]
    near = t1.limit(1).select(F.lit(9).alias("id"), (F.col("lon") + 0.001).alias("lon"), "lat")
    found = reverse_geocode(near.unionByName(points), t1, 1000).collect()
    assert [r.id for r in found if r.id == 9] == [9] and all(r.distancia <= 1000 for r in found)
    for bad in (10, 10**6, "1"):
        with pytest.raises(ArgumentError):
            reverse_geocode(points, t1, bad)
    with pytest.raises(OutsideCoverageError):
        reverse_geocode(spark.createDataFrame([(1, 10.0, 50.0)], "id int, lon double, lat double"), t1)
    rows = find_cep(spark, ["00007-000", "99999999"], tables["T3"]).collect()
    assert [r.municipio for r in rows if r.cep == "99999-999"] == [None] and len(rows) > 1
    cells = find_cep(spark, ["00007-000"], tables["T3"], h3_res=[7, 9], geometry=True).first()
    assert cells.h3_07.startswith("87") and cells.h3_09.startswith("89") and cells.geometry.startswith("POINT (")
    with pytest.raises(NothingFoundError):
        find_cep(spark, ["99999-999"], tables["T3"])


def test_row_numbers(spark):
    found = numbered(spark.range(100, numPartitions=7)).orderBy("row_id").collect()
    assert [(r.row_id, r.id) for r in found] == [(i + 1, i) for i in range(100)]


def test_row_numbers_of_rows_dealt_anew(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        left = spark.range(20_000).withColumn("k", F.xxhash64("id") % 100)
        right = spark.range(-100, 101).toDF("k").withColumn("x", F.lit("x" * 20))
        for rows in (left.orderBy(F.desc("id")), left.join(right, "k"), left.repartition(7, "k").groupBy("k", "id").count()):
            found = numbered(rows).collect()
            assert len(found) == 20_000 and len({r.id for r in found}) == 20_000 and {r.row_id for r in found} == set(range(1, 20_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    ordered = {r.row_id: r.id for r in numbered(spark.range(1000).orderBy(F.desc("id"))).collect()}
    assert ordered == {k: 1000 - k for k in range(1, 1001)}


def test_hexagonal_cells(spark):
    known = [(37.7752702151959, -122.418307270836, 9, "8928308280fffff"), (0.0, 0.0, 5, "85754e67fffffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (37.3615593, -122.0553238, 0, "8029fffffffffff")]
    for lat, lon, r, want in known:
        assert one(spark, h3_cell(F.col("lat"), F.col("lon"), r), lat=lat, lon=lon) == want
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(40_000, 3))
    lat, lon = np.degrees(np.arctan2(x[:, 2], np.hypot(x[:, 0], x[:, 1]))), np.degrees(np.arctan2(x[:, 1], x[:, 0]))
    assert [len(set(h3_cells(lat, lon, r))) for r in (0, 1)] == [122, 842]
    assert h3_cells(np.array([np.nan, 1.0]), np.array([1.0, np.nan]), 3).tolist() == [0, 0]
    for bad in (16, -1, True, "9"):
        with pytest.raises(ArgumentError):
            h3_cell(F.col("lat"), F.col("lon"), bad)


def test_projection_and_back(spark):
    for lat, lon in [(-23.5, -46.6), (5.0, -60.0), (-33.0, -53.0), (-10.0, -35.0)]:
        back = utm_inverse(*utm_forward(F.col("lat"), F.col("lon")))
        assert one(spark, back[0], lat=lat, lon=lon) == pytest.approx(lat, abs=1e-8) and one(spark, back[1], lat=lat, lon=lon) == pytest.approx(lon, abs=1e-8)


def test_names_in_sql(spark, tables, tmp_path):
    register_functions(spark)
    row = spark.sql("SELECT haversine(0, 0, 0, 1) AS d, jaro('MARTHA', 'MARHTA') AS j, h3_cell(37.3615593D, -122.0553238D, 7) AS c").first()
    assert row.d == pytest.approx(111319.49, abs=0.01) and row.j == pytest.approx(0.9444, abs=1e-4) and row.c == "87283472bffffff"
    store = ReferenceStore(str(tmp_path))
    store.write({"T8": tables["T8"]})
    assert register_tables(spark, store) == ["municipio"] and spark.sql("SELECT count(*) FROM municipio").first()[0] == tables["T8"].count()


def test_many_similarities_at_once():
    rnd = random.Random(4)
    word = lambda: bytes(rnd.choice(b"ABC E") for _ in range(rnd.randint(0, 20)))
    a, b = [[word() for _ in range(2000)] for _ in range(2)]
    assert jaro_many(a, b).tolist() == [jaro(x, y) for x, y in zip(a, b)]


def test_stream(spark, tables, tmp_path):
    """A stream in two batches gives the rows of the plain call, and leaves no scratch tables."""
    rows = register_points(spark, SF).where("pt_id % 160 = 0").select("pt_id", "estado", "municipio", "logradouro", F.col("numero").cast("string").alias("n"), "cep", "localidade")
    fields = AddressFields(estado="estado", municipio="municipio", logradouro="logradouro", numero="n", cep="cep", localidade="localidade")
    for k in (0, 1):
        rows.where(F.col("pt_id") % 320 == 160 * k).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    want = {r.pt_id: r.endereco_encontrado for r in geocode(rows, fields, tables).collect()}
    before, got = len(store_module._MADE), []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    writer = geocode_stream(stream, fields, tables, lambda df, batch: got.append([(r.pt_id, r.endereco_encontrado) for r in df.collect()]))
    writer.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert len([x for x in got if x]) == 2 and dict(x for part in got for x in part) == want and len(store_module._MADE) == before


def test_store(spark, tables, tmp_path):
    store = ReferenceStore(str(tmp_path), release="v2")
    with pytest.raises(ReferenceDataError):
        store.read(spark, "T8")
    with pytest.raises(ReferenceDataError):
        store.ensure(["T8"])
    with pytest.raises(ArgumentError):
        store.path("municip")
    store.write({"T8": tables["T8"]})
    (tmp_path / "v1").mkdir()
    assert store.read(spark, "municipio").count() == tables["T8"].count() and store.files() == ["municipio.parquet"]
    assert store.ensure(["T8"]) == [store.path("T8")]
    assert store.delete_old() == ["v1"]
    store.delete()
    assert store.files() == []
