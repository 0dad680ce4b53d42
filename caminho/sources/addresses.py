"""Deterministic addresses over the star-schema test tables: register points and input rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is done to an input row, by its class: house number 1000 higher, street without its last letter, and missing fields.
HIGHER, CHOPPED = (1, 12, 13, 14, 21, 22, 23), (5, 6, 19, 20, 21, 22, 23, 24, 25)
MISSING = {
    "logradouro": (8, 9, 10, 18),
    "numero": (6, 7, 8, 9, 10, 15, 16, 17, 18, 24, 25),
    "cep": (2, 4, 9, 10, 13, 14, 16, 17, 20, 23, 25),
    "localidade": (3, 4, 10, 12, 14, 15, 17, 18, 19, 22, 24),
}
ELSEWHERE, CLASSES = 11, 26


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, the six address fields, lat, lon and setor; a point per order.

    Orders are dealt twice, with no more columns than are needed; the nation comes last.
    """
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    n_parts = part.count()
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", (F.col("c_custkey") % 50).cast("int").alias("_code"), "c_nationkey", "c_mktsegment")
    rows = rows.join(part, F.col("o_orderkey") % n_parts == F.col("p_partkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    d = lambda x: F.lit(float(x))
    house = F.col("o_orderkey") * 7 % 400
    return rows.select(
        F.col("o_orderkey").cast("long").alias("pt_id"),
        F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("estado"),
        F.col("n_name").alias("municipio"),
        F.concat(F.lit("RUA "), F.upper("p_name")).alias("logradouro"),
        (house + 1).cast("int").alias("numero"),
        F.concat(F.lpad(F.col("_code").cast("string"), 5, "0"), F.lit("-000")).alias("cep"),
        F.col("c_mktsegment").alias("localidade"),
        (d(-30) + F.col("n_nationkey") * d(0.5) + (F.col("p_partkey") % 64) * d(0.003) + house * d(0.00001)).alias("lat"),
        (d(-60) + F.col("n_nationkey") * d(0.5) + F.col("_code") * d(0.002)).alias("lon"),
        F.col("p_brand").alias("setor"),
    )


def input_rows(points: DataFrame) -> DataFrame:
    """Every fourth point as an address to geocode, changed by its class."""
    m = F.floor(F.col("pt_id") / 4) % CLASSES
    rows = points.where("pt_id % 4 = 0").withColumn("m", m.cast("int"))
    chopped = F.when(F.col("m").isin(*CHOPPED), F.expr("left(logradouro, length(logradouro) - 1)")).otherwise(F.col("logradouro"))
    higher = F.when(F.col("m").isin(*HIGHER), F.col("numero") + 1000).otherwise(F.col("numero"))
    kept = lambda name, value: F.when(~F.col("m").isin(*MISSING[name]), value).alias(name)
    return rows.select(
        F.col("pt_id").alias("row_id"),
        "estado",
        F.when(F.col("m") == ELSEWHERE, F.lit("NOWHERE")).otherwise(F.col("municipio")).alias("municipio"),
        kept("logradouro", chopped),
        kept("numero", higher),
        kept("cep", F.col("cep")),
        kept("localidade", F.col("localidade")),
    )


def _in(values: tuple[int, ...]) -> str:
    return f"m IN ({', '.join(map(str, values))})"


#: The same two tables in SQL, as common table expressions.
POINTS_SQL = """pts AS (SELECT CAST(o_orderkey AS BIGINT) AS pt_id, concat('S', CAST(n_regionkey AS VARCHAR)) AS estado, n_name AS municipio,
  concat('RUA ', upper(p_name)) AS logradouro, CAST(o_orderkey * 7 % 400 + 1 AS INTEGER) AS numero,
  concat(lpad(CAST(c_custkey % 50 AS VARCHAR), 5, '0'), '-000') AS cep, c_mktsegment AS localidade,
  CAST(-30 AS DOUBLE) + n_nationkey * CAST(0.5 AS DOUBLE) + (p_partkey % 64) * CAST(0.003 AS DOUBLE) + (o_orderkey * 7 % 400) * CAST(0.00001 AS DOUBLE) AS lat,
  CAST(-60 AS DOUBLE) + n_nationkey * CAST(0.5 AS DOUBLE) + (c_custkey % 50) * CAST(0.002 AS DOUBLE) AS lon, p_brand AS setor
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""
INPUT_SQL = f"""inp AS (SELECT pt_id AS row_id, estado, CASE WHEN m = {ELSEWHERE} THEN 'NOWHERE' ELSE municipio END AS municipio,
  CASE WHEN {_in(MISSING["logradouro"])} THEN NULL WHEN {_in(CHOPPED)} THEN left(logradouro, length(logradouro) - 1) ELSE logradouro END AS logradouro,
  CASE WHEN {_in(MISSING["numero"])} THEN NULL WHEN {_in(HIGHER)} THEN numero + 1000 ELSE numero END AS numero,
  CASE WHEN {_in(MISSING["cep"])} THEN NULL ELSE cep END AS cep, CASE WHEN {_in(MISSING["localidade"])} THEN NULL ELSE localidade END AS localidade
  FROM (SELECT *, CAST(floor(pt_id / 4) AS BIGINT) % {CLASSES} AS m FROM pts WHERE pt_id % 4 = 0))"""
