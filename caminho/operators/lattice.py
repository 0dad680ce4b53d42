"""Reference tables from register points, and pruning them to what an input can match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..plans.stages import STATE_KEYS, TABLES


def counted(points: DataFrame) -> DataFrame:
    """The different points, with the number of times (_n) that each is there."""
    return points.groupBy(*STATE_KEYS, "logradouro", "numero", "cep", "localidade", "lat", "lon", "setor").agg(F.count("*").alias("_n"))


def build(points: DataFrame, table: str) -> DataFrame:
    """One row per key of ``table``: centre of the points within the 95th distance percentile
    of the first centre, that distance (desvio_metros), the number of points (n_casos), a full
    address, and the census tract if all points share one.

    Three aggregations on one key; Spark reuses one partitioning for them. Equal points are
    counted first (``counted``), so what is dealt grows with the different ones.
    """
    keys = [*STATE_KEYS, *TABLES[table]]
    points = points if "_n" in points.columns else counted(points)
    mean = lambda c: F.sum(F.col(c) * F.col("_n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))
    first = points.groupBy(*keys).agg(mean("lat").alias("_lat"), mean("lon").alias("_lon"))
    far = points.join(first, keys).withColumn("_d", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 2))
    reach = far.groupBy(*keys).agg(F.percentile("_d", 0.95, F.col("_n")).alias("_p"))
    near = F.col("_d") <= F.col("_p") + 0.01
    grouped = far.join(reach, keys).groupBy(*keys).agg(
        (F.sum(F.when(near, F.col("lat") * F.col("_n"))) / F.sum(F.when(near & F.col("lat").isNotNull(), F.col("_n")))).alias("lat"),
        (F.sum(F.when(near, F.col("lon") * F.col("_n"))) / F.sum(F.when(near & F.col("lon").isNotNull(), F.col("_n")))).alias("lon"),
        F.rint(F.first("_p")).cast("int").alias("desvio_metros"),
        F.sum("_n").cast("int").alias("n_casos"),
        F.when(F.min("setor") == F.max("setor"), F.min("setor")).alias("cod_setor"),
    )
    of = lambda name, before: F.concat(F.lit(before), F.col(name).cast("string")) if name in keys else F.lit("")
    street = F.col("logradouro") if "logradouro" in keys else F.lit("")
    number = F.concat(F.lit(", "), F.col("numero").cast("string")) if "numero" in keys else (F.lit(", 0") if "logradouro" in keys else F.lit(""))
    full = F.concat(street, number, of("localidade", " - "), F.lit(", "), F.col("municipio"), F.lit(" - "), F.col("estado"), of("cep", ", "))
    return grouped.withColumn("endereco_completo", full)


def lattice(points: DataFrame) -> dict[str, DataFrame]:
    """All eight reference tables."""
    return {name: build(points, name) for name in TABLES}


def prune(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The part of a reference table in the (state, city) pairs of ``rows``."""
    return table.join(rows.select(*STATE_KEYS).distinct(), list(STATE_KEYS), "left_semi")


def dictionary(table: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """Different street names by state, city and block keys."""
    return table.select(*STATE_KEYS, *block, "logradouro").distinct()
