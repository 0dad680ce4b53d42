"""Postal codes to their streets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, NothingFoundError
from ..functions.geo import point_text
from ..functions.h3 import h3_cell, resolutions
from ..functions.standardize import cep as standard_cep

COLUMNS = ["estado", "municipio", "logradouro", "localidade", "lat", "lon"]


def lookup(codes: DataFrame, table: DataFrame) -> DataFrame:
    """Streets of each different code of ``codes`` (cep); a code that is not found has one row of nulls."""
    asked = codes.select(standard_cep(F.col("cep")).alias("cep")).where("cep is not null").distinct()
    return asked.join(table.select("cep", *COLUMNS), "cep", "left")


def find_cep(spark: SparkSession, codes: list[str], table: DataFrame, *, h3_res: int | list[int] | None = None, geometry: bool = False) -> DataFrame:
    """As lookup, from a list, with cells of each resolution of ``h3_res`` and points as text on demand; raises if none of the codes is found."""
    if not codes or not all(isinstance(c, str) for c in codes):
        raise ArgumentError("postal codes are a list of strings")
    found = lookup(spark.createDataFrame([(c,) for c in codes], "cep string"), table)
    if found.where("municipio is not null").isEmpty():
        raise NothingFoundError("none of the postal codes was found")
    found = found.withColumns({name: h3_cell(F.col("lat"), F.col("lon"), r) for name, r in resolutions(h3_res).items()})
    return found.withColumn("geometry", point_text(F.col("lon"), F.col("lat"))) if geometry else found
