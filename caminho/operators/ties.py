"""Resolving rows with several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.standardize import MONTH_STREET, SPELLED_TIE

#: Metres within which candidates are one place, and from which they are different ones.
SAME, APART = 300, 1000


def preferred() -> list[Column]:
    """Order of preference among candidates: many cases, small deviation, address."""
    return [F.col("contagem_cnefe").desc_nulls_last(), F.col("desvio_metros").asc_nulls_last(), F.col("endereco_encontrado").asc_nulls_last(), F.col("lat").asc_nulls_last(), F.col("lon").asc_nulls_last()]


def flagged(candidates: DataFrame) -> DataFrame:
    """``candidates`` with empate: whether their row has more than one."""
    return candidates.withColumn("empate", F.count("*").over(Window.partitionBy("row_id")) > 1)


def apart(candidates: DataFrame) -> DataFrame:
    """Tied candidates with dist: metres to the next one in order of preference."""
    order = Window.partitionBy("row_id").orderBy(*preferred())
    dist = haversine_m(F.col("lat"), F.col("lon"), F.lead("lat").over(order), F.lead("lon").over(order))
    return flagged(candidates).withColumn("dist", F.when(F.col("empate"), dist))


def lost_street() -> tuple[Column, Column]:
    """Whether a candidate's street is ambiguous, and whether it is not named after a month."""
    name = F.col("logradouro_encontrado")
    coded = F.col("log_causa_confusao") | F.coalesce(name.rlike(SPELLED_TIE), F.lit(False))
    return coded, ~F.coalesce(name.rlike(MONTH_STREET), F.lit(False))


def resolve(candidates: DataFrame) -> DataFrame:
    """One candidate per row, with empate.

    Candidates within SAME metres of the next preferred one give way to it. What is then
    alone is final. Of others, a row with candidates far apart or on an ambiguous street
    keeps the one with most cases among these; any other row gets the mean of the places,
    weighted by cases, with the attributes of the preferred one. All windows share one
    partitioning by row.
    """
    by_row = Window.partitionBy("row_id")
    left = apart(candidates).where(~F.col("empate") | F.col("dist").isNull() | (F.col("dist") > SAME))
    left = left.withColumns({"empate": F.count("*").over(by_row) > 1, "_most": F.max("dist").over(by_row)})
    coded, not_month = lost_street()
    left = left.withColumn("_lost", F.col("empate") & F.coalesce((F.col("_most") > APART) | coded, F.lit(False)) & not_month)
    left = left.withColumn("_any", F.max("_lost").over(by_row)).where(~F.col("_any") | F.col("_lost"))
    weight = F.sum("contagem_cnefe").over(by_row)
    mean = lambda c: F.when(F.col("empate") & ~F.col("_any"), F.try_divide(F.sum(F.col(c) * F.col("contagem_cnefe")).over(by_row), weight)).otherwise(F.col(c))
    first = F.row_number().over(by_row.orderBy(*preferred()))
    left = left.withColumns({"_lat": mean("lat"), "_lon": mean("lon"), "_first": first}).where("_first = 1")
    return left.withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")}).drop("_lat", "_lon", "_first", "_any", "_lost", "_most", "dist")
