"""The package's functions and tables under names in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.stages import TABLES, file_name
from ..sources.store import ReferenceStore
from .geo import RADIUS
from .h3 import h3_cells
from .similarity import jaro_similarity


def register_functions(spark: SparkSession) -> None:
    """haversine(lat1, lon1, lat2, lon2) in metres, jaro(a, b), and h3_cell(lat, lon, resolution) as text, for this session."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN {2 * RADIUS!r}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))""")
    spark.udf.register("jaro", jaro_similarity)

    @F.pandas_udf("string")
    def cell(lat, lon, resolution):
        out = resolution.astype(object)
        for r in resolution.dropna().unique():
            of = (resolution == r).to_numpy()
            out[of] = [f"{i:x}" if i else None for i in h3_cells(lat[of].to_numpy(float), lon[of].to_numpy(float), int(r))]
        return out

    spark.udf.register("h3_cell", cell)


def register_tables(spark: SparkSession, store: ReferenceStore) -> list[str]:
    """A temporary view for each stored reference table, under its file's name; the names."""
    there = set(store.files())
    names = [file_name(t) for t in TABLES if f"{file_name(t)}.parquet" in there]
    for name in names:
        store.read(spark, name).createOrReplaceTempView(name)
    return names
