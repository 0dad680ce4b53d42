"""Geocoding of a stream against static reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..fields import AddressFields
from ..plans.geocode import geocode
from ..sources.store import released


def geocode_stream(stream: DataFrame, fields: AddressFields, tables: dict[str, DataFrame], sink, **options) -> DataStreamWriter:
    """A writer that geocodes each micro-batch and hands it to ``sink(df, batch_id)``.

    A row's answer depends on itself and the reference tables only, so batches are
    independent and a repeated batch gives the same rows. What a batch stores on the way is
    deleted when its sink returns.
    """

    def one(df: DataFrame, batch: int) -> None:
        with released(df.sparkSession):
            sink(geocode(df, fields, tables, **options), batch)

    return stream.writeStream.foreachBatch(one)
