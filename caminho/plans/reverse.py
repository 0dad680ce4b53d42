"""Points to their nearest address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..operators.spatial import check_extent, nearest, within_radius
from ..sources.store import stored
from .geocode import numbered

LEAST, MOST = 500, 100_000
#: Parts of the radius to look within, one after the other.
SHARES = (16, 4, 1)


def reverse_geocode(points: DataFrame, addresses: DataFrame, metres: float = 1000, spherical: bool = False, check: bool = True) -> DataFrame:
    """``points`` (lon, lat and any other columns) with the nearest address within ``metres`` and its distance.

    Points without an address in reach are left out. Register columns that clash with the
    points' own end in _encontrado.
    """
    if isinstance(metres, bool) or not isinstance(metres, (int, float)) or not LEAST <= metres <= MOST:
        raise ArgumentError(f"the radius is a number from {LEAST} to {MOST}")
    missing = {"lon", "lat"} - set(points.columns)
    if missing:
        raise ArgumentError(f"points need the columns {', '.join(sorted(missing))}")
    points = stored(points)
    if check:
        check_extent(points)
    found = growing(points, stored(addresses), metres, spherical)
    other = [F.col(f"t.{c}").alias(f"{c}_encontrado" if c in points.columns else c) for c in addresses.columns]
    joined = points.alias("p").join(found.alias("t"), (F.col("p.lon") == F.col("t.p_lon")) & (F.col("p.lat") == F.col("t.p_lat")))
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in points.columns], *other, F.col("t.distancia").alias("distancia"))


def growing(points: DataFrame, addresses: DataFrame, metres: float, spherical: bool) -> DataFrame:
    """The nearest address within ``metres`` of each different place of ``points`` (p_lon, p_lat).

    Whatever has an address within a small radius has its nearest one there, so only the
    places that have none look further. Where addresses are dense few pairs are made.
    """
    left, found = numbered(points.select("lon", "lat").distinct()), []
    for part in SHARES:
        found.append(stored(nearest(within_radius(left, addresses, metres / part, spherical), ["endereco_completo", "lat", "lon"])))
        left = left.join(found[-1].select("row_id"), "row_id", "left_anti")
        if part > 1 and left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
