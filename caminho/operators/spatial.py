"""Points and addresses: boxes, radii, nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OutsideCoverageError
from ..functions.geo import haversine_m, utm_forward

# The bounding box of Brazil, in degrees.
WEST, SOUTH, EAST, NORTH = -73.99044997, -33.75208127, -28.83594354, 5.27184108


def extent(points: DataFrame) -> DataFrame:
    """One row: the box of the points and whether it lies inside the covered area."""
    box = points.agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))
    inside = (F.col("xmin") >= WEST) & (F.col("xmax") <= EAST) & (F.col("ymin") >= SOUTH) & (F.col("ymax") <= NORTH)
    return box.withColumn("inside", inside)


def check_extent(points: DataFrame) -> None:
    """Raise if any point lies outside the covered area."""
    if extent(points).first()["inside"] is False:
        raise OutsideCoverageError("points lie outside the area that the register covers")


def boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box per group."""
    return points.groupBy(*by).agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))


def within_boxes(points: DataFrame, areas: DataFrame, cell: float = 0.25) -> DataFrame:
    """Pairs of a point and an area whose box holds it: an equality join on degree cells that
    the box covers, then the exact comparison, so no point meets all areas."""
    cover = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    covered = areas.withColumn("_cx", cover("xmin", "xmax")).withColumn("_cy", cover("ymin", "ymax"))
    placed = points.withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    inside = F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax"))
    return placed.join(covered, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def within_radius(points: DataFrame, addresses: DataFrame, metres: float, spherical: bool = False) -> DataFrame:
    """Pairs of a point (row_id, lon, lat) and an address within ``metres``, with distancia.

    An equality join on square cells as wide as the radius: each point looks into its own and
    the eight cells around. Distances are planar on the projection, or on the sphere. Columns
    of both sides stay; those of the points begin with p_.
    """

    def gridded(df: DataFrame) -> DataFrame:
        x, y = utm_forward(F.col("lat"), F.col("lon"))
        return df.withColumns({"_x": x, "_y": y})

    # Off the central meridian the projection stretches, so spherical search looks wider.
    cell = metres * (1.25 if spherical else 1.0)
    near = gridded(points.where("lon is not null and lat is not null"))
    near = near.select(*[F.col(c).alias(c if c == "row_id" else f"p_{c}") for c in points.columns], F.col("_x").alias("_px"), F.col("_y").alias("_py"))
    steps = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    near = near.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    near = near.withColumns({"_cx": F.floor(F.col("_px") / cell) + F.col("_dx"), "_cy": F.floor(F.col("_py") / cell) + F.col("_dy")})
    placed = gridded(addresses).withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
    planar = F.sqrt(F.pow(F.col("_x") - F.col("_px"), F.lit(2)) + F.pow(F.col("_y") - F.col("_py"), F.lit(2)))
    distance = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) if spherical else planar
    pairs = near.join(placed, ["_cx", "_cy"]).withColumn("distancia", distance).where(F.col("distancia") <= metres)
    return pairs.drop("_cx", "_cy", "_dx", "_dy", "_x", "_y", "_px", "_py")


def nearest(pairs: DataFrame, tie_by: list[str]) -> DataFrame:
    """The nearest address of each row_id; equally near ones by ``tie_by``."""
    order = Window.partitionBy("row_id").orderBy("distancia", *[F.col(c).asc_nulls_last() for c in tie_by])
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
