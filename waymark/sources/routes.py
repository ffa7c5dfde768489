"""Static routes between places: a table of encoded lines, where a routing service would be asked for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import polyline_encoded, polyline_points


def save_routes(routes: DataFrame, path: str, precision: float = 1e-6) -> None:
    """Writes routes(src, dst, length, points: array of (lat, lon)) with their lines encoded, one row a route."""
    routes.select("src", "dst", "length", polyline_encoded(F.col("points"), precision).alias("shape")).write.mode("overwrite").parquet(path)


def read_routes(spark: SparkSession, path: str, wanted: DataFrame | None = None, precision: float = 1e-6) -> DataFrame:
    """(src, dst, length, ord, x, y): the vertices of the stored routes, x being the longitude; of the pairs wanted(src, dst) alone, if
    given. A pair without a route gives no rows, as a service that finds none."""
    stored = spark.read.parquet(path)
    if wanted is not None:
        stored = stored.join(wanted.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    each = stored.select("src", "dst", "length", F.posexplode(polyline_points(F.col("shape"), precision)).alias("ord", "p"))
    return each.select("src", "dst", "length", "ord", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
