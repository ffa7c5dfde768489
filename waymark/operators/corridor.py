"""Where a track leaves the corridor of all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import segment_distance, to_utm
from waymark.operators.motion import by_time, first_run
from waymark.sources.tables import staged


def corridor_onset(points: DataFrame, metres: float = 7.5, run: int = 3) -> DataFrame:
    """(user, start): position of the first of `run` consecutive points farther than `metres` from the tracks of all other users.

    Outside a union of buffers is farther than the buffer from every segment, so no polygon is built: points meet the segments whose
    grid cells they share, in plane coordinates, cells as wide as the longest reach.
    """
    east, north = to_utm(F.col("lat"), F.col("lon"))
    # Four uses follow: staged, the projection is worked out once and no later stage carries it along.
    plane = staged(points.select("user", "ts", "event_id", east.alias("x"), north.alias("y")), "plane")
    w = by_time()
    ends = plane.select("user", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    # Repeated segments, either way round, cost one row a user.
    flip = (F.col("x") > F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("y") > F.col("y2")))
    ends = ends.select("user", *[F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x", "x2"), ("y", "y2"), ("x2", "x"), ("y2", "y"))])
    users = ends.groupBy("x", "y", "x2", "y2").agg(F.min("user").alias("u1"), F.max("user").alias("u2"))
    size = max(metres, 100.0)
    cell = lambda v: F.floor(v / size).cast("long")
    box = [F.explode(F.sequence(cell(F.least(a, b) - metres), cell(F.greatest(a, b) + metres))) for a, b in (("x", "x2"), ("y", "y2"))]
    spread = users.withColumn("cx", box[0]).withColumn("cy", box[1])
    places = plane.select("x", "y").distinct().withColumnsRenamed({"x": "px", "y": "py"}).withColumns({"cx": cell(F.col("px")), "cy": cell(F.col("py"))})
    near = places.join(spread, ["cx", "cy"]).where(segment_distance(*[F.col(c) for c in ("px", "py", "x", "y", "x2", "y2")]) <= metres)
    # A place is covered for a user if some segment near it is another's: the least and greatest owner tell.
    owners = near.groupBy("px", "py").agg(F.min("u1").alias("least"), F.max("u2").alias("most"))
    joined = plane.join(owners, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), "left")
    covered = F.coalesce((F.col("least") != F.col("user")) | (F.col("most") != F.col("user")), F.lit(False))
    return first_run(joined, ~covered, run, ["user"], ["ts", "event_id"])


def pairwise(rows: DataFrame, column: str, key: str, order: list[str]) -> DataFrame:
    """(key, first, second): neighbours in order."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.select(key, F.col(column).alias("first"), F.lead(column).over(w).alias("second")).where("second is not null")


def flag_onset(points: DataFrame, onsets: DataFrame) -> DataFrame:
    """points with `onset`, true for the row at its user's start in onsets(user, start), and `anomalous`, true from there on.

    The row is found by its position; equal coordinates elsewhere in the track do not count.
    """
    at = F.row_number().over(by_time()) - 1
    joined = points.withColumn("_at", at).join(onsets, "user", "left")
    return joined.withColumns({"onset": F.coalesce(F.col("_at") == F.col("start"), F.lit(False)), "anomalous": F.coalesce(F.col("_at") >= F.col("start"), F.lit(False))}).drop("_at", "start")
