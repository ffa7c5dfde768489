"""When two points or two trajectories are the same, and child trajectories of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("lat", "lon", "ts")
EXTENDED = (*BASE, "dx", "dt", "accuracy", "speed", "acceleration")


def same_point(a: Column, b: Column, extended: bool = False) -> Column:
    """Equality of two point structs; user and label never count. Extended also compares metrics and members pairwise."""
    same = F.lit(True)
    for name in EXTENDED if extended else BASE:
        same = same & a[name].eqNullSafe(b[name])
    return same & a["members"].eqNullSafe(b["members"]) if extended else same


def same_trajectory(a: Column, b: Column) -> Column:
    """Equality of two trajectory structs: the id and the number of points."""
    return a["traj_id"].eqNullSafe(b["traj_id"]) & a["n_points"].eqNullSafe(b["n_points"])


def children(segments: DataFrame, parent: str = "user") -> DataFrame:
    """(traj_id, parent_id, tag, start_ts, end_ts, n_points) of segments(parent, segment, ts): one child a segment."""
    made = segments.groupBy(parent, "segment").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_points"))
    return made.select(F.sha2(F.concat_ws("|", parent, "segment"), 256).alias("traj_id"), F.col(parent).alias("parent_id"), F.lit("subtrajectory").alias("tag"), "start_ts", "end_ts", "n_points")
