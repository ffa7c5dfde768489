"""Metrics of a point against the one before it, and gap segmentation, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import bearing, distance, equirectangular, haversine, manhattan
from waymark.functions.scalars import seconds_between


def by_time(*keys: str):
    return W.partitionBy(*(keys or ("user",))).orderBy("ts", "event_id")


def motion(points: DataFrame, *keys: str, lagged_speed: bool = True) -> DataFrame:
    """Adds dx, dt, speed, acceleration (0 for the first point and where dt is 0).

    lagged_speed=False takes the speed before as 0, so acceleration is speed over dt.
    """
    w = by_time(*keys)
    before = points.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_t": F.lag("ts").over(w)})
    dt = F.coalesce(seconds_between(F.col("_t"), F.col("ts")), F.lit(0.0))
    dx = F.coalesce(haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    out = before.withColumns({"dx": dx, "dt": dt}).withColumn("speed", F.when(F.col("dt") > 0, F.col("dx") / F.col("dt")).otherwise(0.0))
    last = F.coalesce(F.lag("speed").over(w), F.lit(0.0)) if lagged_speed else F.lit(0.0)
    out = out.withColumn("acceleration", F.when(F.col("dt") > 0, (F.col("speed") - last) / F.col("dt")).otherwise(0.0))
    return out.drop("_lat", "_lon", "_t")


def motion_flat(points: DataFrame, *keys: str, legacy: bool = True) -> DataFrame:
    """The older metrics: dx_euclidean, dx_manhattan, dx (dispatched), bearing, dt, velocity, change."""
    w = by_time(*keys)
    before = points.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_t": F.lag("ts").over(w)})
    args = [F.col(c) for c in ("_lat", "_lon", "lat", "lon")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = before.withColumns({"dx_euclidean": zero(equirectangular(*args, legacy)), "dx_manhattan": zero(manhattan(*args, legacy)), "dx": zero(distance(*args, legacy=legacy)), "bearing": zero(bearing(*args)), "dt": zero(seconds_between(F.col("_t"), F.col("ts")))})
    out = out.withColumn("velocity", F.when(F.col("dt") != 0, F.col("dx_euclidean") / F.col("dt")).otherwise(0.0))
    change = F.col("velocity") - F.coalesce(F.lag("velocity").over(w), F.lit(0.0))
    return out.withColumn("change", F.when(F.col("dt") != 0, change / F.col("dt")).otherwise(0.0)).drop("_lat", "_lon", "_t")


def gap_segments(points: DataFrame, gap: Column, *keys: str, name: str = "segment") -> DataFrame:
    """Numbers the segments of each key: a row where gap holds opens a new one."""
    run = by_time(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    return points.withColumn(name, F.sum(F.when(gap, 1).otherwise(0)).over(run))


def first_run(rows: DataFrame, flag: Column, length: int, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, start): position, from 0, of the first run of `length` true flags or more."""
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = rows.select(*keys, *order, flag.alias("_f"), (F.row_number().over(w) - 1).alias("_i"))
    numbered = numbered.where("_f").withColumn("_run", F.col("_i") - F.row_number().over(w))
    runs = numbered.groupBy(*keys, "_run").agg(F.min("_i").alias("start"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= length).groupBy(*keys).agg(F.min("start").alias("start"))


def measure_segments(flat: DataFrame, metres: float, measure: str = "dx_euclidean", *keys: str) -> DataFrame:
    """motion_flat() rows with `segment`: a step longer than metres by the measure (dx_euclidean or dx_manhattan) opens one; other measures never
    do."""
    gap = F.col(measure) > metres if measure in ("dx_euclidean", "dx_manhattan") else F.lit(False)
    return gap_segments(flat, gap, *keys)
